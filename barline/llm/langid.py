"""Language identification with error-correcting output codes.

Every language has a codeword. For each of its bits a binary classifier over byte 2-grams and 3-grams says on which
side a text is; its weights are log-odds of the n-grams, its margin is scaled on labelled texts that it was not
fitted on. A text gets the language whose codeword has the least loss, where each classifier's loss weighs as much as
it was right for that language (loss-weighted decoding). Codewords that are too close in loss flag the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.shingles import texts_of
from barline.llm.tables import saved

#: Rows of each language that the model is fitted on at most; a hash of the id picks them.
PER_LANGUAGE = 1500
#: One in so many of those sets the scale of the margins and the decoding weights.
CALIBRATE = 4
#: Languages that are learned at most, those with the most rows: every one costs a codeword and weights on all executors.
MAX_LANGUAGES = 500
#: Below this share of the two best codewords' weight for the best one, a text is flagged.
AMBIGUOUS = 0.75
#: Added to the number of n-grams, so that very short texts are told apart with less confidence.
SHRINK = 16
PAIRS, TRIPLES = 1 << 16, 1 << 17
UNDETERMINED = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode())


def features(text: bytes) -> np.ndarray:
    """Indices of the byte 2-grams and hashed 3-grams of a text, lower-cased and framed by spaces."""
    x = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    pairs = (x[:-1] << np.uint32(8)) | x[1:]
    triples = ((pairs[:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(15)
    return np.concatenate([pairs, triples + np.uint32(PAIRS)])


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code up to 7 classes, else the best of random codes by least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        code = np.ones((n, bits))
        for i in range(1, n):
            code[i] = np.where((np.arange(bits) >> (n - 1 - i)) & 1, 1, -1)
        return code
    rng, best, far = np.random.default_rng(n), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        near = (bits - (code @ code.T - 2 * bits * np.eye(n)).max()) / 2
        if near > far and (abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    scale: np.ndarray  # 2 x bits
    trust: np.ndarray  # languages x bits

    def raw(self, text: bytes) -> np.ndarray:
        """Mean log-odds of each bit."""
        found, total = features(text), np.zeros(self.code.shape[1])
        for at in range(0, len(found), 1 << 18):
            total += self.weights[found[at : at + (1 << 18)]].sum(axis=0)
        return total / (len(found) + SHRINK)

    def decode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of mean log-odds: the nearest language, its share of the weight, whether it is ambiguous."""
        margin = raw * self.scale[0] + self.scale[1]
        loss = np.einsum("lb,nlb->nl", self.trust, np.logaddexp(0, -margin[:, None, :] * self.code[None]))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        first = loss.argmin(axis=1)
        top = np.sort(share, axis=1)[:, ::-1]
        second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(top))
        return first, 1 / share.sum(axis=1), top[:, 0] / (top[:, 0] + second) < AMBIGUOUS


def _sample(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """At most PER_LANGUAGE rows (lang, text, tuned) of each language, and the languages."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND NOT held_out")
    sizes = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()
    order = F.xxhash64("doc_id")
    space = 1 << 30
    part = F.lit(None)
    for r in sizes:
        part = F.when(F.col("lang") == r["lang"], int(space * min(1.0, 1.3 * PER_LANGUAGE / r["count"]))).otherwise(part)
    few = labelled.where(F.pmod(order, F.lit(space)) < part).withColumn("order", order)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE)
    return few.select("lang", "text", (F.col("rank") % CALIBRATE == 0).alias("tuned")), sorted(r["lang"] for r in sizes)


def _counts(group: pa.Table) -> pa.Table:
    total = np.zeros(PAIRS + TRIPLES)
    for text in texts_of(group):
        found, n = np.unique(features(text), return_counts=True)
        total[found] += n / n.sum() * min(n.sum(), 2000)
    return pa.table({"lang": group.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame) -> Model:
    """Learns from the rows of docs (doc_id, text, lang, held_out) that have a text and a lang and are not held out."""
    spark = docs.sparkSession
    few, languages = _sample(docs)
    few = saved(few, "labelled")
    code = codewords(len(languages))
    bits = code.shape[1]
    model = Model(languages, code, np.zeros((PAIRS + TRIPLES, bits), np.float32), np.array([np.ones(bits), np.zeros(bits)]), np.ones(code.shape))
    if len(languages) < 2:
        return model
    chance = np.full((len(languages), PAIRS + TRIPLES), 0.5)
    for r in few.where("NOT tuned").groupBy("lang").applyInArrow(_counts, "lang string, counts binary").toLocalIterator():
        chance[languages.index(r["lang"])] += np.frombuffer(r["counts"])
    chance /= chance.sum(axis=1, keepdims=True)
    for b in range(bits):
        up = code[:, b] > 0
        model.weights[:, b] = np.log(chance[up].mean(axis=0)) - np.log(chance[~up].mean(axis=0))
    sent = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [sent.value.raw(t).tolist() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(raw, pa.list_(pa.float64()))], ["lang", "raw"])

    rows = few.where("tuned").mapInArrow(margins, "lang string, raw array<double>").collect()  # bounded by the sample
    if rows:
        of = np.array([languages.index(r["lang"]) for r in rows])
        raw = np.array([r["raw"] for r in rows])
        for b in range(bits):
            model.scale[:, b] = _scaled(raw[:, b], code[of, b] > 0)
        right = (raw * model.scale[0] + model.scale[1]) * code[of] > 0
        for i in range(len(languages)):
            own = right[of == i]
            model.trust[i] = (own.sum(axis=0) + 1) / (len(own) + 2)
        model.trust *= bits / model.trust.sum(axis=1, keepdims=True) / max(1, bits / 4)
    return model


def _scaled(x: np.ndarray, up: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of `up` on x, by Newton's method with a small ridge."""
    z = np.stack([x, np.ones(len(x))])
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -30, 30)))
        slope = z @ (up - p) - ridge * at
        bend = (z * np.maximum(p * (1 - p), 1e-9)) @ z.T + ridge * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, slope), -20, 20)
    return max(at[0], 1e-3), at[1]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of docs with lang_pred, score (0 to 1) and ambiguous; only the text is looked at.

    Texts that are null or have no letter get `und`, score 0, not ambiguous, and so does all if no language was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = texts_of(batch)
            real = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
            raw = [model.raw(t) if ok else np.zeros(model.code.shape[1]) for t, ok in zip(texts, real, strict=True)]
            if model.languages and raw:
                first, score, close = model.decode(np.array(raw))
            else:
                first, score, close = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            named = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(first, real, strict=True)]
            made = [pa.array(named, pa.string()), pa.array(np.where(real, score, 0.0)), pa.array(close & real)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "lang_pred", "score", "ambiguous"])

    given = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema)
    return given.mapInArrow(step, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def with_held_out(docs: DataFrame) -> DataFrame:
    """held_out: crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs (doc_id, text, lang; others are ignored).

    The model learns from the rows that are not held out and have text and lang; lang is no input of a prediction. Of
    more than MAX_LANGUAGES values of lang the commonest are learned. Of languages with equal losses the first by code
    point is told, and the text is flagged. Repeated rows get equal results; an empty table gives an empty result; long
    texts are read whole.
    """
    given = with_held_out(docs.select("doc_id", "text", "lang"))
    out = identify(given.select("doc_id", "held_out", "text"), fit(given), ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
