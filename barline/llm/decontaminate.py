"""Benchmark decontamination: word n-grams as seeds, then Smith-Waterman alignment of words.

Every n-gram of an item is a seed. One pass finds the seeds in the texts; where the stretch around seeds on near
diagonals holds enough of the item's words to reach the least score at all, it is aligned with the item. SEED_WORDS is 2
because a copy with every third word replaced still reaches LEAST and has no longer run. The pass needs nothing but the
items, so texts are never moved.

The benchmark is taken in slices of a bounded number of words, each sent to all executors and with a pass of its own,
so its size has no limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.shingles import texts_of

SEED_WORDS = 2
#: Words of the shortest item that is looked for.
ITEM_WORDS = 3
#: Words of the benchmark per slice.
SLICE_WORDS = 2_000_000
#: How far apart the diagonals of seeds of one copy may be, in words.
DRIFT = 10
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score of an alignment, as a share of that of the item with itself.
LEAST = 0.5

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, so that edits of signs do not hide a copy."""
    return text.translate(_FOLD, _SIGNS).split()


@dataclass
class Items:
    """A slice of the benchmark: word numbers of each item, and for each n-gram where it occurs."""

    item_ids: list[int]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    grams: np.ndarray  # sorted distinct
    places: tuple[np.ndarray, np.ndarray, np.ndarray]  # start of each n-gram's list; item and position in those lists

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for _, t in rows]
        made = [cls.grams_of(w if len(w) >= ITEM_WORDS else w[:0]) for w in words]
        every = np.concatenate(made) if made else np.empty(0, np.int64)
        return cls([r[0] for r in rows], vocabulary, words, *cls._placed(every, [np.arange(len(m)) for m in made]))

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    @cached_property
    def distinct(self) -> list[frozenset[int]]:
        return [frozenset(w.tolist()) for w in self.words]

    @staticmethod
    def _placed(every: np.ndarray, at: list[np.ndarray]):
        item = np.repeat(np.arange(len(at)), [len(a) for a in at])
        place = np.concatenate(at) if at else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        grams, starts = np.unique(every[order], return_index=True)
        return grams, (np.append(starts, len(every)), item[order], place[order])

    @staticmethod
    def grams_of(words: np.ndarray) -> np.ndarray:
        """n-grams as integers, 62 / SEED_WORDS bits a word, which no slice fills; -1 where a word is not of the benchmark."""
        n = max(0, len(words) - SEED_WORDS + 1)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(SEED_WORDS):
            part = words[i : i + n]
            code = (code << (62 // SEED_WORDS)) | part
            known &= part >= 0
        return np.where(known, code, -1)

    def numbers(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text of n-grams of the slice, and their indices."""
        code = self.grams_of(words)
        at = np.flatnonzero(code >= 0)
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        index = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
        hit = self.grams[index] == code[at]
        return at[hit], index[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score and the end (exclusive) of its stretch in `text`. Words of -1 match nothing."""
    best, end = 0, 0
    line = np.zeros(len(text) + 1, np.int64)
    slide = -GAP * np.arange(len(text) + 1)
    for word in item:
        new = np.zeros_like(line)
        new[1:] = np.maximum(line[:-1] + np.where(text == word, MATCH, MISMATCH), line[1:] + GAP)
        np.maximum(new, 0, out=new)
        line = np.maximum.accumulate(new + slide) - slide  # gaps along the text
        top = int(line.argmax())
        if line[top] > best:
            best, end = int(line[top]), top
    return best, end


def _bound(item: np.ndarray, text: np.ndarray) -> int:
    """At least the score of align: the best stretch of the item, if a word scores MATCH where the text has it at all and else costs a sign."""
    held, run, best = set(text.tolist()), 0, 0
    for word in item.tolist():
        run = max(0, run + (MATCH if word in held else max(MISMATCH, GAP)))
        best = max(best, run)
    return best


def _seeds_needed(size: np.ndarray, stretch: np.ndarray, least: float) -> np.ndarray:
    """At most as many seeds as an alignment of the least score has, for items of a size in a stretch of the text.

    With m words matched in r runs it has m - r seeds, and at least r - 1 words of item or text between runs, each of
    which costs 1. So m - r >= top - m - 1, where top is the least score, and, as the item has only size - m other words and
    the text stretch - m, m - r >= 3 * m - size - stretch - 1. Whatever m is, one of the two reaches the value below.
    """
    return (3 * least * MATCH * size - size - stretch) / 4 - 1


def matches(items: Items, words: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, word after the last) of the best copy of each item in a text."""
    at, index = items.found(words)
    if not len(at):
        return []
    starts, of, place = items.places
    many = starts[index + 1] - starts[index]
    flat = np.repeat(starts[index], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hits = np.stack([of[flat], np.repeat(at, many) - place[flat]])
    hits = hits[:, np.lexsort(hits[::-1])]
    begins = np.flatnonzero(np.append(True, (np.diff(hits[0]) != 0) | (np.diff(hits[1]) > DRIFT)))
    ends = np.append(begins[1:], hits.shape[1])
    item, first, last = hits[0, begins], hits[1, begins], hits[1, ends - 1]
    sizes, known = items.sizes[item], np.concatenate([[0], np.cumsum(words >= 0)])
    low, high = np.maximum(first - DRIFT, 0), np.minimum(last + sizes + DRIFT, len(words))
    enough = (ends - begins >= _seeds_needed(sizes, last - first + sizes + 2 * DRIFT, least)) & (known[high] - known[low] >= least * sizes)
    best: dict[int, tuple[int, float, int, int]] = {}
    plain = words.tolist()
    for item, low, high in zip(item[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True):
        own, distinct = items.words[item], items.distinct[item]
        if len(distinct.intersection(plain[low:high])) + len(own) - len(distinct) < least * len(own) or _bound(own, words[low:high]) < least * MATCH * len(own):
            continue
        score, end = align(own, words[low:high])
        share = score / (MATCH * len(own))
        if share >= least and share > best.get(item, (0, 0.0))[1]:
            _, back = align(own[::-1], words[low : low + end][::-1])
            best[item] = (items.item_ids[item], share, low + end - back, low + end)
    return list(best.values())


def _slices(benchmark: DataFrame) -> Iterator[Items]:
    rows: list[tuple[int, bytes]] = []
    held = 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"].encode()))
        held += len(r["text"]) // 2 + 1  # at least its words
        if held >= SLICE_WORDS:
            yield Items.of(rows)
            rows, held = [], 0
    if rows:
        yield Items.of(rows)


def find_copies(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: items of benchmark (item_id, text) copied in docs (doc_id, text).

    One row per document and item, for the best alignment that reaches `least` of the item's own score; score is that
    share. Words are counted from 0. Null, empty and wordless texts match nothing; items of fewer than ITEM_WORDS
    words are skipped; items with equal texts are all reported; repeated documents are reported each time, with a null
    doc_id too. Of alignments with equal scores the first is given. Texts are read whole, at any length, in memory that
    grows with one text. An empty table of documents or items gives an empty result.
    """
    spark, kinds = docs.sparkSession, "doc_id long, item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], kinds)
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                    rows += [(doc_id, *m) for m in matches(items, items.numbers(text), least)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [k.split()[0] for k in kinds.split(", ")])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(step, kinds))
    return out


def without_copies(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a benchmark item. Same cases as find_copies.

    A document is judged where it is read; no text is moved.
    """
    spark, out = docs.sparkSession, docs
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                clean = [not matches(items, items.numbers(text), least) for text in texts_of(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(step, docs.schema)
    return out
