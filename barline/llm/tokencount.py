"""Token counts by Viterbi over a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates the pieces that end at each position; the dynamic programme carries, per
position, the best score and the number of pieces of the best segmentation, nothing else. The tie rules are those of
the public unigram tokenizers: a later candidate replaces an earlier one only if its score is strictly greater, and
candidates of a position come in order of their start, so among equals the longest last piece wins. A character that
is no piece itself may also be unknown, at UNKNOWN below the least score of the vocabulary, as the last candidate; it
then counts one token per UTF-8 byte if the vocabulary falls back to bytes, else one for a whole run of unknowns.

Spaces become the mark U+2581 and one mark is put before the text. Where no piece has a mark after another sign, holds
a newline or has Latin letters next to other signs, a text falls apart before each run of marks, around newlines and
between Latin letters and other signs; the parts are solved on their own and remembered. Other vocabularies have larger parts or whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN = 10.0
#: Parts that a task remembers; the table starts afresh beyond.
REMEMBERED = 1 << 19
#: Parts of up to so many characters are solved together, longer ones each alone.
SHORT = 48

_WORDS = re.compile(" *[^ \n]+| +|\n")
_LATIN = "A-Za-z\u00c0-\u024f"
_LETTERS = re.compile(f" *(?:[{_LATIN}]+|[^ \n{_LATIN}]+)| +|\n")
_MIXED = re.compile(f"[{_LATIN}][^{_LATIN}]|[^{_LATIN}][{_LATIN}]")


class UnigramCounter:
    """Counts for one vocabulary: pieces and their scores, and whether unknown characters fall back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        inner = [p.lstrip(MARK) for p, _ in pieces]
        self.apart = None  # what texts are cut into
        if byte_fallback and not any("\n" in p or MARK in p for p in inner):
            self.apart = _WORDS if any(map(_MIXED.search, inner)) else _LETTERS
        self.automaton = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.lengths, self.values = np.array([len(p) for p, _ in pieces]), np.array([s for _, s in pieces], np.float64)
        self.at: dict[str, int] = {}
        self.solved = np.empty((0, 3))

    @classmethod
    @lru_cache(maxsize=1)
    def of_file(cls, path: str) -> UnigramCounter:
        """The ordinary pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(map(model.is_byte, ids)))

    def solve(self, text: str) -> tuple[int, float, int]:
        """(tokens, score, unknown characters) of the best segmentation of a marked text."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, piece in self.automaton.iter(text):  # for each end the longest piece first, which is the earliest start
            ending[end + 1].append((len(self.pieces[piece][0]), self.pieces[piece][1]))
        score, tokens, unknown, open_run = [0.0], [0], [0], [False]
        for at in range(1, len(text) + 1):
            best, origin, known = float("-inf"), at - 1, True
            for length, value in ending[at]:
                if score[at - length] + value > best:
                    best, origin = score[at - length] + value, at - length
            if text[at - 1] not in self.single and score[at - 1] + self.unknown > best:
                best, origin, known = score[at - 1] + self.unknown, at - 1, False
            score.append(best)
            open_run.append(not known)
            if known:
                tokens.append(tokens[origin] + 1)
            elif self.byte_fallback:
                tokens.append(tokens[origin] + len(text[at - 1].encode()))
            else:
                tokens.append(tokens[origin] + (not open_run[origin]))
            unknown.append(unknown[origin] + (not known))
        return tokens[-1], score[-1], unknown[-1]

    def solve_many(self, texts: list[str]) -> np.ndarray:
        """The same for many marked texts without newlines, a row each; position by position, over all texts at once."""
        size = np.array([len(t) for t in texts])
        starts = np.cumsum(size + 1) - size - 1
        joined = "\n".join(texts) + "\n"
        signs = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        width = 1 + (signs >= 0x80) + (signs >= 0x800) + (signs >= 0x10000)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, length, value = found[:, 0] + 1, self.lengths[found[:, 1]], self.values[found[:, 1]]
        single = np.zeros(len(signs), bool)
        single[found[length == 1, 0]] = True
        local = end - starts[np.searchsorted(starts, found[:, 0], "right") - 1]
        order = np.argsort(local, kind="stable")  # by place in the text, then by text, the longest piece first
        end, length, value = end[order], length[order], value[order]
        most = int(size.max(initial=0))
        cuts = np.searchsorted(local[order], np.arange(1, most + 2))
        score, tokens, unknown = np.full(len(signs), -np.inf), np.zeros(len(signs), np.int64), np.zeros(len(signs), np.int64)
        score[starts] = 0.0
        long_first = np.argsort(-size, kind="stable")
        enough = np.searchsorted(-size[long_first], -np.arange(1, most + 2), "right")
        for at in range(1, most + 1):
            part = slice(cuts[at - 1], cuts[at])
            if part.start < part.stop:
                to, origin = end[part], end[part] - length[part]
                sums = score[origin] + value[part]
                heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                best = np.maximum.reduceat(sums, heads)
                group = np.cumsum(np.concatenate([[False], to[1:] != to[:-1]]))
                equal = np.flatnonzero(sums == best[group])
                equal = equal[np.concatenate([[True], group[equal[1:]] != group[equal[:-1]]])]
                score[to[heads]] = best
                tokens[to[heads]] = tokens[origin[equal]] + 1
                unknown[to[heads]] = unknown[origin[equal]]
            here = starts[long_first[: enough[at - 1]]] + at
            here = here[~single[here - 1]]
            here = here[score[here - 1] + self.unknown > score[here]]
            score[here] = score[here - 1] + self.unknown
            tokens[here] = tokens[here - 1] + width[here - 1]
            unknown[here] = unknown[here - 1] + 1
        last = starts + size
        return np.stack([tokens[last], score[last], unknown[last]], axis=1).astype(np.float64)

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.at]
        short = [p for p in new if len(p) <= SHORT and p != "\n"]
        long = [p for p in new if len(p) > SHORT or p == "\n"]
        made = [np.empty((0, 3))]
        if short:
            made.append(self.solve_many([p.replace(" ", MARK) for p in short]))
        if long:
            made.append(np.array([self.solve(p.replace(" ", MARK)) for p in long], np.float64))
        self.at.update(zip(short + long, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.solved = np.concatenate([self.solved, *made])

    def count(self, texts: list[str]) -> list[tuple[int, float, int]]:
        """(tokens, score, unknown characters) of each text; an empty text has none."""
        if self.apart is None:
            return [self.solve((" " + t).replace(" ", MARK)) if t else (0, 0.0, 0) for t in texts]
        if len(self.at) > REMEMBERED:
            self.at, self.solved = {}, np.empty((0, 3))
        parts = [self.apart.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(parts)))
        places = [np.fromiter(map(self.at.__getitem__, p), np.int64, len(p)) for p in parts]
        return [(int(n), float(s), int(u)) for n, s, u in (self.solved[p].sum(axis=0) for p in places)]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, score, n_unknown for every row of docs (doc_id, text; others are ignored).

    score is the sum of the scores of the best segmentation, n_unknown the characters that no piece covers there. Null
    and empty texts have 0 tokens. Repeated rows give equal results, an empty table an empty one; texts are read whole.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.of_file(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = counter.count([t or "" for t in batch.column("text").to_pylist()])
                made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_tokens", "score", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n_tokens long, score double, n_unknown long")
