"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes of equal length that are coded side by side, each with its own range coder, all with one
model, so that every step is a few array operations over the lanes. The model starts empty in each block.

For each id three predictions are mixed into one distribution: order 2 names the id last seen after the two ids
before, order 1 the one after the id before, and order 0 is a table of counts over all ids. How much weight each gets
is learned from how often they were right in the same state: the two confidences, and whether both name the same id.
The mixed cumulative distribution is w0 * C0(id) + W1 * [p1 < id] + W2 * [p2 < id]; it has one interval per id and
so is coded in one step. After each step the model learns from all lanes; order 0 is rebuilt now and then.

Block layout, little-endian: "IDB1", u32 number of ids, u32 lanes, u32 crc32 of the ids as u32, then u16 words per
lane for each lane, then the lanes' 32-bit words one lane after the other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDB1"
IDS = 1 << 16
STEPS = 1024
TOTAL_BITS, BASE_BITS = 26, 18
TOTAL, BASE = 1 << TOTAL_BITS, 1 << BASE_BITS
SURE = 15  # highest confidence
PAIR_BITS = 20
REBUILD = 64
_HEAD = struct.Struct("<4sIII")
_LOW = np.uint64(1 << 32)
_32 = np.uint64(32)
_PART = np.uint64(TOTAL_BITS)
_PAIR = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def _after(sure: int, hit: bool) -> int:
    """How sure a context is of its id after a hit or a miss; -1 if it gives the id up."""
    if hit:
        return min(sure + 1, SURE)
    return sure >> 1 if sure > 1 else -1


# `take` with a mode is the fastest way to gather; no index is ever out of range.

#: By confidence, and 16 more for a hit: what is added to an entry of a context table that keeps its id.
_STEP = np.array([_after(at & 15, at > 15) - (at & 15) for at in range(32)], np.int32)


class Model:
    """What both directions know before each step. `spread` keeps a slot-to-id table, which only decoding needs."""

    def __init__(self, lanes: int, spread: bool):
        self.c1, self.c2 = np.zeros(lanes, np.intp), np.zeros(lanes, np.uint32)
        # Per context the id that came last, times 16, and how sure that is.
        self.last1, self.last2 = np.zeros(IDS, np.int32), np.zeros(1 << PAIR_BITS, np.int32)
        # Per state: order 2 right, else order 1 right, neither.
        self.right = np.tile(np.array([0.4, 0.3, 0.6])[:, None], (1, (SURE + 1) ** 2 * 2))
        self.seen, self.held, self.outcomes, self.step, self.spread = np.zeros(IDS), [], [], 0, spread
        self._rebuild()
        self._weigh()

    def _rebuild(self) -> None:
        if self.held:
            self.seen += np.bincount(np.concatenate(self.held), minlength=IDS)
        self.held = []
        total = self.seen.sum()
        free = BASE - IDS
        self.f0 = np.floor(self.seen * (free / total)).astype(np.int32) + np.int32(1) if total else np.ones(IDS, np.int32)
        self.f0[self.seen.argmax()] += BASE - self.f0.sum()
        self.c0 = np.cumsum(self.f0, dtype=np.int32) - self.f0
        if self.spread:
            self.slot = np.repeat(np.arange(IDS, dtype=np.int32), self.f0)

    def _weigh(self) -> None:
        size = self.right.shape[1]
        if self.outcomes:
            self.right += np.bincount(np.concatenate(self.outcomes), minlength=3 * size).reshape(3, size)
        self.outcomes = []
        share = self.right / self.right.sum(axis=0)
        self.w0 = np.clip((share[2] * (TOTAL >> BASE_BITS)).astype(np.int32), 1, (TOTAL >> BASE_BITS) - 1)
        free = TOTAL - (self.w0 << BASE_BITS)
        self.w2 = (free * (share[0] / (share[0] + share[1]))).astype(np.int32)
        self.w1 = free - self.w2

    def predict(self) -> None:
        """p1, p2 and the weights of this step, one per lane."""
        own = self.c1.astype(np.uint32)
        pair = self.c2 * _PAIR[0]
        pair += own * _PAIR[1]
        pair >>= np.uint32(32 - PAIR_BITS)
        self.c2, self.at2 = own, pair.astype(np.intp)
        self.g1, self.g2 = self.last1.take(self.c1, mode="clip"), self.last2.take(self.at2, mode="clip")
        self.p1, self.p2 = self.g1 >> 4, self.g2 >> 4
        self.s1, self.s2 = self.g1 & 15, self.g2 & 15
        state = self.s2 << 4
        state += self.s1
        state <<= 1
        state += self.p1 == self.p2
        self.state = state.astype(np.intp)
        self.a0, self.a1, self.a2 = self.w0.take(self.state, mode="clip"), self.w1.take(self.state, mode="clip"), self.w2.take(self.state, mode="clip")

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """What came in this step; ids as np.intp."""
        outcome = ((2 - hit1.view(np.int8)) * (1 - hit2.view(np.int8))).astype(np.intp)  # 0, 1, 2
        outcome *= self.right.shape[1]
        outcome += self.state
        self.outcomes.append(outcome)
        new = ids.astype(np.int32)
        new <<= 4
        new |= 1
        for table, at, told, sure, hit in ((self.last1, self.c1, self.g1, self.s1, hit1), (self.last2, self.at2, self.g2, self.s2, hit2)):
            sure += hit * np.int32(16)
            told += _STEP[sure]
            table[at] = np.where(sure < 2, new, told)
        self.c1 = ids
        self.held.append(ids)
        self.step += 1
        if self.step % REBUILD == 0 or self.step & (self.step - 1) == 0:
            self._rebuild()
        if self.step % 4 == 0 or self.step < 16:
            self._weigh()

    def interval(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' parts of TOTAL, as unsigned integers."""
        start = self.c0.take(ids, mode="clip")
        start *= self.a0
        start += self.a1 * (self.p1 < ids)
        start += self.a2 * (self.p2 < ids)
        size = self.f0.take(ids, mode="clip")
        size *= self.a0
        size += self.a1 * hit1
        size += self.a2 * hit2
        return start.astype(np.uint64), size.astype(np.uint64)


def encode(ids: np.ndarray) -> bytes:
    """A block of the ids (integers below 65536). An empty block has no lanes."""
    ids = np.asarray(ids)
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    lanes = -(-n // STEPS)
    head = _HEAD.pack(MAGIC, n, lanes, crc)
    if not n:
        return head
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes, False)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    most = steps * TOTAL_BITS // 32 + 4
    words = np.zeros(lanes * most, np.uint32)  # one lane after the other
    used = np.arange(lanes) * most
    for row in grid:
        now = row.astype(np.intp)
        model.predict()
        hit1, hit2 = now == model.p1, now == model.p2
        start, size = model.interval(now, hit1, hit2)
        width >>= _PART
        start *= width
        width *= size
        low += start
        over = low < start
        if over.any():
            _carry(words, used[over] - 1)
        out = np.flatnonzero(width < _LOW)
        first = low.take(out, mode="clip")
        at = used.take(out, mode="clip")
        words[at] = first >> _32
        used[out] = at + 1
        low[out] = first << _32
        width[out] = width.take(out, mode="clip") << _32
        model.learn(now, hit1, hit2)
    last = low + (_LOW - np.uint64(1))
    _carry(words, used[last < low] - 1)
    words[used] = last >> _32
    used += 1 - np.arange(lanes) * most
    body = words.reshape(lanes, most)[np.arange(most) < used[:, None]]
    return head + used.astype("<u2").tobytes() + body.astype("<u4").tobytes()


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    while len(at):
        words[at] += np.uint32(1)
        at = at[words[at] == 0] - 1


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as unsigned 16-bit integers; ValueError if its form or its checksum is wrong."""
    magic, n, lanes, crc = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    if not n:
        return np.empty(0, np.uint16)
    steps = -(-n // lanes)
    used = np.frombuffer(block, "<u2", lanes, _HEAD.size).astype(np.int64)
    flat = np.frombuffer(block, "<u4", offset=_HEAD.size + 2 * lanes)
    if len(flat) != used.sum():
        raise ValueError("a block of ids is cut short")
    flat = np.concatenate([flat, np.zeros(2, np.uint32)]).astype(np.uint64)
    read = np.cumsum(used) - used
    end = read + used

    def word(lane: np.ndarray) -> np.ndarray:
        at = read[lane]
        got = np.where(at < end[lane], flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
        read[lane] = at + 1
        return got

    every = np.arange(lanes)
    value = (word(every) << _32) | word(every)
    width = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    model = Model(lanes, True)
    grid = np.empty((steps, lanes), np.uint16)
    for step in range(steps):
        model.predict()
        width >>= _PART
        slot = np.minimum(value // width, np.uint64(TOTAL - 1)).astype(np.int32)
        a0, a1, a2, p1, p2 = model.a0, model.a1, model.a2, model.p1, model.p2
        # Where the parts of the two named ids begin and how wide they are; a slot in neither is a place in order 0.
        same = p1 == p2
        start1, start2 = model.c0.take(p1, mode="clip"), model.c0.take(p2, mode="clip")
        start1 *= a0
        start1 += a2 * (p2 < p1)
        start2 *= a0
        start2 += a1 * (p1 < p2)
        beyond1, beyond2 = slot - start1, slot - start2
        hit1 = (beyond1 >= 0) & (beyond1 < model.f0.take(p1, mode="clip") * a0 + a1 + a2 * same)
        hit2 = (beyond2 >= 0) & (beyond2 < model.f0.take(p2, mode="clip") * a0 + a2 + a1 * same)
        slot -= a1 * (beyond1 >= 0)
        slot -= a2 * (beyond2 >= 0)
        part = (slot / a0).astype(np.intp)  # exact: both are below 2 ** 26
        now = model.slot.take(part, mode="clip")  # of a hit the place means nothing
        now = np.where(hit2, p2, np.where(hit1, p1, now)).astype(np.intp)
        start, size = model.interval(now, hit1, hit2)
        start *= width
        value -= start
        width *= size
        short = np.flatnonzero(width < _LOW)
        value[short] = (value.take(short, mode="clip") << _32) | word(short)
        width[short] = width.take(short, mode="clip") << _32
        grid[step] = now
        model.learn(now, hit1, hit2)
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the checksum of a block of ids is wrong")
    return ids
