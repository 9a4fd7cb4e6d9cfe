"""Text kernels over Arrow batches: words, hashes of byte spans and a bounded segment memo.

All of them work on the UTF-8 bytes of a slice of a batch (about ``SLICE``
bytes at a time; a longer document makes a slice of its own), so the memory of
a Python worker does not grow with the batch.

Hashes decide only which texts are compared or where rows go. A span of at most
eight bytes has a hash of its own among the spans of its length; longer ones
are folded eight bytes at a time by a mixing that is not linear in the text
(a polynomial has built-in collisions), or by BLAKE2b. Where equality decides a
result, the callers compare the bytes, or 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64
_K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Bytes behind a buffer, so that eight bytes can be read at every position of it and 16 behind.
PAD = b"\0" * 32
#: Bytes from which BLAKE2b hashes a span.
LONG = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is left of eight bytes, lowest first, if only so many count.
KEPT = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = a * _K1
    x ^= b
    x ^= x >> _U(32)
    x *= _K2
    x ^= x >> _U(29)
    return x


def runs_hash(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes, by doubling."""
    have, h = 1, codes
    while have < size:
        step = min(have, size - have)
        h = combine(h[: len(h) - step], h[step:]) if len(h) > step else h[:0]
        have += step
    return mix(h)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of a padded buffer on, as one number."""
    return np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf, strides=(1,)).copy()


def spans_hash(buf: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of a padded buffer."""
    n = end - start
    h = mix(mix(n.astype(np.uint64) * _K1) ^ (eight[start] & KEPT[np.minimum(n, 8)]))
    rest, at = np.flatnonzero((n > 8) & (n < LONG)), 8
    while len(rest):
        more = n[rest] - at
        h[rest] = mix(h[rest] + _K2 ^ (eight[start[rest] + at] & KEPT[np.minimum(more, 8)]))
        rest, at = rest[more > 8], at + 8
    for i in np.flatnonzero(n >= LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def slices(docs: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    lo, total = 0, 0
    for i, doc in enumerate(docs):
        if i > lo and total + len(doc) > size:
            yield lo, i
            lo, total = i, 0
        total += len(doc) + 1
    if lo < len(docs):
        yield lo, len(docs)


def parts(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, list[bytes]]]:
    """(lo, hi, texts) of slices of a text column of about ``size`` bytes; null is empty."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for lo, hi in zip(edges, edges[1:]):
        yield lo, hi, [x or b"" for x in column.slice(lo, hi - lo).cast(kind).to_pylist()]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some documents, as positions in one buffer.

    ``start``/``end`` are byte positions in ``buf``; ``doc`` is each word's
    document, ``first`` the index of the first word of each document (one
    longer than the documents).
    """

    def __init__(self, docs: list[bytes], lower: bool = False, gap: np.ndarray = SPACE):
        joined = b" " + b" ".join(docs) + b" "
        raw = np.frombuffer(joined + PAD, dtype=np.uint8)
        space = gap[raw[: len(joined)]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.cumsum([1] + [len(d) + 1 for d in docs])
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(docs)), self.count)
        self.buf = LOWER[raw] if lower else raw
        self._eight = None

    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.heads(None)
        return self._hashes

    def heads(self, size: int | None) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if self._eight is None:
            self._eight = eights(self.buf)
        end = self.end if size is None else np.minimum(self.end, self.start + size)
        return spans_hash(self.buf, self._eight, self.start, end)


class Memo:
    """A direct-mapped cache from segments to sizes and, if wanted, to short id lists.

    A segment of at most 16 bytes is its own key, as two numbers and its
    length; longer ones, up to ``LONG`` bytes, are keys of a dictionary. So what
    is found always belongs to just this segment. Bounded: 2**bits slots, at most
    ``pool`` stored ids and ``most`` long segments; what is full starts anew. A
    slot is taken over by the latest segment.
    """

    def __init__(self, bits: int = 20, pool: int = 6_000_000, most: int = 50_000):
        self.mask = _U((1 << bits) - 1)
        self.limit, self.most = pool, most
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.length = np.zeros(1 << bits, dtype=np.uint8)  # 0: free
        self.at = np.zeros(1 << bits, dtype=np.int32)
        self.size = np.zeros(1 << bits, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.long: dict[bytes, object] = {}

    def _look(self, raw: bytes, start: np.ndarray, end: np.ndarray):
        buf = np.frombuffer(raw + PAD, dtype=np.uint8)
        eight, n = eights(buf), end - start
        low = eight[start] & KEPT[np.minimum(n, 8)]
        high = np.where(n > 8, eight[np.minimum(start + 8, len(raw))] & KEPT[np.clip(n - 8, 0, 8)], _U(0))
        key = mix(mix(low + n.astype(np.uint64) * _K2) ^ high)
        slot = (key & self.mask).astype(np.int64)
        hit = (n <= 16) & (self.length[slot] == n) & (self.low[slot] == low) & (self.high[slot] == high)
        miss = np.flatnonzero(~hit & (n <= 16))
        _, which, back = np.unique(key[miss], return_index=True, return_inverse=True)
        which = miss[which]
        # two segments of one hash: the second counts by itself
        odd = np.flatnonzero((low[miss] != low[which][back]) | (high[miss] != high[which][back]) | (n[miss] != n[which][back]))
        back[odd] = len(which) + np.arange(len(odd))
        which = np.append(which, miss[odd])
        return slot, hit, low, high, n, miss, which, back, np.flatnonzero(n > 16)

    def _longs(self, raw: bytes, start, end, which, ask):
        """What ``ask`` gives for these segments, each distinct one asked for once."""
        cut = [raw[s:e] for s, e in zip(start[which].tolist(), end[which].tolist())]
        fresh = [x for x in dict.fromkeys(cut) if x not in self.long]
        got = dict(zip(fresh, ask(fresh))) if fresh else {}
        out = [self.long[x] if x in self.long else got[x] for x in cut]
        if len(self.long) + len(got) > self.most:
            self.long.clear()
        if len(got) <= self.most:
            self.long.update((x, v) for x, v in got.items() if len(x) <= LONG)
        return out

    def sizes(self, raw: bytes, start: np.ndarray, end: np.ndarray, count) -> np.ndarray:
        """Sizes of all segments of ``raw``; ``count(segments)`` gives those not cached."""
        slot, hit, low, high, n, miss, which, back, long = self._look(raw, start, end)
        size = np.where(hit, self.size[slot], 0).astype(np.int64)
        if len(miss):
            new = np.asarray(count([raw[s:e] for s, e in zip(start[which].tolist(), end[which].tolist())]), dtype=np.int64)
            size[miss] = new[back]
            self._settle(slot, low, high, n, which, size=new)
        if len(long):
            size[long] = self._longs(raw, start, end, long, count)
        return size

    def _settle(self, slot, low, high, n, which, **values):
        """Fill each slot from the last of the segments that share it."""
        to, last = np.unique(slot[which][::-1], return_index=True)
        last = len(which) - 1 - last
        self.low[to], self.high[to], self.length[to] = low[which[last]], high[which[last]], n[which[last]]
        for name, v in values.items():
            getattr(self, name)[to] = v[last]

    def ids(self, raw: bytes, start: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and concatenated ids; ``encode(segments)`` gives the id lists of those not cached."""
        slot, hit, low, high, n, miss, which, back, long = self._look(raw, start, end)
        size = np.where(hit, self.size[slot], 0).astype(np.int64)
        at = self.at[slot].astype(np.int64)
        extra, flat = [], np.zeros(0, dtype=np.int32)
        if len(miss):
            lists = encode([raw[s:e] for s, e in zip(start[which].tolist(), end[which].tolist())])
            lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter((x for one in lists for x in one), dtype=np.int32, count=int(lens.sum()))
            begin = np.cumsum(lens) - lens
            at[miss], size[miss] = self.used + begin[back], lens[back]
        if len(long):
            extra = [np.asarray(x, dtype=np.int32) for x in self._longs(raw, start, end, long, encode)]
            lens_long = np.array([len(x) for x in extra], dtype=np.int64)
            at[long], size[long] = self.used + len(flat) + np.cumsum(lens_long) - lens_long, lens_long
        out = self._gather(np.concatenate([self.pool[: self.used], flat, *extra]) if len(miss) or extra else self.pool, at, size)
        if len(miss):
            if self.used + len(flat) > self.limit:
                self.length[:] = 0
                self.used = 0
            if len(flat) <= self.limit:
                while self.used + len(flat) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + len(flat)] = flat
                self._settle(slot, low, high, n, which, at=self.used + begin, size=lens)
                self.used += len(flat)
        return size, out

    @staticmethod
    def _gather(source: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return source[np.repeat(at - (ends - size), size) + np.arange(total)]
