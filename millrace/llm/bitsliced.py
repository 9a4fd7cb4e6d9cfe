"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers; slice b of attribute d is the bitmap of
the rows whose shifted component has bit b. A query's integer weights turn the
inner product into a sum of shifted slices: carry-save adders add them, a whole
word of rows at a time, into the slices of the score. The best rows are then
picked from the most significant score slice downward. The lowest ``skip``
bits of the components are left out of that sum; how much they can add is
known, so rows that may still reach the k-th score are kept and resolved with
exact integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.vectors import clean, search


#: Components up to this size are sliced; with larger ones a block is resolved by whole numbers of any size.
SMALL = 1 << 24


def quantise(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, exactly; as Python's numbers where some exceed SMALL."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * vectors)
    if np.abs(scaled).max(initial=0.0) <= SMALL:
        return scaled.astype(np.int64)
    # doubles of 2**53 and more are whole
    exact = [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in vectors.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def in_long(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long's range become its nearest end."""
    return np.array([max(-(2**63) + 1, min(2**63 - 1, int(x))) for x in scores], dtype=np.int64)


class Slices:
    """The index of a block: ``bits[d, b]`` is a bitmap, ``low[d]`` the shift of attribute d."""

    def __init__(self, values: np.ndarray, skip: int = 2):
        self.n, dims = values.shape
        self.low = values.min(axis=0)
        shifted = values - self.low
        self.skip = skip
        self.width = max(1, int(shifted.max()).bit_length()) if self.n else 1
        self.words = -(-self.n // 64)
        self.bits = np.zeros((dims, max(0, self.width - skip), self.words), dtype=np.uint64)
        for b in range(skip, self.width):
            packed = np.packbits((shifted >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
            self.bits[:, b - skip].view(np.uint8)[:, : packed.shape[1]] = packed
        self.all = np.zeros(self.words, dtype=np.uint64)
        ones = np.packbits(np.ones(self.n, dtype=np.uint8), bitorder="little")
        self.all.view(np.uint8)[: len(ones)] = ones

    def total(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of |w| times the attribute (or, for
        a negative weight, times its complement), in units of 2**skip."""
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(weights):
            w = int(weights[d])
            for b in range(self.width - self.skip):
                bitmap = self.bits[d, b] if w > 0 else ~self.bits[d, b]
                for a in range(abs(w).bit_length()):
                    if abs(w) >> a & 1:
                        columns.setdefault(a + b, []).append(bitmap)
        out, at = [], 0
        while any(k >= at for k in columns):
            pile = columns.pop(at, [])
            carry = columns.setdefault(at + 1, []) if len(pile) > 1 else None
            while len(pile) > 2:
                x, y, z = pile.pop(), pile.pop(), pile.pop()
                u = x ^ y
                carry.append(x & y | u & z)
                pile.insert(0, u ^ z)
            if len(pile) == 2:
                carry.append(pile[0] & pile[1])
                pile = [pile[0] ^ pile[1]]
            out.append(pile[0] if pile else np.zeros(self.words, dtype=np.uint64))
            at += 1
        return out or [np.zeros(self.words, dtype=np.uint64)]

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.n))

    def at_least_kth(self, sums: list[np.ndarray], k: int, spare: int) -> np.ndarray:
        """Rows whose sum is not below the k-th largest sum minus ``spare``."""
        if k >= self.n:
            return np.arange(self.n)
        sure, maybe, threshold, have = np.zeros(self.words, dtype=np.uint64), self.all, 0, 0
        for b in range(len(sums) - 1, -1, -1):
            with_bit = maybe & sums[b]
            n = int(np.bitwise_count(with_bit).sum())
            if have + n >= k:
                maybe = with_bit
                threshold |= 1 << b
            else:
                have += n
                sure |= with_bit
                maybe = maybe & ~sums[b]
        threshold -= spare
        if threshold <= 0:
            return np.arange(self.n)
        # sums >= threshold, again from the top slice down
        over, equal = np.zeros(self.words, dtype=np.uint64), self.all
        for b in range(len(sums) - 1, -1, -1):
            if threshold >> b & 1:
                equal = equal & sums[b]
            else:
                over = over | (equal & sums[b])
                equal = equal & ~sums[b]
        return self.rows(over | equal)


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, skip: int = 2, rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner
    products with the other vectors, ties to the smaller vec_id.

    Which rows take part, and what repeated ids mean, is stated in
    :func:`millrace.llm.vectors.clean`. Vectors meet only vectors of their own
    dimension. Quantised components and products are exact whatever their size;
    a score that no long holds counts as the nearest long. Equal scores of one
    vec_id are rows of one look. A query without other vectors gives no row, an
    empty table none.
    """

    def index(matrix):
        values = quantise(matrix)
        return values, Slices(values, skip) if values.dtype != object else None

    def probe(built, matrix, q):
        values, slices = built
        w = quantise(q)
        if slices is None or w.dtype == object or float(np.abs(w).sum()) * SMALL > 2.0**62:
            return np.arange(len(values)), in_long(values.astype(object) @ w.astype(object))
        # what the left-out bits can add, in units of 2**skip, rounded up; the complement's too
        spare = (((1 << skip) - 1) * int(np.abs(w).sum()) >> skip) + 1
        at = slices.at_least_kth(slices.total(w), k + 1, spare)
        return at, values[at] @ w

    return search(clean(embeddings), every, k, "long", probe, index, rows)


ORACLE = """
WITH v AS MATERIALIZED (
 SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
 SELECT a.nr, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.nr <> b.nr AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
