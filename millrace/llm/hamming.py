"""Approximate nearest neighbours by multi-index hashing.

Codes come from rotations learned by iterative quantisation (ITQ) on a bounded
sample. A code is cut into substrings of ``WIDTH`` bits, and each substring has
an index of its own: buckets by value. Probing the buckets within ``near`` bits
of the query's substring, for all substrings, retrieves every code within a
Hamming radius of ``substrings * (near + 1) - 1`` of the query's (pigeonhole:
such a code differs by ``near`` bits at most in some substring), and of the
codes beyond it those that come near in one substring. What is retrieved is
ranked by its exact inner product.

How many substrings there are decides what is found and what is probed; both
are told on the sample (:func:`fit`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import clean, search

#: The bound of the training sample: the rows with the smallest hashed ids.
SAMPLE = 4096
#: Bits of a substring (about the logarithm of a block's rows), and substrings at most.
WIDTH, MOST = 14, 448
#: The part of the sample's nearest neighbours that the substrings have to retrieve.
SHARE = 0.94
VALUES = np.arange(1 << WIDTH, dtype=np.uint16)
ONES = np.bitwise_count(VALUES)


def rotations(sample: np.ndarray, rounds: int = 5, seed: int = 11) -> Iterator[np.ndarray]:
    """One dim x dim projection after the other: PCA axes turned by ITQ from another start."""
    dim = sample.shape[1]
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    _, axes = np.linalg.eigh(unit.T @ unit)
    axes = axes[:, ::-1]
    turned = unit @ axes
    rng = np.random.default_rng(seed)
    while True:
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = (u @ v).T
        yield axes @ rotation


def encode(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The values of the codes' substrings, one column each."""
    out = np.empty((len(vectors), projection.shape[1] // WIDTH), dtype=np.uint16)
    weights = (1 << np.arange(WIDTH)).astype(np.float32)
    for lo in range(0, len(vectors), 1024):
        bits = (vectors[lo : lo + 1024] @ projection >= 0).reshape(-1, out.shape[1], WIDTH)
        out[lo : lo + 1024] = bits.astype(np.float32) @ weights
    return out


def ball(near: int) -> np.ndarray:
    """What a value is XORed with to get all values within ``near`` bits."""
    return VALUES[ONES <= near]


class MultiIndex:
    """For each substring the rows in the order of its value, and where each value's bucket begins."""

    def __init__(self, codes: np.ndarray):
        self.n, self.parts = codes.shape
        self.order = np.concatenate([np.argsort(codes[:, s], kind="stable") for s in range(self.parts)] or [np.zeros(0, int)]).astype(np.int32)
        sizes = np.zeros((self.parts, len(VALUES)), dtype=np.int32)
        for s in range(self.parts):
            sizes[s] = np.bincount(codes[:, s], minlength=len(VALUES))
        self.sizes = sizes.ravel()
        self.begin = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.base = np.arange(self.parts) * len(VALUES)

    def probe(self, code: np.ndarray, near: int) -> np.ndarray:
        """The rows of all buckets within ``near`` bits of the code's substrings."""
        buckets = (self.base[:, None] + (code[:, None] ^ ball(near)[None])).ravel()
        sizes = self.sizes[buckets]
        buckets, sizes = buckets[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        held = np.zeros(self.n, dtype=bool)
        held[self.order[np.repeat(self.begin[buckets] - ends + sizes, sizes) + np.arange(total)]] = True
        return np.flatnonzero(held)


def fit(sample: np.ndarray, neighbours: int, share: float) -> tuple[np.ndarray, int]:
    """(projection, near): the fewest substrings that retrieve ``share`` of the
    sample's own nearest neighbours. ``near`` is one bit if ``MOST`` substrings
    are enough; rotations are learned as they are asked for."""
    asked = min(256, len(sample))
    products = sample[:asked] @ sample.T
    products[np.arange(asked), np.arange(asked)] = -np.inf
    close = np.argsort(-products, axis=1)[:, :neighbours]
    more, have = rotations(sample), np.zeros((sample.shape[1], 0))
    for parts in (MOST // 8, MOST // 4, MOST // 2, MOST):
        while have.shape[1] < parts * WIDTH:
            have = np.concatenate([have, next(more)], axis=1)
        projection = have[:, : parts * WIDTH]
        codes = encode(sample, projection)
        least = np.minimum.accumulate(ONES[codes[:asked, None, :] ^ codes[close]], axis=2)  # asked x neighbours x substrings
        for near in range(1, 2 if parts < MOST else WIDTH + 1):
            found = (least <= near).mean(axis=(0, 1))
            if found[-1] >= share:
                return projection[:, : (int(np.argmax(found >= share)) + 1) * WIDTH], near
    raise AssertionError("a substring differs by WIDTH bits at most")


def trained(vectors: DataFrame, k: int, share: float) -> tuple[np.ndarray | None, int, int]:
    """(projection, near, dimension), fitted by one task on at most ``SAMPLE`` rows; None where there are too few."""
    total = max(1, vectors.count())

    def solve(batches):
        sample = [v for b in batches for v in b.column(0).to_pylist()]
        dims = [len(v) for v in sample]
        dim = max(set(dims), key=lambda d: (dims.count(d), d), default=0)
        known = np.array([v for v in sample if len(v) == dim]) if dim else np.zeros((0, 1))
        projection, near = fit(known, max(1, -(-k * len(known) // total)), share) if len(known) > k else (np.zeros((0, 0)), 0)
        yield pa.RecordBatch.from_arrays([pa.array([projection.astype(float).tobytes()]), pa.array([near]), pa.array([dim])], ["projection", "near", "dim"])

    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector")
    got = sample.repartition(1).mapInArrow(solve, "projection binary, near long, dim long").first()
    if got is None or not got["projection"]:
        return None, 0, got["dim"] if got else 0
    return np.frombuffer(got["projection"]).reshape(got["dim"], -1), got["near"], got["dim"]


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, share: float = SHARE, rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, ties to the smaller vec_id.

    Rotations and the number of substrings are fitted on at most ``SAMPLE``
    rows, counting as many neighbours as the sample holds of a query's k; every
    row is indexed. Where a block's buckets hold fewer than k rows, ``near``
    grows until they do. Zero vectors take no part, nor do those that
    :func:`millrace.llm.vectors.clean` leaves out, which also says what repeated
    ids mean; vectors meet their own dimension only, and dimensions other than
    the sample's commonest are searched exactly. Scores are inner products in
    double precision, infinite where that overflows (an overflow to NaN counts
    as minus infinity).
    """
    vectors = clean(embeddings).where(F.exists("vector", lambda x: x != 0))
    projection, near, dim = trained(vectors, k, share)

    def index(matrix):
        return MultiIndex(encode(matrix, projection)) if projection is not None and matrix.shape[1] == dim else None

    def probe(built, matrix, q):
        at, reach = np.arange(len(matrix)), near
        if built is not None:
            code = encode(q[None], projection)[0]
            at = built.probe(code, reach)
            while len(at) < min(k + 1, len(matrix)):
                reach += 1
                at = built.probe(code, reach)
        # row by row in one order of summation, so equal vectors have equal scores
        with np.errstate(over="ignore", invalid="ignore"):
            score = (matrix[at] * q).sum(axis=1)
        return at, np.where(np.isnan(score), -np.inf, score)

    return search(vectors, every, k, "double", probe, index, rows)
