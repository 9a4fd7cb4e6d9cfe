"""Quality classifier: cumulative-link regression on graded ratings.

A document's grade is 0 to 2: one point for good quality, one for not being
toxic. One score, a sum of weights of hashed text features, is held against
ordered thresholds: P(grade >= k) = sigmoid(score - threshold_k). So every
rating teaches the same weights, and the model gives an expected grade and the
probability of each tail.

Features are the distinct words (runs of letters, digits and non-ASCII bytes,
A-Z lower-cased) and the beginnings of longer ones, as 32-bit hashes, and a few shares that describe the text's
form. Only words that go with a grade have weights: of the distinct rated
texts, ``LEAST`` or more hold them, and the share of top grades among those is
``DEVIATIONS`` standard deviations or more from the share among all. Otherwise
the many rare words of a long text would outvote its few telling ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vectext as V

#: The bound of the training sample: rated documents with the smallest hashed ids.
SAMPLE = 8_000
#: Sampled texts that a word must occur in to get a weight.
LEAST = 4
DEVIATIONS = 5.0
#: Weight of the squared weights beside the mean log-likelihood.
PENALTY = 1e-4

_GAP = np.ones(256, dtype=bool)
_GAP[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _GAP[_a:_b] = False
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
FORM = 6
#: Bytes of the word beginnings that are features beside the whole words.
HEADS = (4, 5, 6)


def features(docs: list[bytes]):
    """For some texts: (document, word hash) of their distinct words, and their form, one row each."""
    pairs, forms, base = [], [], 0
    for lo, hi in V.slices(docs):
        part = docs[lo:hi]
        words = V.Words(part, lower=True, gap=_GAP)
        h = (words.hashes() >> np.uint64(32)).astype(np.int64)
        key = np.unique(words.doc << 32 | h)
        distinct = np.bincount(key >> 32, minlength=len(part))
        heads = [key]
        for size in HEADS:
            long = np.flatnonzero(words.end - words.start > size)
            h = (words.heads(size)[long] >> np.uint64(32)).astype(np.int64) ^ (size * 0x9E3779B1 & 0xFFFFFFFF)
            heads.append(np.unique(words.doc[long] << 32 | h))
        key = np.concatenate(heads)
        pairs.append((base + (key >> 32), key & 0xFFFFFFFF))
        at = np.cumsum([0] + [len(d) for d in part])
        buf = np.frombuffer(b"".join(part), dtype=np.uint8)
        size = np.maximum(1, np.diff(at))
        share = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[buf])])[at]) / size
        marks = V.Words(part)
        form = [
            np.sqrt(share(_UPPER)), np.sqrt(share(_MARK)), np.sqrt(share(_DIGIT)),
            1 - distinct / np.maximum(1, words.count), (words.count == 0) * 1.0,
            1 / np.sqrt(1 + marks.count),
        ]
        forms.append(np.stack(form, axis=1))
        base += len(part)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FORM))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(forms)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    form: np.ndarray  # weights of the form's shares and of their squares
    thresholds: np.ndarray  # ascending, one for each grade above 0

    def score(self, docs: list[bytes]) -> np.ndarray:
        doc, word, form = features(docs)
        out = np.hstack([form, form**2]) @ self.form
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            out += np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=len(docs))
        return out

    def tails(self, docs: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return sigmoid(self.score(docs)[:, None] - self.thresholds)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: list[bytes], grades: np.ndarray) -> Model:
    """The model of some rated texts."""
    doc, word, form = features(docs)
    return fit_features(doc, word, form, grades, np.array([_digest(d) for d in docs], dtype=np.int64))


def _digest(doc: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(doc, digest_size=8).digest(), "little", signed=True)


def loss(p: np.ndarray, doc, col, form, grades, words: int, top: int, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood and its gradient.

    ``p``: weights of the words, of the form, the first threshold, and the
    logarithms of the gaps between thresholds (so they stay in order)."""
    n, k = len(grades), words
    w, f, first, gap = p[:k], p[k : k + form.shape[1]], p[k + form.shape[1]], p[k + form.shape[1] + 1 :]
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
    s = form @ f + np.bincount(doc, weights=w[col], minlength=n)
    tail = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - theta), np.zeros((n, 1))], axis=1)
    rows = np.arange(n)
    hi, lo = tail[rows, grades], tail[rows, grades + 1]
    chance = np.maximum(hi - lo, 1e-300)
    d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
    d_s = -(d_hi - d_lo) / n
    d_theta = np.array([(d_hi[grades == j + 1].sum() - d_lo[grades == j].sum()) / n for j in range(top)])
    value = -np.log(chance).mean() + penalty / 2 * (w @ w + f @ f) + 5e-5 * (first * first + gap @ gap)
    g = np.concatenate([
        np.bincount(col, weights=d_s[doc], minlength=k) + penalty * w,
        form.T @ d_s + penalty * f,
        [d_theta.sum() + 1e-4 * first],
        np.array([d_theta[j + 1 :].sum() * np.exp(gap[j]) for j in range(top - 1)]) + 1e-4 * gap,
    ])
    return float(value), g


def descend(f, p: np.ndarray, close: float = 1e-6, steps: int = 2000, memory: int = 12) -> np.ndarray:
    """The minimum of ``f`` (value and gradient) by L-BFGS; an error where no
    component of the gradient falls below ``close`` within ``steps`` steps."""
    value, g = f(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= close:
            return p
        d, told = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d = d - a * y
            told.append(a)
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(told)):
            d = d + s * (a - y @ d / (s @ y))
        slope, length = g @ d, 1.0 if past else 1 / max(1.0, np.abs(g).max())
        if slope >= 0:  # no way down: start anew with the gradient
            past, d, slope = [], -g, -(g @ g)
        for _ in range(60):
            fresh = p + length * d
            low, g2 = f(fresh)
            if low <= value + 1e-4 * length * slope:
                break
            length /= 2
        s, y = fresh - p, g2 - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            past = [*past[1 - memory :], (s, y)]
        p, value, g = fresh, low, g2
    raise RuntimeError(f"ordinal: the gradient is still {np.abs(g).max():.2e} after {steps} steps")


def fit_features(doc, word, form, grades, texts, top: int = 2, penalty: float = PENALTY) -> Model:
    """Penalised maximum likelihood over the whole sample, to a gradient of zero; deterministic.

    (doc, word) are the texts' features, ``texts`` digests that tell equal texts."""
    n = len(grades)
    once = np.zeros(n, dtype=bool)
    once[np.unique(texts, return_index=True)[1]] = True
    names, at = np.unique(word, return_inverse=True)
    seen = np.bincount(at, weights=once[doc], minlength=len(names))
    good = np.bincount(at, weights=once[doc] & (grades[doc] == top), minlength=len(names))
    usual = (grades[once] == top).mean() if n else 0.0
    spread = np.sqrt(np.maximum(seen * usual * (1 - usual), 1e-12))
    keep = np.flatnonzero((seen >= LEAST) & (np.abs(good - seen * usual) >= DEVIATIONS * spread))
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    col = place[at]
    doc, col = doc[col >= 0], col[col >= 0]
    form = np.hstack([form, form**2])
    k = len(keep)
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(2 * FORM), np.linspace(-1, 0, top))
    # start with the thresholds of the grades' shares, with one more rating of each
    share = np.array([(grades >= j + 1).sum() + 1 for j in range(top)]) / (n + 2)
    theta = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    p = np.concatenate([np.zeros(k + form.shape[1]), theta[:1], gaps])
    p = descend(lambda x: loss(x, doc, col, form, grades, k, top, penalty), p)
    theta = p[k + form.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(p[k + form.shape[1] + 1 :]))])
    order = np.argsort(names[keep])
    return Model(names[keep][order], p[:k][order], p[k : k + form.shape[1]], theta)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rated documents. Null ratings don't count; of
    several ratings or texts of a document the highest, or smallest, counts."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    grade = F.max((F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")).alias("grade")
    chosen = rated.agg(grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    body = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade"))

    def describe(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(1)):
                doc, word, form = features(bodies)
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(bodies) + 1))
                word = word[order].astype("<u4")
                packed = [word[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]
                own = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([_digest(x) for x in bodies], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(packed, pa.binary()), pa.array([f.tobytes() for f in form], pa.binary())],
                    ["doc_id", "grade", "text", "words", "form"],
                )

    def solve(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables).sort_by("doc_id")
        packed = t.column("words").to_pylist()
        counts = [len(x) // 4 for x in packed]
        word = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
        form = np.frombuffer(b"".join(t.column("form").to_pylist()), dtype=np.float64).reshape(-1, FORM)
        m = fit_features(np.repeat(np.arange(len(counts)), counts), word, form, t.column("grade").to_numpy().astype(np.int64), t.column("text").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (m.words, m.weights, m.form, m.thresholds)], ["words", "weights", "form", "thresholds"])

    # one task fits; it holds `sample` feature lists at most
    described = rows.select("doc_id", "text", "grade").mapInArrow(describe, "doc_id long, grade int, text long, words binary, form binary")
    got = described.repartition(1).mapInArrow(solve, "words binary, weights binary, form binary, thresholds binary").first()
    if got is None:
        return fit([], np.zeros(0, dtype=np.int64))
    words, *rest = got
    return Model(np.frombuffer(words, np.int64), *(np.frombuffer(x, np.float64) for x in rest))


GRADES = "doc_id long, expected_grade double, p_grade_1 double, p_grade_2 double, keep boolean"


def grade(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """GRADES of every row: kept are those whose chance of the top grade is ``least`` or more.

    A null text counts as empty. Repeated rows and null ids stay; other
    columns are not read.
    """

    def run(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(1)):
                tails = model.tails(bodies)
                columns = [b.column(0).slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 1] >= least)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "p_grade_1", "p_grade_2", "keep"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, GRADES)


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that :func:`grade` keeps, with their own columns."""
    at = documents.columns.index("text")

    def run(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(at)):
                tails = model.tails(bodies)
                yield b.slice(lo, hi - lo).filter(pa.array(tails[:, 1] >= least))

    return documents.mapInArrow(run, documents.schema)
