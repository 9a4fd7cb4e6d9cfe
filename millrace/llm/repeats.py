"""Where windows of a fixed length repeat in the corpus.

A window of ``length`` units (words or bytes) is represented by its anchor, the
run of ``k`` units in it whose hash is smallest (leftmost of equals). Equal
windows have equal anchors at equal places, so a window's other occurrences
are all found around the other occurrences of its anchor. Consecutive windows
with one anchor make a snippet of at most ``2 * length - k`` units. Equal
snippets are told by a 96-bit BLAKE2b digest of their bytes and become one row
with the number of times; different snippets of one anchor are variants, whose
texts have to be compared. No more than that is ever moved: anchors and digests
for all windows, texts for repeated anchors only.

Hot keys: anchors that a sample of documents shows to be frequent are dealt out
by digest, and their variants meet in shards of their own surroundings
(:func:`surroundings`); digests of very many places are salted.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import vectext as V
from millrace.llm.common import drop_stage, stage

_U = np.uint64
_POS = _U((1 << 28) - 1)
#: Bytes of text whose arrays are in memory at once, and units beyond which a document is cut into overlapping parts.
SLICE, PART = 1 << 19, 1 << 22
#: One document of so many tells which anchors are hot: those with at least HOT places in the sample.
SAMPLE, HOT = 32, 64
#: Variants of an anchor that meet in one shard; anchors of more meet by their surroundings.
MANY = 64
#: A digest with over one in DEALT of all snippets' places is salted by SALTS.
DEALT, SALTS = 4096, 64


@dataclass(frozen=True)
class Windows:
    """What is compared: ``unit`` is "word" or "byte"."""

    unit: str
    length: int
    k: int


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of ``w`` values (van Herk's two accumulations)."""
    n = len(v)
    pad = np.full(-n % w, np.iinfo(v.dtype).max, dtype=v.dtype)
    rows = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Units:
    """The units of some texts as one sequence; ``at`` has each text's first unit and the end.

    ``raw`` has their bytes; the texts of words are joined by single spaces
    first (:func:`normal`), so a run of units is a run of bytes."""

    def __init__(self, docs: list[bytes], unit: str):
        self.unit = unit
        if unit == "word":
            words = V.Words(docs)
            self.raw = words.buf.tobytes()
            self.begin, self.stop, self.at = words.start, words.end, words.first
            self._words = words
        else:
            self.raw = b"".join(docs) + V.PAD
            self.at = np.cumsum([0] + [len(d) for d in docs])

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` units."""
        if self.unit == "word":
            return V.runs_hash(self._words.hashes(), k)
        n = int(self.at[-1])
        eight = V.eights(np.frombuffer(self.raw, dtype=np.uint8))[:n]
        have = min(8, k)
        h = V.mix(eight & V.KEPT[have])
        while have < k:
            step = min(have, k - have)
            h = V.combine(h[:-step], h[step:]) if len(h) > step else h[:0]
            have += step
        return h[: max(0, n - k + 1)]

    def span(self, lo, units):
        """First byte and end of the run of so many units from ``lo`` on; also of arrays."""
        return (self.begin[lo], self.stop[lo + units - 1]) if self.unit == "word" else (lo, lo + units)

    def body(self, lo: int, units: int) -> bytes:
        a, z = self.span(lo, units)
        return self.raw[a:z]


def normal(doc: bytes, unit: str) -> bytes:
    """The text as its units are read: words joined by single spaces."""
    return b" ".join(doc.split()) if unit == "word" else doc


def parted(doc: bytes, windows: Windows):
    """(first unit, text) of the parts of a long text; each window lies in just one of them."""
    if len(doc) <= PART:
        yield 0, doc
        return
    seq = doc.split(b" ") if windows.unit == "word" else doc
    for lo in range(0, max(1, len(seq) - windows.length + 1), PART):
        part = seq[lo : lo + PART + windows.length - 1]
        yield lo, b" ".join(part) if windows.unit == "word" else part


def snippets(units: Units, windows: Windows):
    """Arrays doc, lo (unit of the sequence), n (windows), off (anchor within the snippet), anchor."""
    length, k = windows.length, windows.k
    sizes = np.diff(units.at)
    runs = np.maximum(0, sizes - length + 1)
    if not runs.sum():
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    doc = np.repeat(np.arange(len(sizes)), runs)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + units.at[:-1][doc]
    hashes = units.runs(k)
    least = sliding_min((hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64), length - k + 1)
    place = (least[start] & _POS).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    lo, p = start[first], place[first]
    n = np.diff(np.append(first, len(start)))
    return doc[first], lo, n, p - lo, hashes[p].view(np.int64)


def digests(units: Units, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests of the snippets' bytes, as 64 and 32 bits."""
    raw, blake = units.raw, hashlib.blake2b
    begin, stop = units.span(lo, n + length - 1)
    got = b"".join([blake(raw[a:z], digest_size=12).digest() for a, z in zip(begin.tolist(), stop.tolist())])
    words = np.frombuffer(got, dtype="<i4").reshape(-1, 3)
    return np.ascontiguousarray(words[:, :2]).view("<i8").ravel(), words[:, 2].copy()


def _tie(doc: bytes, last: bool) -> int:
    """32 bits: a checksum of the text, and whether the row has no doc_id."""
    return zlib.crc32(doc) >> 1 << 1 | bool(last)


def _batches(batches, windows: Windows):
    """Keys, places (unit within the text, tie), and the rest of what
    :func:`snippets` gives, for slices of batches with columns key, last and text."""
    for b in batches:
        for lo, hi, texts in V.parts(b.column(2), SLICE):
            keys, last = b.column(0).slice(lo, hi - lo).to_numpy(), b.column(1).slice(lo, hi - lo).to_pylist()
            own, base, ties, bodies = [], [], [], []
            for i, text in enumerate(texts):
                tie, body = _tie(text, last[i]), normal(text, windows.unit)
                for first, part in parted(body, windows):
                    own.append(i)
                    base.append(first)
                    ties.append(tie)
                    bodies.append(part)
            own, base, ties = np.array(own), np.array(base, dtype=np.int64), np.array(ties, dtype=np.int64)
            for a, z in V.slices(bodies, SLICE):
                units = Units(bodies[a:z], windows.unit)
                doc, at, n, off, anchor = snippets(units, windows)
                place = (at - units.at[:-1][doc] + base[a:z][doc]) << 32 | ties[a:z][doc]
                yield keys[own[a:z][doc]], place, n, off, anchor, *digests(units, at, n, windows.length)


def keyed(documents: DataFrame) -> DataFrame:
    """key (the doc_id, else a hash of the text), last (no doc_id) and text (null: empty)."""
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return documents.select(F.coalesce(doc, F.xxhash64(text)).alias("key"), doc.isNull().alias("last"), text.alias("text"))


ROWS = "anchor long, d1 long, d2 int, key long, at long, n int, off int, times long"


def places(docs: DataFrame, windows: Windows) -> DataFrame:
    """ROWS: the snippets of each batch, equal ones as one row with their first place."""

    def run(batches):
        for b in batches:
            found = list(zip(*_batches([b], windows)))
            if not found:
                continue
            key, at, n, off, anchor, d1, d2 = (np.concatenate(x) for x in found)
            order = np.lexsort((at >> 32, at & 0xFFFFFFFF, key, at & 1, d2, d1))
            head = np.ones(len(order), dtype=bool)
            head[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
            first = np.flatnonzero(head)
            to = order[first]
            times = np.diff(np.append(first, len(order)))
            columns = [anchor[to], d1[to], d2[to], key[to], at[to], n[to].astype(np.int32), off[to].astype(np.int32), times]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "d1", "d2", "key", "at", "n", "off", "times"])

    return docs.mapInArrow(run, ROWS)


def repeated(docs: DataFrame, windows: Windows) -> DataFrame:
    """Snippets of all anchors that occur more than once: anchor, d1, d2, key
    and at of the first occurrence, n, off, times, variants.

    Anchors that are hot in a sample of documents are dealt out by digest, so
    none fills a task; they count as repeated with over MANY variants."""
    sample = places(docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0), windows)
    hot = sample.groupBy("anchor").agg(F.sum("times").alias("c")).where(F.col("c") >= HOT).orderBy(F.desc("c"), "anchor").limit(DEALT).select("anchor", F.lit(True).alias("hot"))
    hot = stage(hot, "hot-anchors")  # DEALT rows at most
    rows = places(docs, windows).join(F.broadcast(hot), "anchor", "left")
    rows = rows.withColumn("deal", F.when(F.col("hot"), F.xxhash64("d1", "d2")).otherwise(F.col("anchor"))).repartition("deal")
    order = F.struct(F.col("at").bitwiseAND(F.lit(1)).alias("last"), "key", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tie"), F.shiftright("at", 32).alias("lo"), "at", "n", "off")
    each = rows.groupBy("deal", "anchor", "d1", "d2").agg(F.min(order).alias("f"), F.sum("times").alias("times"), F.max("hot").alias("hot"))
    group = Window.partitionBy("deal")
    each = each.withColumn("all", F.when(F.col("hot"), 2).otherwise(F.sum("times").over(group)))
    each = each.withColumn("variants", F.when(F.col("hot"), MANY + 1).otherwise(F.count("*").over(group)))
    out = stage(each.where("`all` > 1").select("anchor", "d1", "d2", "f.key", "f.at", "f.n", "f.off", "times", "variants"), "repeated")
    drop_stage(hot)
    return out


def located(docs: DataFrame, windows: Windows) -> DataFrame:
    """d1, d2, key and at of every snippet."""

    def run(batches):
        for key, at, _, _, _, d1, d2 in _batches(batches, windows):
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(key), pa.array(at)], ["d1", "d2", "key", "at"])

    return docs.mapInArrow(run, "d1 long, d2 int, key long, at long")


def surroundings(off: int, units: int, windows: Windows) -> list[tuple[bytes, int, int]]:
    """Runs of a snippet's units (side, first, stop) around its anchor that a
    window of it holds: the anchor with half of what else a window has room for,
    to its left or to its right. Equal windows have one of the two in common."""
    half = (windows.length - windows.k) // 2
    both = ((b"left", off - half, off + windows.k), (b"right", off, off + windows.k + half))
    return [(side, a, z) for side, a, z in both if 0 <= a and z <= units]


VARIANT = "shard long, d1 long, d2 int, last int, key long, at long, n int, times long, body binary"


def variant_texts(bodies: DataFrame, found: DataFrame, windows: Windows) -> DataFrame:
    """VARIANT rows of the first occurrences of repeated snippets: the shards
    they have to meet others in, and their text.

    ``bodies``: the documents, dealt out by key. A document's list of snippets
    is as long as the document at most."""

    names = [c.split()[0] for c in VARIANT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        for b in batches:
            for lo, hi, texts in V.parts(b.column(2), SLICE):
                rows: list[tuple] = []
                keys, lasts, lists = (b.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1, 3))
                for key, last, body, wanted in zip(keys, lasts, texts, lists):
                    tie, units = _tie(body, last), Units([normal(body, windows.unit)], windows.unit)
                    for w in wanted:
                        if w["at"] & 0xFFFFFFFF != tie:  # another text of this doc_id
                            continue
                        first, size = w["at"] >> 32, w["n"] + windows.length - 1
                        shards = [w["anchor"]]
                        if w["variants"] > MANY:
                            near = [hashlib.blake2b(units.body(first + x, z - x), digest_size=8, salt=side) for side, x, z in surroundings(w["off"], size, windows)]
                            shards = [int.from_bytes(x.digest(), "little", signed=True) for x in near]
                        own = (w["d1"], w["d2"], tie & 1, key, w["at"], w["n"], w["times"], units.body(first, size))
                        rows += [(x, *own) for x in shards]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    lists = found.groupBy("key").agg(F.collect_list(F.struct("anchor", "d1", "d2", "at", "n", "off", "times", "variants")).alias("wanted"))
    joined = bodies.join(lists.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2")).select("key", "last", "text", "wanted")
    return joined.mapInArrow(run, VARIANT).dropDuplicates(["shard", "d1", "d2"])


REPORT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first:long,stop:long>>"


def judged(docs: DataFrame, bodies: DataFrame, verdicts: DataFrame, windows: Windows) -> DataFrame:
    """REPORT of every row of ``bodies``: its units, how many marked windows
    cover, as how many spans, which, and what is left.

    ``verdicts``: d1, d2, n, times, keep_key, keep_at (the occurrence whose
    windows ``masks`` tell; null where they tell those of all), masks (packed
    bits, one or two lists that are ORed; null: all windows are marked).
    """
    verdicts = stage(verdicts, "verdicts")
    every = verdicts.agg(F.sum("times")).first()[0] or 0
    # DEALT rows at most
    hot = stage(verdicts.where(F.col("times") > max(1000, every / DEALT)).select("d1", F.lit(True).alias("hot")), "hot-digests")
    salt = lambda c: F.when(F.col("hot"), c).otherwise(F.lit(0)).cast("int").alias("salt")
    spots = located(docs, windows).join(F.broadcast(hot), "d1", "left").select("d1", "d2", "key", "at", salt(F.pmod(F.xxhash64("key", "at"), F.lit(SALTS))))
    each = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    told = verdicts.join(F.broadcast(hot), "d1", "left").select("d1", "d2", "n", "keep_key", "keep_at", "masks", F.explode(each).alias("salt"))
    marks = spots.join(told, ["d1", "d2", "salt"])
    partial = F.col("masks").isNotNull() & (F.col("keep_key").isNull() | ((F.col("key") == F.col("keep_key")) & (F.col("at") == F.col("keep_at"))))
    marks = marks.select("key", F.struct("at", "n", F.when(partial, F.col("masks")).alias("masks")).alias("m"))
    lists = marks.groupBy(F.col("key").alias("k2")).agg(F.collect_list("m").alias("marks"))
    joined = bodies.join(lists, F.col("key") == F.col("k2"), "left").select("key", "last", "text", "marks")

    def run(batches):
        for b in batches:
            for lo, hi, texts in V.parts(b.column(2), SLICE):
                keys, lasts = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                yield _report(keys, lasts.to_pylist(), texts, b.column(3).slice(lo, hi - lo), windows)

    return joined.mapInArrow(run, REPORT)


def _windows(marks: pa.ListArray, texts: list[bytes], lasts: list[bool], base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First units and ends of what is marked; ``base`` has each text's first unit."""
    of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
    one = marks.flatten()
    at, n, masks = one.field("at").to_numpy(), one.field("n").to_numpy(), one.field("masks")
    ties = np.array([_tie(t, last) if some else -1 for t, last, some in zip(texts, lasts, np.bincount(of, minlength=len(texts)).tolist())], dtype=np.int64)
    own = (at & 0xFFFFFFFF) == ties[of]  # else another text of this doc_id
    start, whole = base[of] + (at >> 32), pc.is_null(masks).to_numpy(zero_copy_only=False)
    begins, ends = [start[own & whole]], [(start + n + length - 1)[own & whole]]
    for i in np.flatnonzero(own & ~whole).tolist():
        bits = np.bitwise_or.reduce([np.unpackbits(np.frombuffer(x, np.uint8), count=n[i]) for x in masks[i].as_py()])
        begins.append(start[i] + np.flatnonzero(bits))
        ends.append(begins[-1] + length)
    return np.concatenate(begins), np.concatenate(ends)


def _report(keys: pa.Array, lasts: list[bool], texts: list[bytes], marks: pa.ListArray, windows: Windows) -> pa.RecordBatch:
    seqs = [t.split() for t in texts] if windows.unit == "word" else texts
    glue = b" " if windows.unit == "word" else b""
    sizes = np.array([len(x) for x in seqs], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    begins, ends = _windows(marks, texts, lasts, base, windows.length)
    total = int(sizes.sum())
    depth = np.cumsum(np.bincount(begins, minlength=total + 1) - np.bincount(ends, minlength=total + 1))[:total]
    gone = np.zeros(total + 2, dtype=bool)
    gone[1:-1] = depth > 0
    edge = np.zeros(total + 1, dtype=bool)  # a span ends with its text
    edge[base[sizes > 0]] = edge[total] = True
    first = np.flatnonzero(gone[1:-1] & (~gone[:-2] | edge[:-1]))
    stop = np.flatnonzero(gone[1:-1] & (~gone[2:] | edge[1:])) + 1
    of = np.searchsorted(base + sizes, first, side="right")
    spans, removed = np.bincount(of, minlength=len(texts)), np.bincount(of, weights=stop - first, minlength=len(texts)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(spans)])
    first, stop = first - base[of], stop - base[of]
    kept = []
    for i, seq in enumerate(seqs):
        if spans[i]:
            a, z = [0, *stop[cuts[i] : cuts[i + 1]].tolist()], [*first[cuts[i] : cuts[i + 1]].tolist(), len(seq)]
            left = [seq[x:y] for x, y in zip(a, z)]
            body = glue.join(w for part in left for w in part) if glue else b"".join(left)
        else:
            body = glue.join(seq) if glue else seq
        kept.append(hashlib.sha256(body).hexdigest())
    pairs = pa.StructArray.from_arrays([pa.array(first), pa.array(stop)], ["first", "stop"])
    doc = pa.array(keys.to_numpy(zero_copy_only=False), pa.int64(), mask=np.array(lasts, dtype=bool))
    columns = [doc, pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(kept), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "removed"])
