"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash (Ertl, 2017) draws for each element a random permutation of the
signature's slots; in step j the element offers ``j + u`` (u uniform) to its
j-th slot. Once every slot holds less than j, no later step can change it, and
the document stops. Steps run over all elements of many documents at once.

Documents meet where a band of their signatures agrees. A group of thousands of
near copies would meet in all pairs, so a bucket's members are first held
against its smallest member only. What that leaves apart is compared pairwise
in small buckets, and in chunks of large ones, where a parity sketch of each
set bounds the Jaccard similarity of a pair from above: no pair over the
threshold is lost to it. All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vectext as V
from millrace.llm.common import drop_stage, stage
from millrace.llm.components import components

_U = np.uint64
#: Slots of a signature and rows of a band: at similarity 0.85 a pair shares
#: none of 32 bands with probability 6e-11, at 0.80 with 4.7e-8.
SLOTS, ROWS = 128, 4
#: Members of a bucket that are compared pairwise in one join, and of a chunk of larger buckets.
SMALL, CHUNK = 48, 1024
#: Bytes of text whose pairs are confirmed at once; one pair at least.
PAIRS = 1 << 22


def shingle_sets(docs: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of lower-cased words.

    They serve signatures and sketches; links are confirmed on the shingles
    themselves (:func:`numbered_sets`)."""
    out: list = []
    for lo, hi in V.slices(docs):
        words = V.Words(docs[lo:hi], lower=True)
        h = words.hashes()
        runs = V.runs_hash(h, width)
        for a, n in zip(words.first[:-1].tolist(), words.count.tolist()):
            if n >= width:
                out.append(np.unique(runs[a : a + n - width + 1]))
            else:
                out.append(V.runs_hash(h[a : a + n], n) + _U(n) if n else np.zeros(0, dtype=np.uint64))
    return out


def numbered_sets(docs: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles: among these texts, equal
    numbers mean equal words in equal order. Nothing is hashed."""
    names: dict[bytes, int] = {}
    rows, starts, at = [], [], 0
    for doc in docs:
        words = doc.lower().split()  # both know the same six blanks and A-Z only
        rows += [names.setdefault(w, len(names) + 1) for w in words] + [0] * width  # 0: no word
        starts.append((at, max(1, len(words) - width + 1) if words else 0))
        at += len(words) + width
    rank, have = np.array(rows, dtype=np.int64), 1
    while have < width:  # rank runs of words by the ranks of their halves
        step = min(have, width - have)
        pairs = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        have += step
    return [np.unique(rank[a : a + n]) for a, n in starts]


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures as uint32: the step above 24 random bits."""
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    sig = np.full(len(sets) * slots, 0xFFFFFFFF, dtype=np.uint32)
    if not counts.sum():
        return sig.reshape(-1, slots)
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), counts)
    perm = None
    for j in range(slots):
        x = V.mix(values + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> _U(40)) % _U(slots - j)).astype(np.int64)
        offer = (x & _U(0xFFFFFF)).astype(np.uint32) | np.uint32(j << 24)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(values))
            slot, own = perm[row, k].astype(np.int64), perm[row, j].copy()
            perm[row, j] = slot
            perm[row, k] = own
        np.minimum.at(sig, doc * slots + slot, offer)
        open_docs = sig.reshape(-1, slots).max(axis=1) >= np.uint32(j + 1 << 24) if j + 1 < slots else np.zeros(len(sets), dtype=bool)
        stay = open_docs[doc]
        if not stay.any():
            break
        if perm is None:
            values, doc, k = values[stay], doc[stay], k[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
            row = np.arange(len(values))
            perm[row, k] = 0
            perm[row, 0] = k
        elif stay.mean() < 0.7:
            values, doc, perm = values[stay], doc[stay], perm[stay]
    return sig.reshape(-1, slots)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band and its number."""
    n, slots = sig.shape
    parts = sig.reshape(n, slots // rows, rows).astype(np.uint64)
    h = np.arange(slots // rows, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(1)
    for r in range(rows):
        h = V.mix((h if r else np.broadcast_to(h, parts.shape[:2])) ^ (parts[:, :, r] + _U(r << 40)))
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """Parities of the set's hashes in 1,024 to 65,536 cells: two sets differ in
    at least as many elements as their sketches differ in cells."""
    size = 1024
    while size < 2 * len(values) and size < 65536:
        size *= 2
    return np.packbits(np.bincount((values & _U(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def fold(cells: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to fewer words."""
    while cells.shape[1] > words:
        half = cells.shape[1] // 2
        cells = cells[:, :half] ^ cells[:, half:]
    return cells


def may_reach(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes that differ in ``apart`` elements reach the similarity."""
    return 100 * (n_a + n_b - apart) >= percent * (n_a + n_b + apart)


SETS = "doc_id long, n long, h1 long, h2 long, sketch binary, bands array<long>"


def described(docs: DataFrame, width: int) -> DataFrame:
    """SETS of every row: size of its set, 128-bit BLAKE2b digest of its words, sketch and band hashes."""

    def run(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(1)):
                sets = shingle_sets(bodies, width)
                h = bands(signatures(sets))
                sums = b"".join(hashlib.blake2b(b" ".join(x.lower().split()), digest_size=16).digest() for x in bodies)
                sums = np.frombuffer(sums, dtype="<i8").reshape(-1, 2)
                columns = [
                    b.column(0).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[:, 0].copy()),
                    pa.array(sums[:, 1].copy()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "sketch", "bands"])

    return docs.mapInArrow(run, SETS)


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int, held: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``held`` gets the table that is read for it."""

    def bound(batches):
        for b in batches:
            a, z, n_a, n_b = (b.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                u, v = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(u.shape[1], v.shape[1])
                keep[i] = may_reach(n_a[i], n_b[i], int(np.bitwise_count(fold(u, words) ^ fold(v, words)).sum()), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(z[keep])], ["a", "b"])

    def confirm(batches):
        for b in batches:
            a, z = b.column(0).to_numpy(), b.column(1).to_numpy()
            sizes = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // PAIRS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(a)] if len(a) else [0]
            keep = np.zeros(len(a), dtype=bool)
            for lo, hi in zip(edges, edges[1:]):
                own = [x for c in (2, 3) for x in b.column(c).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                distinct = {t: i for i, t in enumerate(dict.fromkeys(own))}
                sets = numbered_sets(list(distinct), width)
                for i in range(hi - lo):
                    x, y = sets[distinct[own[i]]], sets[distinct[own[hi - lo + i]]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[lo + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(z[keep])], ["a", "b"])

    side = lambda k: nodes.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    passing = stage(sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bound, "a long, b long").distinct(), "pairs")
    held.append(passing)
    body = lambda k: docs.where("doc_id is not null").select(F.col("doc_id").alias(k), F.col("text").alias(f"t_{k}"))
    whole = body("a").join(passing.hint("shuffle_hash"), "a").join(body("b"), "b").select("a", "b", "t_a", "t_b")
    return whole.mapInArrow(confirm, "a long, b long").distinct()


def chunk_pairs(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of large buckets that the sketches don't rule out and that are not
    yet in one component: all of them, or those that would join components.

    ``rows``: bucket, doc_id, c (component), most (whether it is the bucket's
    largest component), held and left (members in that one, and in the others),
    n, sketch. Members of the largest component meet the others only, chunk by
    chunk, so a group of near copies that all but some are joined is read once for
    each CHUNK of these.
    """

    def run(key, group):
        side = group.column("lo").to_numpy(zero_copy_only=False)
        doc, comp, n = (group.column(c).to_numpy() for c in ("doc_id", "c", "n"))
        raw = group.column("sketch").to_pylist()
        bits = np.array([len(x) for x in raw])
        found: list[tuple[int, int, int]] = []
        for size in np.unique(bits).tolist():
            at = np.flatnonzero((bits == size) | (bits == 2 * size))
            cells = np.empty((len(at), size // 8), dtype=np.uint64)
            for wide in (size, 2 * size):
                own = np.flatnonzero(bits[at] == wide)
                if len(own):
                    cells[own] = fold(np.stack([np.frombuffer(raw[i], np.uint64) for i in at[own]]), size // 8)
            for k, i in enumerate(at.tolist()):
                rest = at[k + 1 :]
                ok = (comp[rest] != comp[i]) & (side[rest] != side[i]) if (key[1].as_py(), key[2].as_py()) != (0, key[3].as_py()) else comp[rest] != comp[i]
                ok &= (bits[rest] == size) | (bits[i] == size)
                ok &= 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
                if ok.any():
                    other = np.flatnonzero(ok) + k + 1
                    apart = np.bitwise_count(cells[other] ^ cells[k]).sum(axis=1)
                    good = may_reach(n[at[other]], n[i], apart.astype(np.int64), percent)
                    found += [(int(d), i, j) for d, j in zip(apart[good].tolist(), at[other[good]].tolist())]
        if not every:
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            kept = []
            for d, i, j in sorted(found):
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((d, i, j))
            found = kept
        a = np.array([min(doc[i], doc[j]) for _, i, j in found], dtype=np.int64)
        b = np.array([max(doc[i], doc[j]) for _, i, j in found], dtype=np.int64)
        return pa.table([a, b], names=["a", "b"])

    others, largest = F.ceil(F.col("left") / CHUNK), F.ceil(F.col("held") / CHUNK)
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("most"), largest).otherwise(others))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda kind, x, y, lo: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), lo.alias("lo"))
    among = F.transform(numbers(others), lambda o: task(0, F.least(F.col("own"), o), F.greatest(F.col("own"), o), F.col("own") <= o))
    to_largest = F.transform(numbers(largest), lambda m: task(1, F.col("own"), m, F.lit(True)))
    from_largest = F.transform(numbers(others), lambda o: task(1, o, F.col("own"), F.lit(False)))
    tasks = F.explode(F.when(F.col("most"), from_largest).otherwise(F.concat(among, to_largest)))
    dealt = rows.withColumn("own", own).select("bucket", tasks.alias("t"), "doc_id", "c", "n", "sketch")
    dealt = dealt.select("bucket", "t.kind", "t.x", "t.y", "t.lo", "doc_id", "c", "n", "sketch")
    return dealt.groupBy("bucket", "kind", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than ``width`` words is one shingle; without words, or null, the set is
    empty and links with nothing. Texts of equal words form a class at once, by
    128-bit digests; links between classes need
    ``100 * intersection >= percent * union`` of their real shingles. Rows with one
    doc_id are one node and share its component. Rows without doc_id link with
    nothing: component_id null, kept true. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(stage(df, name))
        return held[-1]

    sets = stage(described(docs, width), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    digest = ["n", "h1", "h2"]
    classes = full.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    reps = classes.withColumnRenamed("rep", "doc_id")
    nodes = keep(full.join(reps.hint("shuffle_hash"), [*digest, "doc_id"], "left_semi").dropDuplicates([*digest, "doc_id"]), "nodes")
    buckets = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("center")).where("size > 1")
    members = keep(buckets.join(sizes, "bucket"), "members")

    links = keep(similar(members.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), nodes, docs, percent, width, held), "links")
    # ids that stand for several texts tie their classes together
    key = F.struct(*digest)
    several = full.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id")
    tied = full.select("doc_id", *digest).join(several, "doc_id").join(classes, digest)
    links = links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    def apart(links: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, with c."""
        comp = components(links)
        tagged = members.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "size", F.coalesce("component", "doc_id").alias("c"))
        tagged = keep(tagged, "tagged")
        parts = tagged.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("all"))
        split = parts.where("m.k < `all`").select("bucket", F.col("m.c").alias("top"), F.col("m.k").alias("held"), (F.col("all") - F.col("m.k")).alias("left"))
        return tagged.join(split, "bucket").withColumn("most", F.col("c") == F.col("top")).drop("top")

    left = keep(apart(links), "apart")
    few, many = left.where(f"size <= {SMALL}"), left.where(f"size > {SMALL}")
    other = few.select("bucket", F.col("doc_id").alias("b"), F.col("c").alias("c_b"))
    pairs = few.select("bucket", F.col("doc_id").alias("a"), F.col("c").alias("c_a")).join(other, "bucket").where("a < b and c_a <> c_b").select("a", "b").distinct()
    hot = bool(many.limit(1).count())
    facts = nodes.select("doc_id", "n", "sketch")
    if hot:
        pairs = pairs.unionByName(chunk_pairs(many.join(facts, "doc_id"), percent, False)).distinct()
    links = keep(links.unionByName(similar(pairs, nodes, docs, percent, width, held)), "links")
    if hot:
        rest = apart(links).where(f"size > {SMALL}")
        links = keep(links.unionByName(similar(chunk_pairs(rest.join(facts, "doc_id"), percent, True), nodes, docs, percent, width, held)), "links")
    comp = stage(components(links), "components")
    for df in held:
        drop_stage(df)
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", *digest).join(named, digest, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    group = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))



ORACLE = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
 SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM s),
classes AS (SELECT s, n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY s, n),
e AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
 SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
 WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
 GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
way AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, seen) AS (SELECT DISTINCT a, a FROM way UNION SELECT r.node, x.b FROM reach r JOIN way x ON x.a = r.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, d.n AS n_shingles, coalesce(comp.c, k.rep, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, k.rep, d.doc_id) AS kept
FROM sized d LEFT JOIN classes k ON d.n > 0 AND d.s = k.s LEFT JOIN comp ON comp.node = k.rep
"""
