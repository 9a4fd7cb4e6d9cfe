"""Packing documents into as few token sequences as possible, by bin completion.

Only the histogram of piece lengths decides how many sequences are needed and
what each holds, and it has at most ``capacity`` entries at any corpus size.
The search runs on it; documents are then dealt to the places it made.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import vectext as V
from millrace.llm.common import stage
from millrace.llm.tokens import byte_bpe_ids

#: Alternatives of the search that are held at once, each a histogram.
BRANCHES = 200
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Each document's ids with ``end_id`` behind, cut only if longer than
    ``capacity``; then the first piece is the short one."""

    def cut(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(1)):
                rows: list[tuple] = []
                for doc, ids in zip(b.column(0).slice(lo, hi - lo).to_pylist(), byte_bpe_ids(bodies, tokenizer)):
                    ids = np.append(ids, end_id).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return body.mapInArrow(cut, PIECES)


# --- the search ------------------------------------------------------------

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: for each k, pieces over capacity-k stand alone
    among those of k and more (Martello and Toth's L2)."""
    lengths = np.arange(len(counts))
    total = np.cumsum(counts)
    weight = np.cumsum(counts * lengths)
    best = 0
    for k in range(0, capacity // 2 + 1):
        alone = int(total[-1] - total[capacity - k])
        half = int(total[capacity - k] - total[capacity // 2])
        half_weight = int(weight[capacity - k] - weight[capacity // 2])
        small = int(weight[capacity // 2] - (weight[k - 1] if k else 0))
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - half_weight)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: patterns with their multiplicity."""
    left = counts.copy()
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}  # room -> patterns
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            room = int(fits[0]) + length if len(fits) else capacity
            if room == capacity:
                source, have, fresh = (), n, True
            else:
                source, have = open_bins[room].popitem()
                fresh = False
            per = min(room // length, max(1, n // max(1, have))) if fresh else 1
            if fresh:
                per = min(room // length, n)
                used = n // per
            else:
                used = min(have, n)
                if have > used:
                    open_bins[room][source] = have - used
                rooms[room] -= used
            n -= used * per
            pattern, rest = source + (length,) * per, room - length * per
            open_bins.setdefault(rest, {})
            open_bins[rest][pattern] = open_bins[rest].get(pattern, 0) + used
            rooms[rest] += used
    return [(p, n) for at in open_bins.values() for p, n in at.items()]


def fillings(counts: np.ndarray, gap: int, most: int, keep: int, budget: int = 4000) -> list[tuple[int, ...]]:
    """Undominated fillings of ``gap`` from the pieces left, least waste first.

    Pieces are tried from long to short. A filling to which a remaining piece
    could be added is dominated, and so is one whose pieces another filling of
    the same sum has merged into longer ones; of each sum the first found, with
    the longest pieces, stays. Branches that cannot fall below ``most`` waste
    are cut.
    """
    found: dict[int, tuple[int, ...]] = {}
    lengths = np.flatnonzero(counts[: gap + 1])
    steps = 0
    mass = np.concatenate([[0], np.cumsum(counts[: gap + 1] * np.arange(gap + 1))])

    def go(room: int, below: int, used: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        if room not in found or len(used) < len(found[room]):
            at = int(np.searchsorted(lengths, min(room, below), side="right"))
            small = int(lengths[0]) if len(lengths) else gap + 1
            spare = room < small or not any(counts[x] > used.count(int(x)) for x in lengths[: np.searchsorted(lengths, room, side="right")][:4])
            if spare:
                found[room] = used
                if room == 0:
                    return True
        if steps > budget:
            return True
        at = int(np.searchsorted(lengths, min(room, below), side="right"))
        for x in lengths[:at][::-1].tolist():
            if room - int(mass[min(x, room) + 1]) > most:
                break
            if used.count(x) < counts[x] and go(room - x, x, used + (x,)):
                return True
        return False

    go(gap, gap, ())
    return [found[r] for r in sorted(found) if r <= most][:keep]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 3000, keep: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin, how many such bins) that hold every piece.

    The largest piece left is completed by an undominated filling, which is
    used as often as the counts allow. Other fillings are tried depth first
    while the bins used and the lower bound of the rest can beat the incumbent,
    at first the best-fit solution. The first descent always ends with a full
    plan or a proof that it can't beat the incumbent; after ``nodes`` completions
    the incumbent stays. Limits: ``keep`` fillings of a bin, found in 4,000 steps
    (:func:`fillings`), and the BRANCHES latest alternatives.
    """
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    bound = lower_bound(counts, capacity)
    left = nodes

    def go(rest: np.ndarray, used: int, plan: list, first: bool = False) -> bool:
        nonlocal incumbent, best, left
        trail = []
        while True:
            alive = np.flatnonzero(rest)
            if not len(alive):
                if used < best:
                    incumbent, best = plan + trail, used
                return best <= bound
            big = int(alive[-1])
            rest[big] -= 1
            weight = int((rest * np.arange(len(rest))).sum()) + big
            slack = (best - 1 - used) * capacity - weight  # waste that still beats the incumbent
            if slack < 0 or (left <= 0 and not first):
                rest[big] += 1
                return False
            left -= 1
            options = fillings(rest, capacity - big, min(slack, capacity - big), keep)
            rest[big] += 1
            if not options:
                return False
            for other in options[1:]:
                if left <= 0:
                    break
                if used + len(trail) > best - 2 and len(plan) + len(trail) > 400:
                    break
                branches.append((rest.copy(), used, plan + trail, big, other))
            used, step = _apply(rest, used, big, options[0])
            trail.append(step)

    def _apply(rest, used, big, filling):
        pattern = (big, *filling)
        need = np.bincount(pattern, minlength=len(rest))
        at = np.flatnonzero(need)
        times = int((rest[at] // need[at]).min())
        rest[at] -= times * need[at]
        return used + times, (pattern, times)

    branches: list = []
    if best > bound:
        done = go(counts.copy(), 0, [], True)
        while branches and not done and left > 0:
            rest, used, plan, big, filling = branches.pop()
            if used + lower_bound(rest, capacity) >= best:
                left -= 1
                continue
            used, step = _apply(rest, used, big, filling)
            done = go(rest, used, plan + [step])
            del branches[: max(0, len(branches) - BRANCHES)]
    return incumbent


# --- dealing ---------------------------------------------------------------

def pack(parts: DataFrame, capacity: int, salts: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces. Every piece has a place; offsets
    are gapless from 0.

    Pieces of one length are interchangeable. They are numbered by salted
    groups, so that a length which a third of all pieces share is no single
    task's work; the table of places has a row for each length (``capacity``
    at most) and is broadcast.
    """
    spark = parts.sparkSession
    keyed = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    places: dict[int, list[tuple]] = {}
    sequence, taken = 0, np.zeros(capacity + 1, dtype=np.int64)
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            first = int(taken[length])
            places.setdefault(length, []).append((first, first + each * times, each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    assert (taken == counts).all()
    kind = "length long, places array<struct<first:long,stop:long,each:long,sequence:long,offset:long>>"
    deal = spark.createDataFrame([(k, v) for k, v in places.items()], kind)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(base), ["length", "salt"])  # capacity x salts rows at most
        .withColumn("nth", F.col("nth") + F.col("base"))
        .join(F.broadcast(deal), "length")
        .withColumn("p", F.element_at(F.filter("places", lambda p: (p["first"] <= F.col("nth")) & (F.col("nth") < p["stop"])), 1))
    )
    within = F.col("nth") - F.col("p.first")
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p.sequence") + F.floor(within / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset") + F.pmod(within, F.col("p.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null text counts as empty and gives the single id 0; a repeated row is a
    document of its own; null doc_ids stay; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    parts = stage(pieces(docs, tokenizer, capacity), "pieces")
    return pack(parts, capacity)
