"""Substring deduplication by merging Burrows-Wheeler transforms.

The texts that may repeat are the snippets around the corpus's repeated anchors
(:mod:`millrace.llm.repeats`). They are dealt to small shards, the j-th variant
of an anchor to the j-th shard, and each shard gets a transform of its own: its
rows in the order of what follows them, and the letter before each row.

Transforms are merged as by Holt and McMillan (2014). The interleave, which
says for each place of the merged order from which shard it comes, starts as
one shard behind the other and is refined step by step: a step reads the
shards' letters in the present interleave and deals the places out to them,
stably, which orders all suffixes by one letter more. Only letters and shard
numbers move; no suffix is compared with another or sorted anew. Where two
neighbours first part, the common prefix ends: places that the steps never part
share ``length`` symbols, and such intervals are the repeated windows. Sixteen
symbols in a row are one letter of a larger alphabet, so ``length`` symbols
take few steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.repeats import Windows

#: Bytes of snippets that are merged at once, beyond an anchor's own, and shards they are dealt to.
BATCH, SHARDS = 1 << 16, 6


class Alphabet:
    """The letters of some texts: for runs of 1, 8 and 16 symbols before each
    position their ranks among all texts, and where such a run begins.

    A text is a ring: its end mark (0) stands before its first symbol."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) + 1 for t in texts])
        n, ends = int(self.sizes.sum()), np.cumsum(self.sizes)
        self.first = ends - self.sizes
        text = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        back = np.arange(-1, n - 1, dtype=np.int32)
        back[self.first] = ends - 1
        ahead = np.empty(n, dtype=np.int32)
        ahead[back] = np.arange(n, dtype=np.int32)
        words = text.astype(np.uint64)  # the symbols from each position on, the first one highest
        self.back, self.letters = {1: back}, {1: text}
        for k in (1, 2, 4):
            words = (words << np.uint64(8 * k)) | words[ahead]
            ahead, back = ahead[ahead], back[back]
        names, ranks = np.unique(words, return_inverse=True)
        self._put(8, names, ranks, back)
        names, ranks = np.unique((ranks.astype(np.uint64) << np.uint64(32)) | ranks[ahead].astype(np.uint64), return_inverse=True)
        self._put(16, names, ranks, back[back])
        self.ahead = ahead[ahead]

    def _put(self, k: int, names: np.ndarray, ranks: np.ndarray, back: np.ndarray) -> None:
        self.letters[k], self.back[k] = ranks.astype(np.uint16 if len(names) <= 65536 else np.uint32), back


class Transform:
    """The transform of a shard, some texts of an alphabet: ``rows``, positions in
    the order of what follows them round the ring; before row i stands
    ``letters[k][i]``, for letters of k symbols."""

    def __init__(self, alphabet: Alphabet, texts: np.ndarray):
        size = alphabet.sizes[texts]
        own = np.repeat(alphabet.first[texts] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.zeros(len(alphabet.ahead), dtype=np.int64)
        ranks, ahead, symbols, names = alphabet.letters[16][own].astype(np.int64), alphabet.ahead[own], 16, ()
        # double the symbols that count until all rows are told apart, or can't be: two rings
        # that agree for the sum of their sizes agree for ever
        while symbols < 2 * int(size.max(initial=0)):
            place[own] = ranks
            names, ranks = np.unique(ranks * (len(own) + 65536 * 65536) + place[ahead] if symbols == 16 else ranks * len(own) + place[ahead], return_inverse=True)
            if len(names) == len(own):
                break
            place[own] = ahead
            ahead, symbols = place[ahead], 2 * symbols
        if len(names) == len(own):
            self.rows = np.empty_like(own)
            self.rows[ranks] = own
        else:
            self.rows = own[np.argsort(ranks, kind="stable")]
        self.letters = {k: alphabet.letters[k][alphabet.back[k][self.rows]] for k in (1, 8, 16)}


def by_letter(own: np.ndarray) -> np.ndarray:
    """The stable order of the letters."""
    if own.dtype.itemsize <= 2:
        return np.argsort(own, kind="stable")
    order = np.argsort((own & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((own[order] >> 16).astype(np.uint16), kind="stable")]


def merge(shards: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common): all shards' rows in the order of their next ``length``
    symbols, and how many symbols each shares with the one before it, as far
    as whole steps tell (``length``: all of them)."""
    sizes = [len(s.rows) for s in shards]
    n = sum(sizes)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    letters = {k: np.concatenate([s.letters[k] for s in shards]) for k in (1, 8, 16)}
    common = np.full(n, length, dtype=np.int32)
    common[:1] = 0
    done, interval = 0, np.zeros(n, dtype=np.int32)
    for k in [1] * (length % 8) + [8] * (length // 8 % 2) + [16] * (length // 16):
        read = np.empty(n, dtype=letters[k].dtype)
        read[np.argsort(interleave, kind="stable")] = letters[k]  # each shard's letters in its own order
        order = by_letter(read)
        interleave, own, before = interleave[order], read[order], interval[order]
        part = np.flatnonzero((own[1:] != own[:-1]) | (before[1:] != before[:-1])) + 1
        common[part] = np.minimum(common[part], done)
        done += k
        fresh = np.zeros(n, dtype=np.int32)
        fresh[part] = 1
        interval = np.cumsum(fresh, dtype=np.int32)
        if n and interval[-1] == n - 1:  # all apart: nothing repeats any further
            break
    rows = np.empty(n, dtype=np.int64)
    rows[np.argsort(interleave, kind="stable")] = np.concatenate([s.rows for s in shards])
    return rows, common


def shared(group: list[tuple[int, int, bytes]], deal: list[int], length: int) -> list[np.ndarray]:
    """For each snippet (windows, times, text), dealt to a shard each: its windows that the corpus holds more than once."""
    alphabet = Alphabet([t for _, _, t in group])
    shards = [Transform(alphabet, np.flatnonzero(np.array(deal) == j)) for j in sorted(set(deal))]
    rows, common = merge(shards, length)
    weight = np.zeros(len(rows), dtype=np.int64)
    for at, (n, times, _) in zip(alphabet.first.tolist(), group):
        weight[at : at + n] = times
    interval = np.cumsum(common < length) - 1
    many = np.bincount(interval, weights=weight[rows]) > 1
    marked = np.zeros(len(rows), dtype=bool)
    marked[rows] = many[interval]
    return [marked[at : at + n] for at, (n, _, _) in zip(alphabet.first.tolist(), group)]


def repeated_elsewhere(variants: DataFrame, windows: Windows) -> DataFrame:
    """d1, d2 and masks: windows of each snippet that the corpus holds more than once."""

    def run(batches):
        digests, group, deal, size, shard, nth = {}, [], [], 0, None, 0

        def out():
            rows = [(*d, np.packbits(m).tobytes()) for d, m in zip(digests, shared(group, deal, windows.length)) if m.any()]
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["d1", "d2", "mask"])

        for b in batches:
            for s, d1, d2, n, times, body in zip(*(b.column(i).to_pylist() for i in range(6))):
                if s != shard:
                    if size > BATCH:
                        yield out()
                        digests, group, deal, size = {}, [], [], 0
                    shard, nth = s, 0
                if (d1, d2) in digests:  # it met this batch by its other surroundings
                    continue
                digests[d1, d2] = True
                group.append((n, times, body))
                deal.append(nth % SHARDS)
                nth += 1
                size += len(body) + 1
        if group:
            yield out()

    ordered = variants.repartition("shard").sortWithinPartitions("shard").select("shard", "d1", "d2", "n", "times", "body")
    marks = ordered.mapInArrow(run, "d1 long, d2 int, mask binary")
    return marks.groupBy("d1", "d2").agg(F.collect_list("mask").alias("masks"))  # two at most


def dedupe(documents: DataFrame, length: int = 200, k: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (spans of
    bytes) of every row.

    A UTF-8 byte goes if a window of ``length`` bytes that covers it starts
    anywhere else too, in this document or another; a repeated row is another
    document. A null text has no bytes. Equal snippets are told by 96-bit
    digests, all others by their bytes. Other columns are not read.
    """
    windows = Windows("byte", length, k)
    docs = repeats.keyed(documents)
    bodies = docs.repartition("key")
    found = repeats.repeated(docs, windows)
    # where an anchor has one snippet only there is nothing to merge: all its windows occur as often as it does
    masks = repeated_elsewhere(repeats.variant_texts(bodies, found.where("variants > 1"), windows), windows)
    nowhere = F.lit(None).cast("long")
    rows = found.select("d1", "d2", "n", "times").join(masks, ["d1", "d2"], "left").where("times > 1 or masks is not null")
    verdicts = rows.select("d1", "d2", "n", "times", nowhere.alias("keep_key"), nowhere.alias("keep_at"), F.when(F.col("times") == 1, F.col("masks")).alias("masks"))

    return repeats.judged(docs, bodies, verdicts, windows).withColumnRenamed("n_units", "n_bytes")


ORACLE = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS i, b FROM b WHERE octet_length(b) >= 200),
g AS (SELECT doc_id, i, md5_number(b[i:i + 199]) AS m FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, i + 199 AS z, max(i + 199) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
p AS (SELECT doc_id, i, z, sum(CASE WHEN before IS NULL OR i > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
q AS (SELECT doc_id, span, min(i) AS a, max(z) AS z FROM p GROUP BY doc_id, span),
k AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM q GROUP BY doc_id),
t AS (SELECT b.doc_id, b.b, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 list_zip(list_concat([0], coalesce(z, [])), list_concat(coalesce(a, []), [octet_length(b.b) + 1])) AS gaps FROM b LEFT JOIN k USING (doc_id))
SELECT doc_id, octet_length(b) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
 sha256(unhex(array_to_string(list_transform(gaps, lambda x: hex(b[x[1] + 1:x[2] - 1])), ''))) AS kept_sha256 FROM t
"""
