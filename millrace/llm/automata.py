"""Substring deduplication with suffix automata.

The references that a text could repeat are the variants around its anchors
(:mod:`millrace.llm.repeats`). Those of one anchor, or of one surrounding of a
frequent anchor, are a reference shard: its automaton is built where the shard
lies, since the corpus's references grow with the corpus and are no broadcast
of bounded size. In the order of the corpus each variant is streamed through
the automaton, whose matching statistics tell which of its windows occurred
before, and is then added to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.repeats import Windows


class SuffixAutomaton:
    """A generalised suffix automaton over integer symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state for the part of ``q`` that ``p`` reaches."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, text: list) -> None:
        last = 0
        for symbol in text:
            if symbol in self.next[last]:
                last = self._split(last, self.next[last][symbol], symbol)
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][symbol], symbol)
            last = new

    def matching(self, text: list) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        out, state, length = [], 0, 0
        for symbol in text:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            to = self.next[state].get(symbol)
            if to is not None:
                state, length = to, length + 1
            out.append(length)
        return out


#: States of an automaton beyond which a new one is begun for the same shard.
STATES = 200_000


def first_seen(variants: DataFrame, windows: Windows) -> DataFrame:
    """d1, d2 and masks: windows of each variant that an earlier one of its shards holds.

    The symbols of the automata are the words themselves."""

    def run(batches):
        shard, automata = None, []
        for b in batches:
            out = []
            for s, d1, d2, n, body in zip(*(b.column(i).to_pylist() for i in range(5))):
                if s != shard:
                    shard, automata = s, [SuffixAutomaton()]
                text = body.split(b" ")
                flags = np.zeros(n, dtype=np.uint8)
                for one in automata:
                    if len(one.size) > 1:
                        flags |= np.array(one.matching(text)[windows.length - 1 :]) >= windows.length
                if flags.any():
                    out.append((d1, d2, np.packbits(flags).tobytes()))
                if not flags.all():
                    if len(automata[-1].size) > STATES:
                        automata.append(SuffixAutomaton())
                    automata[-1].add(text)
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["d1", "d2", "mask"])

    # an anchor's only snippet has nothing to be held against
    met = variants.repartition("shard").sortWithinPartitions("shard", "last", "key", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), "at")
    marks = met.select("shard", "d1", "d2", "n", "body").mapInArrow(run, "d1 long, d2 int, mask binary")
    return marks.groupBy("d1", "d2").agg(F.collect_list("mask").alias("masks"))  # two at most


def dedupe(documents: DataFrame, length: int = 20, k: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (spans of words) of every row.

    A word goes if a window of ``length`` words that covers it starts earlier
    too: in a smaller doc_id, or earlier in this document. A null text has no
    words. Rows that agree in doc_id and text count as one document and are
    judged alike; other rows of one doc_id follow each other by a checksum of
    their texts; rows without doc_id come last, by a hash of theirs. Equal snippets are told
    by 96-bit digests, all others by their words. Other columns are not read.
    """
    windows = Windows("word", length, k)
    docs = repeats.keyed(documents)
    bodies = docs.repartition("key")
    found = repeats.repeated(docs, windows)
    masks = first_seen(repeats.variant_texts(bodies, found.where("variants > 1"), windows), windows)
    rows = found.join(masks, ["d1", "d2"], "left")
    none = F.array(F.lit(b"\0" * -(-(length - k + 1) // 8)))
    verdicts = rows.where("times > 1 or masks is not null").select(
        "d1", "d2", "n", "times", F.col("key").alias("keep_key"), F.col("at").alias("keep_at"), F.coalesce("masks", none).alias("masks")
    )

    out = repeats.judged(docs, bodies, verdicts, windows)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", "removed")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h, md5(array_to_string(w[i:i + 19], ' ')) AS m FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE nth > 1),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(coalesce(gone, []), z[2])), lambda z: z[1]), ' ')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""
