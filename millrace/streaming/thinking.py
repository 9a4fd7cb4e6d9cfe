"""Reasoning traces cut out of token streams, in a batch and in a stream.

The state of a stream is one flag: inside a trace or not. A tag counts only
where one delta holds all of it, and only in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN, CLOSE = "<think>", "</think>"
OUT = "stream_id long, seq long, text string"


def step(inside: bool, delta: str) -> tuple[bool, str]:
    """What of a delta is outside of traces, and the flag after it."""
    out = []
    while delta:
        tag = CLOSE if inside else OPEN
        before, found, rest = delta.partition(tag)
        if not inside:
            out.append(before)
        if not found:
            break
        inside, delta = not inside, rest
    return inside, "".join(out)


class ThinkStripper(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("inside", "inside boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        inside = bool(self.flag.get()[0]) if self.flag.exists() else False
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, delta in zip(batch["seq"], batch["delta"]):
            inside, text = step(inside, delta or "")
            if text:
                out.append((key[0], seq, text))
        self.flag.update((inside,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    def close(self) -> None:
        pass


def strip_stream(deltas: DataFrame) -> DataFrame:
    """Deltas (stream_id, seq, delta) of a streaming DataFrame without their traces."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("stream_id", LongType()), StructField("seq", LongType()), StructField("text", StringType())])
    return deltas.groupBy("stream_id").transformWithStateInPandas(ThinkStripper(), schema, "Append", "None")


def strip_batch(deltas: DataFrame) -> DataFrame:
    """The same for a table. Rows stream by in order, one flag in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, inside = None, False
        for b in batches:
            out = []
            for s, seq, delta in zip(b["stream_id"], b["seq"], b["delta"]):
                if s != stream:
                    stream, inside = s, False
                inside, text = step(inside, delta or "")
                if text:
                    out.append((s, seq, text))
            yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    ordered = deltas.repartition("stream_id").sortWithinPartitions("stream_id", "seq").select("stream_id", "seq", "delta")
    return ordered.mapInPandas(run, OUT)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time, for a table or a stream; ours, no parity."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
