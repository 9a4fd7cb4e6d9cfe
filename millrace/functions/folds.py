"""Folds over an array that tell the state at every item.

An array can't be appended to without copying it, so a fold that appended one
state for each of n items would take n ** 2 / 2 copies. Here the items are taken
in about sqrt(n) chunks, which makes it n ** 1.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def states(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each item; ``items`` must be a column that is there, as it is read for each chunk."""
    n = F.size(items)
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    chunks = F.transform(numbers, lambda i: F.slice(items, i * chunk + 1, chunk))
    none = F.slice(F.array(zero), 1, 0)

    def inner(at: Column, c: Column) -> Column:
        return F.aggregate(
            c, F.struct(at.alias("at"), none.alias("out")),
            lambda a, x: let(step(a["at"], x), lambda s: F.struct(s.alias("at"), F.concat(a["out"], F.array(s)).alias("out"))),
        )

    parts = F.aggregate(
        chunks, F.struct(zero.alias("at"), F.slice(F.array(none), 1, 0).alias("out")),
        lambda a, c: let(inner(a["at"], c), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))),
        lambda a: a["out"],
    )
    return F.flatten(parts)
