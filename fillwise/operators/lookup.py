"""Lookups: certified intervals, keyed values, bin contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.operators.histogram import Histogram, index_name

#: Rows up to which a lookup table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it is known to be small (``limit`` keeps the check itself bounded)."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def filter_intervals(df: DataFrame, intervals: DataFrame, run: str = "run", lumi: str = "lumi", bypass: int | None = 1) -> DataFrame:
    """Rows whose (run, lumi) lies in an interval of ``intervals`` (run, first, last); the run ``bypass`` passes always.

    One row per run holds all its intervals, so the join never multiplies rows.  A null run or lumi fails."""
    per_run = intervals.where(F.col("run").isNotNull()).groupBy(F.col("run").alias("_run")).agg(F.collect_set(F.struct("first", "last")).alias("_iv"))
    x = F.col(f"`{lumi}`")
    hit = F.exists("_iv", lambda p: (p["first"] <= x) & (x <= p["last"]))
    if bypass is not None:
        hit = (F.col(f"`{run}`") == bypass) | hit
    joined = df.join(small(per_run), F.col(f"`{run}`") == F.col("_run"), "left")
    return joined.where(hit).drop("_run", "_iv")


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], value: str, name: str, order: str | None = None, missing: str = "lookup: key not found") -> DataFrame:
    """``df`` with ``name`` = the table's value for its keys (column of df -> column of table).

    Of rows with one key the first by ``order`` counts.  A key that the table lacks raises when its value is used."""
    t = list(keys.values())
    pick = F.min_by(F.col(value), F.col(order)) if order else F.first(value)
    unique = table.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(t))).agg(pick.alias("_v"), F.lit(True).alias("_found"))
    on = [F.col(f"`{c}`") == F.col(f"_k{i}") for i, c in enumerate(keys)]
    found = df.join(small(unique), on, "left")
    column = F.when(F.col("_found"), F.col("_v")).otherwise(F.raise_error(F.lit(missing)))
    return found.withColumn(name, column).drop("_v", "_found", *(f"_k{i}" for i in range(len(t))))


def histogram_value(df: DataFrame, hist: Histogram, cols: Sequence[str], name: str, column: str = "value") -> DataFrame:
    """``df`` with the content of the bin in which its coordinates lie (0 in a bin that was not filled, null outside)."""
    if len(cols) != len(hist.axes):
        raise ValueError("one column per axis")
    keys = [f"_i{i}" for i in range(len(cols))]
    out = df.select("*", *(a.index(F.col(f"`{c}`")).alias(k) for a, c, k in zip(hist.axes, cols, keys)))
    table = hist.data.select(*(F.col(index_name(a)).alias(f"_b{i}") for i, a in enumerate(hist.axes)), F.col(column).alias("_v"))
    out = out.join(small(table), [F.col(k) == F.col(f"_b{i}") for i, k in enumerate(keys)], "left")
    inside: Column = F.lit(True)
    for a, k in zip(hist.axes, keys):
        inside = inside & a.inside(F.col(k))
    zero = F.lit(0.0)
    return out.withColumn(name, F.when(inside, F.coalesce("_v", zero))).drop("_v", *keys, *(f"_b{i}" for i in range(len(cols))))


def tensor_payload(hist: Histogram, rank: int) -> DataFrame:
    """The last ``rank`` axes as one array per bin of the others, C order with flow bins: columns index..., value, variance."""
    if rank and hist.storage.name not in ("double", "weight"):
        raise NotImplementedError("tensor payloads take double or weight storage")
    lead, tail = hist.axes[: len(hist.axes) - rank], hist.axes[len(hist.axes) - rank :]
    size = 1
    pos = F.lit(0)
    for a in tail:
        pos = pos * a.extent + (F.col(index_name(a)) - a.first)
        size *= a.extent
    keys = [index_name(a) for a in lead]
    filled = hist.data.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.struct(pos.alias("p"), F.col(c)))).alias(f"_{c}") for c in hist.storage.columns))
    order = F.sequence(F.lit(0), F.lit(size - 1))

    def dense(held: Column) -> Column:
        return F.transform(order, lambda p: F.coalesce(F.element_at(held, p), F.lit(0.0)))

    return filled.select(*keys, *(dense(F.col(f"_{c}")).alias(c) for c in hist.storage.columns))
