"""Matrix accumulators as grouped sums over (i, j)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric(df: DataFrame, i: str, j: str, value: str, n: int | None = None) -> DataFrame:
    """(i, j, value) with i <= j: entries (i, j) and (j, i) are one cell.  With ``n``, also the packed id of the triangle."""
    a, b = F.col(f"`{i}`"), F.col(f"`{j}`")
    out = df.where(a.isNotNull() & b.isNotNull()).groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.sum(f"`{value}`").alias("value"))
    if n is None:
        return out
    packed = F.col("i") * n - F.floor(F.col("i") * (F.col("i") - 1) / 2) + F.col("j") - F.col("i")
    return out.withColumn("packed", packed.cast("long"))


def symmetric_row(cells: DataFrame, row: int, n: int) -> DataFrame:
    """(j, value) of one row of the upper triangle: zeros before the diagonal and in cells that were not filled."""
    grid = cells.sparkSession.range(n).withColumnRenamed("id", "j")
    mine = cells.where(F.col("i") == row).select(F.col("j").cast("long").alias("j"), "value")
    return grid.join(mine, "j", "left").select("j", F.coalesce("value", F.lit(0.0)).alias("value"))


def sparse_matrix(df: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """(i, j, value) in coordinate form.  A zero entry makes no cell; entries that cancel leave an explicit zero."""
    a, b, v = F.col(f"`{i}`"), F.col(f"`{j}`"), F.col(f"`{value}`")
    return df.where(a.isNotNull() & b.isNotNull() & (v != 0)).groupBy(a.alias("i"), b.alias("j")).agg(F.sum(v).alias("value"))


def insert_if_absent(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the first value of each key by ``order``."""
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg(F.min_by(f"`{value}`", f"`{order}`").alias("value"))
