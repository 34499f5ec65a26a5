"""Many histograms in one pass over the data.

Each row gives an array of (histogram, flat bin, weight), which is exploded and summed by (histogram, bin): one scan
and one shuffle of partial sums, however many histograms there are.  Worth it for scalar fills; tensor weights have a
pass of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.operators.histogram import Histogram, index_name
from fillwise.plans.axes import Axis, named
from fillwise.plans.storage import storage_of


@dataclass(frozen=True)
class Fill:
    """One histogram to book: scalar columns, coordinates first, then weights."""

    name: str
    axes: Sequence[Axis]
    cols: Sequence[str]
    storage: str = "weight"


@dataclass(frozen=True)
class Book:
    """Fills of one table that are to share one pass; a result for the dataset runner."""

    df: DataFrame
    fills: Sequence[Fill]


def fuse(df: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """(hist, flat, value, variance) of all fills; ``flat`` is the C-order bin number with flow bins."""
    if not fills:
        raise ValueError("nothing to fill")
    names = [f.name for f in fills]
    if len(set(names)) != len(names):
        raise ValueError("histogram names are distinct")
    entries = []
    for k, f in enumerate(fills):
        axes = named(f.axes)
        flat = F.lit(0).cast("long")
        ok = []
        for a, c in zip(axes, f.cols):
            i = a.index(F.col(f"`{c}`"))
            ok.append(a.inside(i))
            flat = flat * a.extent + (i - a.first)
        weights = [F.col(f"`{c}`").cast("double") for c in f.cols[len(axes) :]]
        weight = reduce(mul, weights) if weights else F.lit(1.0)
        entries.append(F.when(reduce(and_, ok) & weight.isNotNull(), F.struct(F.lit(k).alias("hist"), flat.alias("flat"), weight.alias("w"))))
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.hist", "e.flat", "e.w")
    return rows.groupBy("hist", "flat").agg(F.sum("w").alias("value"), F.sum(F.col("w") * F.col("w")).alias("variance"))


def split(fused: DataFrame, fills: Sequence[Fill]) -> list[Histogram]:
    """The single histograms of a fused result (persist it before if more than one is read)."""
    out = []
    for k, f in enumerate(fills):
        axes, storage = named(f.axes), storage_of(f.storage)
        data, stride = fused.where(F.col("hist") == k), 1
        columns = []
        for a in reversed(axes):
            columns.insert(0, (F.floor(F.col("flat") / stride) % a.extent + a.first).cast("int").alias(index_name(a)))
            stride *= a.extent
        value = F.col("value").cast("long") if storage.name == "int64" else F.col("value")
        out.append(Histogram(f.name, axes, storage, data.select(*columns, value.alias("value"), *(["variance"] if storage.variance else []))))
    return out
