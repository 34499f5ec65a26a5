"""Histograms of streams: bins are sums, so each micro-batch only adds to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fillwise.operators.histogram import histogram
from fillwise.plans.axes import Axis, named
from fillwise.plans.storage import storage_of


def streaming_histogram(stream: DataFrame, name: str, axes: Sequence[Axis], cols: Sequence[str], storage: str = "weight", time: str | None = None, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The filled bins of a stream so far; with ``time`` and ``window``, of each window of event time.

    Rows later than ``delay`` behind the latest are dropped once their window is closed."""
    if time is None:
        return histogram(stream, name, axes, cols, storage).data
    axes, kind = named(axes), storage_of(storage)
    rows = stream.withWatermark(time, delay)
    index = [a.index(F.col(f"`{c}`")).alias(f"{a.name}_idx") for a, c in zip(axes, cols)]
    weight = None
    for c in cols[len(axes) :]:
        weight = F.col(f"`{c}`").cast("double") if weight is None else weight * F.col(f"`{c}`").cast("double")
    rows = rows.select(F.col(time), *index, *([weight.alias("_w")] if weight is not None else []))
    for a in axes:
        rows = rows.where(a.inside(F.col(f"{a.name}_idx")))
    if weight is not None:
        rows = rows.where(F.col("_w").isNotNull())
    grouped = rows.groupBy(F.window(time, window), *(f"{a.name}_idx" for a in axes)).agg(*kind.aggregates(F.col("_w") if weight is not None else None))
    return grouped.select(F.col("window.start").alias("window_start"), *(f"{a.name}_idx" for a in axes), *kind.columns)


def to_memory(bins: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run a streaming histogram over what its source holds now, into an in-memory table."""
    return bins.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
