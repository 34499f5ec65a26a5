"""Aggregations of the user's own: a function over each task's rows, then a grouped combination of its states."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame


def custom_aggregate(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], pd.DataFrame], schema: str, keys: Sequence[str], combine: Sequence[Column]) -> DataFrame:
    """``partial`` turns the frames of one task into a frame of states (``schema``); ``combine`` aggregates the states of
    each key.  Only states are shuffled, so a task's memory is bounded by its own keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = partial(frames)
        if not len(out):
            return  # a task without rows has no state
        # strings put together from several frames may be held in chunks, which Arrow batches do not take
        held = {c: object for c in out.columns if pd.api.types.is_extension_array_dtype(out[c].dtype)}
        yield out.astype(held).reset_index(drop=True)

    states = df.mapInPandas(run, schema)
    return (states.groupBy(*keys) if keys else states.groupBy()).agg(*combine)
