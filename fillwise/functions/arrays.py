"""Functions over arrays and tensors as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mask(arrays: dict[str, Column], predicate: Callable[[dict[str, Column]], Column]) -> Column:
    """An array of booleans from a predicate over parallel arrays, element by element."""
    names = list(arrays)
    zipped = F.arrays_zip(*(arrays[n].alias(n) for n in names))
    return F.transform(zipped, lambda e: predicate({n: e[n] for n in names}))


def count_true(m: Column) -> Column:
    """How many elements of a mask hold."""
    return F.size(F.filter(m, lambda x: x))


def masked(values: Column, m: Column) -> Column:
    """The elements at which the mask holds."""
    return F.filter(values, lambda _, i: F.get(m, i))


def element(values: Column, i: int = 0) -> Column:
    """Element i, null beyond the end."""
    return F.get(values, F.lit(i))


def sign_weight(weight: Column) -> Column:
    """1 with the sign of the weight; -0.0 and NaN count as positive."""
    return F.when(weight.isNull(), None).when(weight < 0, -1.0).otherwise(1.0)


def map_over(function: Callable[..., Column], *args: Column, containers: Sequence[bool]) -> Column:
    """``function`` over arguments of which some are arrays: element by element, scalars repeated, up to the shortest.

    Without a container, ``function`` of the scalars."""
    lists = [a for a, c in zip(args, containers) if c]
    if not lists:
        return function(*args)
    shortest = F.least(*(F.size(a) for a in lists)) if len(lists) > 1 else F.size(lists[0])
    zipped = F.arrays_zip(*(F.slice(a, F.lit(1), shortest).alias(f"a{i}") for i, a in enumerate(lists)))

    def one(e: Column) -> Column:
        at = iter(range(len(lists)))
        return function(*(e[f"a{next(at)}"] if c else a for a, c in zip(args, containers)))

    return F.transform(zipped, one)


def tensor_map(function: Callable[..., Column], tensor: Column, *scalars: Column) -> Column:
    """``function(x, *scalars)`` of each element of a tensor; the shape stays."""
    return F.transform(tensor, lambda x: function(x, *scalars))


def is_container(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def define(df: DataFrame, name: str, function: Callable[..., Column], cols: Sequence[str]) -> DataFrame:
    """``df`` with ``name`` = ``function`` of the columns, element by element where some are arrays."""
    column = map_over(function, *(F.col(f"`{c}`") for c in cols), containers=[is_container(df, c) for c in cols])
    return df.withColumn(name, column)


def where(df: DataFrame, function: Callable[..., Column], cols: Sequence[str]) -> DataFrame:
    """The rows for which ``function`` of the columns holds."""
    return df.where(function(*(F.col(f"`{c}`") for c in cols)))
