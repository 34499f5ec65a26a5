"""Shift and smear reweighting of histograms.

The weight of a row estimates, to second order, how a bin's content changes if its values were shifted or smeared.
With u the place in the bin (-1/2 to 1/2), d the shift and v the smear in units of the bin width:

    weight = (1 + sum(-12 d u - 12 v**2) + (sum(12 v u))**2) * nominal

over the continuous axes.  In flow bins the width is infinite, so the weight stays.  A discrete axis allows no change:
a changed value gives NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.functions.arrays import is_container
from fillwise.operators.histogram import Histogram, histogram
from fillwise.plans.axes import Axis, widths_and_centres


def shift_weight(axes: Sequence[Axis], original: Sequence[Column], shifted: Sequence[Column], smeared: Sequence[Column], nominal: Column | None = None) -> Column:
    """The weight as an expression of scalar columns."""
    first: Column = F.lit(0.0)
    second: Column = F.lit(0.0)
    for axis, x, xs, xv in zip(axes, original, shifted, smeared):
        if axis.continuous:
            x, xs, xv = x.cast("double"), xs.cast("double"), xv.cast("double")
            inside, width, centre = widths_and_centres(axis, x)
            u, d, v = (x - centre) / width, (xs - x) / width, (xv - x) / width
            first = first + F.when(inside, -12.0 * d * u - 12.0 * v * v).otherwise(0.0)
            second = second + F.when(inside, 12.0 * v * u).otherwise(0.0)
        else:
            same = x.eqNullSafe(xs) & x.eqNullSafe(xv)
            first = first + F.when(same, 0.0).otherwise(float("nan"))
    weight = 1.0 + first + second * second
    return weight if nominal is None else weight * nominal


def with_shift_weight(df: DataFrame, name: str, axes: Sequence[Axis], original: Sequence[str], shifted: Sequence[str] | None = None, smeared: Sequence[str] | None = None, nominal: str | None = None, tensor: bool = False) -> DataFrame:
    """``df`` with the weight.  Arrays are weighted element by element; with ``tensor``, shifted and smeared values may
    hold one more level of nesting (a tensor for each value), which the weight then has too."""
    shifted, smeared = shifted or original, smeared or original
    k = len(axes)
    cols = [*original, *shifted, *smeared, *([nominal] if nominal else [])]
    plain = [F.col(f"`{c}`") for c in cols]

    def weight(*x: Column) -> Column:
        return shift_weight(axes, x[:k], x[k : 2 * k], x[2 * k : 3 * k], x[3 * k] if nominal else None)

    if tensor:
        nested = [_depth(df, c) for c in cols]
        top = max(nested)

        def over(values: list[Column], depths: list[int], level: int) -> Column:
            if level == 0:
                return weight(*values)
            deep = [i for i, d in enumerate(depths) if d == level]
            zipped = F.arrays_zip(*(values[i].alias(f"a{i}") for i in deep))
            return F.transform(zipped, lambda e: over([e[f"a{i}"] if i in deep else v for i, v in enumerate(values)], [d - 1 if i in deep else d for i, d in enumerate(depths)], level - 1))

        # values of the outer level first: a scalar or array meets each tensor of its place
        if top == 2:
            outer = F.arrays_zip(*(p.alias(f"a{i}") for i, p in enumerate(plain) if nested[i] >= 1))

            def row(e: Column) -> Column:
                values = [e[f"a{i}"] if nested[i] >= 1 else p for i, p in enumerate(plain)]
                return over(values, [max(0, d - 1) for d in nested], 1)

            return df.withColumn(name, F.transform(outer, row))
        return df.withColumn(name, over(plain, nested, top))
    containers = [is_container(df, c) for c in cols]
    if not any(containers):
        return df.withColumn(name, weight(*plain))
    zipped = F.arrays_zip(*(p.alias(f"a{i}") for i, p in enumerate(plain) if containers[i]))
    return df.withColumn(name, F.transform(zipped, lambda e: weight(*(e[f"a{i}"] if containers[i] else p for i, p in enumerate(plain)))))


def _depth(df: DataFrame, name: str) -> int:
    kind, depth = df.schema[name].dataType, 0
    while hasattr(kind, "elementType"):
        kind, depth = kind.elementType, depth + 1
    return depth


def shifted_histogram(df: DataFrame, name: str, axes: Sequence[Axis], original: Sequence[str], shifted: Sequence[str] | None = None, smeared: Sequence[str] | None = None, nominal: str | None = None, **options) -> Histogram:
    """The histogram of the original columns, reweighted as if they were shifted and smeared."""
    column = f"{name}_shifted_weight"
    return histogram(with_shift_weight(df, column, axes, original, shifted, smeared, nominal), name, axes, [*original, column], **options)
