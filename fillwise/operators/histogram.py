"""N-dimensional histograms as grouped sums over bin indices.

A fill is one projection (values to indices) and one hash aggregation with map-side sums: at most one row per bin and
task is shuffled.  The result is in long form, a row per filled bin; ``densify`` adds the empty ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwise.plans.axes import Axis, Integer, Regular, Variable, named, total_bins
from fillwise.plans.storage import Storage, storage_of

#: Elements of a tensor weight up to which each is a sum of its own; longer ones are exploded.
WIDE = 128


def index_name(axis: Axis) -> str:
    return f"{axis.name}_idx"


@dataclass
class Histogram:
    """Axes, storage and the filled bins: columns ``<axis>_idx``, value and, for weight storage, variance."""

    name: str
    axes: list[Axis]
    storage: Storage
    data: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def index_columns(self) -> list[str]:
        return [index_name(a) for a in self.axes]

    def densify(self, flow: bool = True) -> DataFrame:
        """A row for every bin, in C order of ``flat``; bins that were not filled hold 0."""
        spark = self.data.sparkSession
        grid, stride = spark.range(total_bins(self.axes, flow)).withColumnRenamed("id", "flat"), total_bins(self.axes, flow)
        for a in self.axes:
            size, first = (a.extent, a.first) if flow else (a.n, 0)
            stride //= size
            grid = grid.withColumn(index_name(a), (F.floor(F.col("flat") / stride) % size + first).cast("int"))
        zero = F.lit(0).cast("long") if self.storage.name == "int64" else F.lit(0.0)
        joined = grid.join(self.data, self.index_columns, "left")
        return joined.select("flat", *self.index_columns, *(F.coalesce(F.col(c), zero).alias(c) for c in self.storage.columns))

    def nnz(self) -> int:
        return self.data.count()

    def project(self, *names: str) -> Histogram:
        """Sum over all axes but the named ones, flow bins included."""
        by = {a.name: a for a in self.axes}
        missing = [n for n in names if n not in by]
        if missing:
            raise ValueError(f"no such axes: {missing}")
        kept = [by[n] for n in names]
        data = self.data.groupBy(*map(index_name, kept)).agg(*(F.sum(c).alias(c) for c in self.storage.columns))
        return Histogram(self.name, kept, self.storage, data, self.metadata)

    def to_numpy(self, flow: bool = True) -> dict[str, np.ndarray]:
        """Arrays of the bins' contents.  Collects one row per filled bin."""
        rows = self.data.toPandas()
        shape = [a.extent if flow else a.n for a in self.axes]
        out = {c: np.zeros(shape, np.int64 if self.storage.name == "int64" else float) for c in self.storage.columns}
        at = [rows[c].to_numpy(int) - (a.first if flow else 0) for c, a in zip(self.index_columns, self.axes)]
        keep = np.ones(len(rows), bool)
        for i, n in zip(at, shape):
            keep &= (i >= 0) & (i < n)
        for c in out:
            out[c][tuple(i[keep] for i in at)] = rows[c].to_numpy()[keep]
        return out

    def equals(self, other: Histogram) -> bool:
        """Whether the same bins hold the same contents."""
        columns = [*self.index_columns, *self.storage.columns]
        a, b = self.data.select(*columns), other.data.select(*columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def tensor_shape(field_: T.StructField) -> tuple[int, ...] | None:
    shape = (field_.metadata or {}).get("tensor_shape")
    return tuple(shape) if shape else None


def with_tensor_shape(column: Column, name: str, shape: Sequence[int]) -> Column:
    """The column, marked as a tensor of fixed shape (flattened, last dimension fastest)."""
    return column.alias(name, metadata=json.loads(json.dumps({"tensor_shape": list(shape)})))


def _tensor_axes(shape: tuple[int, ...], given: Sequence[Axis | str] | None) -> list[Axis]:
    out: list[Axis] = []
    for i, size in enumerate(shape):
        one = given[i] if given and i < len(given) else None
        if isinstance(one, Axis):
            if one.extent != size:
                raise ValueError(f"tensor axis {i} has {one.extent} bins, the tensor {size}")
            out.append(one)
        else:
            out.append(Integer(one or f"tensor_axis_{i}", False, False, 0, size))
    return out


def fill_rows(df: DataFrame, axes: Sequence[Axis], cols: Sequence[str], tensors: dict[str, tuple[int, ...]]) -> tuple[DataFrame, list[str], list[str], str | None]:
    """One row per fill: index columns, weight columns, tensor column.  Containers are unrolled element by element."""
    fields = {f.name: f for f in df.schema}
    tensor = [c for c in cols if c in tensors]
    if len(tensor) > 1:
        raise NotImplementedError("one tensor weight at most")
    if any(c in tensors for c in cols[: len(axes)]):
        raise NotImplementedError("tensors are weights, not coordinates")

    def container(c: str) -> bool:
        kind = fields[c].dataType
        if c in tensors:
            return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
        return isinstance(kind, T.ArrayType)

    lists = [c for c in dict.fromkeys(cols) if container(c)]
    if lists:
        sizes = [F.size(F.col(f"`{c}`")) for c in lists]
        same = reduce(and_, (s == sizes[0] for s in sizes[1:]), F.lit(True))
        message = F.lit("containers of different lengths in one fill")
        zipped = F.when(same, F.arrays_zip(*(F.col(f"`{c}`") for c in lists))).otherwise(F.raise_error(message))
        rest = [F.col(f"`{c}`") for c in dict.fromkeys(cols) if c not in lists]
        df = df.select(*rest, F.explode(zipped).alias("_e")).select(*rest, *(F.col("_e")[c].alias(c) for c in lists))
    names = [index_name(a) for a in axes]
    weights = [c for c in cols[len(axes) :] if c not in tensors]
    select = [a.index(F.col(f"`{c}`")).alias(n) for a, c, n in zip(axes, cols, names)]
    select += [F.col(f"`{c}`").cast("double").alias(f"_w{i}") for i, c in enumerate(weights)]
    select += [F.col(f"`{tensor[0]}`").alias("_t")] if tensor else []
    rows = df.select(*select)
    keep = reduce(and_, (a.inside(F.col(n)) for a, n in zip(axes, names)), F.lit(True))
    for i in range(len(weights)):
        keep = keep & F.col(f"_w{i}").isNotNull()
    if tensor:
        keep = keep & F.col("_t").isNotNull()
    return rows.where(keep), names, [f"_w{i}" for i in range(len(weights))], tensor[0] if tensor else None


def histogram(df: DataFrame, name: str, axes: Sequence[Axis], cols: Sequence[str], storage: str | Storage = "weight", tensor_axes: Sequence[Axis | str] | None = None, tensors: dict[str, Sequence[int]] | None = None, metadata: dict | None = None) -> Histogram:
    """Fill a histogram.  The first ``len(axes)`` columns are coordinates; the product of all others is the weight.

    A weight column marked as a tensor (``with_tensor_shape``, or its shape in ``tensors``) adds one axis per dimension."""
    storage = storage_of(storage)
    axes = named(axes)
    if len(cols) < len(axes):
        raise RuntimeError("fewer columns than axes")
    shapes = {f.name: tensor_shape(f) for f in df.schema if tensor_shape(f)} | {k: tuple(v) for k, v in (tensors or {}).items()}
    shapes = {k: v for k, v in shapes.items() if k in cols}
    rows, keys, weights, tensor = fill_rows(df, axes, list(cols), shapes)
    weight = reduce(mul, (F.col(w) for w in weights)) if weights else None
    if tensor is None:
        return Histogram(name, list(axes), storage, rows.groupBy(*keys).agg(*storage.aggregates(weight)), metadata or {})
    if storage.name not in ("double", "weight"):
        raise NotImplementedError("tensor weights take double or weight storage")
    shape = shapes[tensor]
    size = int(np.prod(shape))
    extra = _tensor_axes(shape, tensor_axes)
    if size <= WIDE:
        rows = rows.select(*keys, *((F.get("_t", F.lit(i)).cast("double") * (weight if weight is not None else F.lit(1.0))).alias(f"_x{i}") for i in range(size)))
        sums = [F.array(*(F.coalesce(F.sum(f"_x{i}"), F.lit(0.0)) for i in range(size))).alias("value")]
        if storage.variance:
            sums.append(F.array(*(F.coalesce(F.sum(F.col(f"_x{i}") * F.col(f"_x{i}")), F.lit(0.0)) for i in range(size))).alias("variance"))
        data = rows.groupBy(*keys).agg(*sums)
        data = data.select(*keys, F.posexplode(F.arrays_zip(*storage.columns)).alias("_pos", "_v")).select(*keys, "_pos", *(F.col("_v")[c].alias(c) for c in storage.columns))
    else:
        rows = rows.select(*keys, *weights, F.posexplode("_t").alias("_pos", "_x"))
        one = F.col("_x").cast("double") * weight if weight is not None else F.col("_x").cast("double")
        data = rows.groupBy(*keys, "_pos").agg(*storage.aggregates(one))
    stride = size
    tail = []
    for a, dim in zip(extra, shape):
        stride //= dim
        tail.append((F.floor(F.col("_pos") / stride) % dim + a.first).cast("int").alias(index_name(a)))
    all_axes = named([*axes, *extra])
    return Histogram(name, all_axes, storage, data.select(*keys, *tail, *storage.columns), metadata or {})


def sum_and_count(df: DataFrame, col: str) -> DataFrame:
    """(sum, count) of a column in one pass."""
    return df.agg(F.sum(col).alias("sum"), F.count(F.lit(1)).alias("count"))


# --- models: (name, title, bins, ...) ------------------------------------------------------------------------------


def axis_of_model(name: str, bins: int | Sequence[float], lo: float | None = None, hi: float | None = None) -> Axis:
    """An axis with flow bins from a number of bins and a range, or from edges."""
    if isinstance(bins, int):
        return Regular(name, True, True, bins, lo, hi)
    return Variable(name, True, True, tuple(bins))


def histo_nd(df: DataFrame, model: tuple, cols: Sequence[str], **options) -> Histogram:
    """``model``: (name, title, dimensions, bins, lows, highs) or (name, title, dimensions, bins, edges).

    Bins are numbers; an entry of ``edges`` that is not empty makes its axis variable.  Weight storage."""
    name, _, dim, bins, *rest = model
    axes = []
    for i in range(dim):
        if len(rest) == 2:
            axes.append(Regular(f"axis_{i}", True, True, bins[i], rest[0][i], rest[1][i]))
        else:
            edges = rest[0][i]
            axes.append(Variable(f"axis_{i}", True, True, tuple(edges)))
    return histogram(df, name, axes, cols, "weight", **options)


def _flat_model(model: tuple, dim: int) -> list[Axis]:
    """Axes from a flat tuple after name and title: n, lo, hi or n, edges for each dimension."""
    rest, axes = list(model[2:]), []
    for i in range(dim):
        n = rest.pop(0)
        if rest and isinstance(rest[0], (list, tuple, np.ndarray)):
            axes.append(Variable(f"axis_{i}", True, True, tuple(rest.pop(0))))
        else:
            axes.append(Regular(f"axis_{i}", True, True, n, rest.pop(0), rest.pop(0)))
    return axes


def histo_1d(df: DataFrame, model: tuple, v: str, w: str | None = None, **options) -> Histogram:
    return histogram(df, model[0], _flat_model(model, 1), [v, *([w] if w else [])], "weight", **options)


def histo_2d(df: DataFrame, model: tuple, v0: str, v1: str, w: str | None = None, **options) -> Histogram:
    return histogram(df, model[0], _flat_model(model, 2), [v0, v1, *([w] if w else [])], "weight", **options)


def histo_3d(df: DataFrame, model: tuple, v0: str, v1: str, v2: str, w: str | None = None, **options) -> Histogram:
    return histogram(df, model[0], _flat_model(model, 3), [v0, v1, v2, *([w] if w else [])], "weight", **options)
