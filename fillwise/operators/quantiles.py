"""Conditional quantile transforms: build edges on data or on a fine histogram, look values up, apply.

Variables are taken one after the other; each is cut within the cells of the condition axes and of the cuts of the
variables before it.  A cell of n rows is cut at ranks rint(f * n) for the edges f of the quantile axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.operators.histogram import Histogram, index_name
from fillwise.functions.arrays import is_container, map_over
from fillwise.operators.lookup import BROADCAST_ROWS, small
from fillwise.plans.axes import Axis, Integer, Regular, named
from fillwise.sources import sinks

#: The largest value of a continuous quantile.
BELOW_ONE = 0.9999999999999999
#: Ranks within a cell: by a window over the cell, which holds WINDOW_ROWS at most, or by range partitions.
WINDOW, RANGES = "window", "ranges"
WINDOW_ROWS = 2_000_000
#: Cells up to which the finest edges are held by the driver, so that the events are ranked once, whatever is asked of them.
HELD_CELLS = 100_000


@dataclass
class Quantiles:
    """What a build gives.  ``tables[j]``: condition index columns, ``q0..q{j-1}``, and ``edges`` (N + 1 values)."""

    tables: list[DataFrame]
    cells: DataFrame
    condition_axes: list[Axis]
    quantile_axes: list[Axis]
    columns: list[str]
    continuous: bool

    def coordinates(self) -> DataFrame:
        """(condition index..., q0..., coord, center, width) of every finest cell; one row for each variable."""
        keys = [index_name(a) for a in self.condition_axes] + [f"q{j}" for j in range(len(self.tables))]
        out = None
        for j, axis in enumerate(self.quantile_axes):
            low, high = F.col(f"min{j}"), F.col(f"max{j}")
            part = self.cells.select(*keys, F.lit(axis.name or f"quant_{j}").alias("coord"), ((high + low) / 2).alias("center"), (high - low).alias("width"))
            out = part if out is None else out.unionByName(part)
        return out

    def volumes(self) -> DataFrame:
        """(condition index..., q0..., volume): the product of the cell's widths."""
        keys = [index_name(a) for a in self.condition_axes] + [f"q{j}" for j in range(len(self.tables))]
        volume: Column = F.lit(1.0)
        for j in range(len(self.tables)):
            volume = volume * (F.col(f"max{j}") - F.col(f"min{j}"))
        return self.cells.select(*keys, volume.alias("volume"))


def lookup_column(edges: Column, value: Column, continuous: bool) -> Column:
    """The bin of ``value`` among N + 1 edges (a value on an edge belongs to the bin above), or its place in [0, 1)."""
    n = F.size(edges) - 1
    i = F.greatest(F.lit(0), F.least(n - 1, F.size(F.filter(edges, lambda e: e <= value)) - 1))
    i = F.when(value.isNull() | edges.isNull(), None).otherwise(i)
    if not continuous:
        return i.cast("int")
    low, high = F.get(edges, i), F.get(edges, i + 1)
    part = F.when(high == low, 0.5).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), (i + part) / n))


def static_lookup(df: DataFrame, name: str, edges: Sequence[float], col: str, continuous: bool = False) -> DataFrame:
    """``df`` with the quantile of ``col`` among fixed edges; arrays element by element."""
    held = F.array(*(F.lit(float(e)) for e in edges))
    if df.schema[col].dataType.typeName() == "array":
        return df.withColumn(name, F.transform(F.col(f"`{col}`"), lambda x: lookup_column(held, x, continuous)))
    return df.withColumn(name, lookup_column(held, F.col(f"`{col}`"), continuous))


def ranked(df: DataFrame, cell: Sequence[str], order: Sequence[Column], how: str, path: str = "") -> DataFrame:
    """``df`` with ``_r`` (rank from 0 in its cell) and ``_n`` (rows of the cell).

    ``ranges``: rows are dealt by range over (cell, order), sorted and numbered, and written to ``path``; numbers are counted
    from the first of a partition's share of a cell and offset by the shares before it, so that no cell is gathered in one
    task.  Rows and shares are both read from what was written: the bounds of the ranges come from a sample that another
    run of the exchange, as for other columns, draws anew."""
    if how == WINDOW:
        return df.withColumn("_r", (F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*cell)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *cell, *order).sortWithinPartitions(*cell, *order).withColumn("_k", F.monotonically_increasing_id())
    # the partition is in the upper bits
    dealt = sinks.write_rows(numbered, path).withColumn("_p", F.shiftright("_k", 33))
    shares = dealt.groupBy("_p", *cell).agg(F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_f"))
    before = Window.partitionBy(*cell).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("_p", *cell, "_f", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"), F.sum("_c").over(Window.partitionBy(*cell)).alias("_n"))
    return dealt.join(small(shares), ["_p", *cell]).withColumn("_r", F.col("_k") - F.col("_f") + F.col("_b")).drop("_p", "_k", "_f", "_b")


def _grid(spark, axes: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Every combination of (name, first, size)."""
    total = 1
    for _, _, size in axes:
        total *= size
    out, stride = spark.range(total), total
    for name, first, size in axes:
        stride //= size
        out = out.withColumn(name, (F.floor(F.col("id") / stride) % size + first).cast("int"))
    return out.drop("id")


def _filled(df: DataFrame, keys: list[str], k: str, low: str, high: str) -> DataFrame:
    """Empty bins: the maximum of the bin before (none before the first), the minimum of the bin after, else the maximum."""
    w = Window.partitionBy(*keys).orderBy(k)
    infinite = F.lit(float("-inf"))
    out = df.withColumn(high, F.coalesce(F.last(high, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), infinite))
    return out.withColumn(low, F.coalesce(F.first(low, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col(high)))


def build_quantiles(df: DataFrame, cols: Sequence[str], condition_axes: Sequence[Axis], quantile_axes: Sequence[Axis], continuous: bool = False, ties: Sequence[str] = (), how: str | None = None) -> Quantiles:
    """Edges from data.  ``cols``: condition columns, then one column per quantile axis.

    Quantile axes run from 0 to 1.  Rows outside a condition axis are left out; rows with a null value too.  Equal
    values are ordered by ``ties``, null last (a unique key makes the result independent of the partitioning)."""
    condition_axes = named(condition_axes, "cond")
    quantile_axes = named(quantile_axes, "quant")
    m = len(condition_axes)
    if len(cols) != m + len(quantile_axes):
        raise ValueError("one column for each axis")
    for a in quantile_axes:
        if abs(a.edges()[0]) > 1e-12 or abs(a.edges()[-1] - 1) > 1e-12:
            raise ValueError("quantile axes run from 0 to 1")
    keys = [index_name(a) for a in condition_axes]
    names = [f"x{j}" for j in range(len(quantile_axes))]
    rows = df.select(*(a.index(F.col(f"`{c}`")).alias(k) for a, c, k in zip(condition_axes, cols, keys)), *(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols[m:], names)), *(F.col(f"`{t}`").alias(f"_t{i}") for i, t in enumerate(ties)))
    keep = F.lit(True)
    for a, k in zip(condition_axes, keys):
        keep = keep & a.inside(F.col(k))
    for n in names:
        keep = keep & F.col(n).isNotNull()
    rows = rows.where(keep)
    # no cell has more rows than there are
    how = how or (WINDOW if rows.count() <= WINDOW_ROWS else RANGES)
    spark = df.sparkSession
    paths: list[str] = []
    for j, axis in enumerate(quantile_axes):
        cell = [*keys, *(f"q{i}" for i in range(j))]
        path = sinks.shared_folder(spark) if how == RANGES else ""
        rows = ranked(rows, cell, [F.col(names[j]), *(F.col(f"_t{i}").asc_nulls_last() for i in range(len(ties)))], how, path)
        # the rows before are in these
        sinks.delete(spark, *paths)
        paths = [path] if path else []
        cut: Column = F.lit(0)
        for f in axis.edges()[1:-1]:
            cut = cut + (F.rint(F.lit(float(f)) * F.col("_n")) <= F.col("_r")).cast("int")
        rows = rows.withColumn(f"q{j}", cut).drop("_r", "_n")
    finest = [*keys, *(f"q{j}" for j in range(len(names)))]
    found = rows.groupBy(*finest).agg(*(f(n).alias(f"{w}{j}") for j, n in enumerate(names) for f, w in ((F.min, "min"), (F.max, "max"))))
    sizes = [(k, a.first, a.extent) for k, a in zip(keys, condition_axes)]
    if math.prod([size for _, _, size in sizes] + [a.n for a in quantile_axes]) <= HELD_CELLS:
        found = spark.createDataFrame(found.toArrow(), found.schema)
        sinks.delete(spark, *paths)
    tables = []
    cells = None
    for j, axis in enumerate(quantile_axes):
        cell = [*keys, *(f"q{i}" for i in range(j))]
        sizes.append((f"q{j}", 0, axis.n))
        level = found.groupBy(*cell, f"q{j}").agg(F.min(f"min{j}").alias(f"min{j}"), F.max(f"max{j}").alias(f"max{j}"))
        full = _filled(_grid(spark, sizes).join(level, [*cell, f"q{j}"], "left"), cell, f"q{j}", f"min{j}", f"max{j}")
        tables.append(_edge_arrays(full, cell, j))
        cells = full if cells is None else full.join(cells, cell)
    return Quantiles(tables, cells, list(condition_axes), list(quantile_axes), list(cols), continuous)


def _edge_arrays(full: DataFrame, cell: list[str], j: int) -> DataFrame:
    slots = F.array_sort(F.collect_list(F.struct(f"q{j}", f"min{j}", f"max{j}")))
    edges = F.concat(F.array(F.element_at(slots, 1)[f"min{j}"]), F.transform(slots, lambda s: s[f"max{j}"]))
    return (full.groupBy(*cell) if cell else full.groupBy()).agg(edges.alias("edges"))


def build_quantiles_from_fine(fine: Histogram, condition_axes: Sequence[str], quantile_axes: dict[str, Axis], continuous: bool = False) -> Quantiles:
    """Edges from a finely binned histogram; ``quantile_axes`` maps its axes to quantile axes, in order.

    A cut is the right edge of the first fine bin at which the running sum reaches the share.  Underflow's right edge is
    the first edge, overflow's the last.  Fine axes need an underflow bin."""
    by = {a.name: a for a in fine.axes}
    for name in quantile_axes:
        if not by[name].underflow:
            raise ValueError(f"fine axis {name} has no underflow bin")
    conditions = [by[n] for n in condition_axes]
    keys = [index_name(a) for a in conditions]
    spark = fine.data.sparkSession
    data = fine.project(*condition_axes, *quantile_axes).data
    tables, cells, outer = [], None, list(keys)
    sizes = [(index_name(a), a.first, a.extent) for a in conditions]
    order = list(quantile_axes.items())
    for j, (name, axis) in enumerate(order):
        a, fi = by[name], f"{name}_idx"
        edges = F.array(*(F.lit(float(e)) for e in a.edges()))
        level = data.groupBy(*outer, fi).agg(F.sum("value").alias("v"))
        full = _grid(spark, [*sizes, (fi, a.first, a.extent)]).join(level, [*outer, fi], "left").withColumn("v", F.coalesce("v", F.lit(0)).cast("double"))
        w = Window.partitionBy(*outer).orderBy(fi)
        full = full.withColumn("cum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("v").over(Window.partitionBy(*outer)))
        # the cut that closes quantile bin k: the first fine bin that reaches its share
        reach = [F.min(F.when((F.col("total") > 0) & (F.col("cum") >= F.lit(float(f)) * F.col("total")), F.col(fi))).alias(f"c{k}") for k, f in enumerate(axis.edges()[1:])]
        cuts = (full.groupBy(*outer) if outer else full.groupBy()).agg(*reach)
        right = [F.when(F.col(f"c{k}").isNotNull(), F.get(edges, F.greatest(F.lit(0), F.least(F.col(f"c{k}") + 1, F.lit(a.n))))) for k in range(axis.n)]
        left = [F.when(F.col("c0").isNotNull(), F.lit(float(a.edges()[0]))), *right[:-1]]
        rows = cuts.select(*outer, F.posexplode(F.array(*(F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in zip(left, right)))).alias(f"q{j}", "e"))
        minus = F.lit(float("-inf"))
        rows = rows.select(*outer, f"q{j}", F.coalesce("e.lo", minus).alias(f"min{j}"), F.coalesce("e.hi", minus).alias(f"max{j}"))
        slots = F.array_sort(F.collect_list(F.struct(f"q{j}", f"max{j}")))
        table = F.concat(F.array(F.lit(float(a.edges()[0]))), slots[f"max{j}"])
        tables.append((rows.groupBy(*outer) if outer else rows.groupBy()).agg(table.alias("edges")))
        cells = rows if cells is None else rows.join(cells, outer)
        # fine bins to quantile bins, for the next variable
        place: Column = F.lit(0)
        for k in range(axis.n - 1):
            place = place + (F.col(fi) > F.col(f"c{k}")).cast("int")
        if outer:
            data = data.join(cuts, outer)
        else:
            row = cuts.first()  # one row: the cuts are literals
            data = data.withColumns({c: F.lit(row[c]).cast("int") for c in cuts.columns})
        data = data.withColumn(f"q{j}", F.coalesce(place, F.lit(0))).drop(*(f"c{k}" for k in range(axis.n)))
        outer = [*outer, f"q{j}"]
        sizes = [*sizes, (f"q{j}", 0, axis.n)]
    return Quantiles(tables, cells, conditions, named([x for _, x in order], "quant"), [*condition_axes, *quantile_axes], continuous)


def define_quantiles(df: DataFrame, cols: Sequence[str], quantiles: Quantiles, label: str = "") -> tuple[DataFrame, list[Axis], list[str]]:
    """(``df`` with the transformed columns, axes of N + 1 slots for them, their names).

    Each transformed column is a condition for the next.  A condition outside an axis without that flow bin raises."""
    m = len(quantiles.condition_axes)
    keys = [index_name(a) for a in quantiles.condition_axes]
    temporary = [f"_c{i}" for i in range(m)]
    for a, c, t in zip(quantiles.condition_axes, cols, temporary):
        i = a.index(F.col(f"`{c}`"))
        df = df.withColumn(t, F.when(i.isNull() | a.inside(i), i).otherwise(F.raise_error(F.lit(f"{c} is outside its axis"))))
    values, ns = list(cols[m:]), [a.n for a in quantiles.quantile_axes]
    suffix = "quant" if quantiles.continuous else "iquant"
    names = [f"{c}{'_' + label if label else ''}_{suffix}" for c in values]
    axes: list[Axis] = [Regular(name, False, False, n + 1, 0.0, 1.0) if quantiles.continuous else Integer(name, False, False, 0, n + 1) for name, n in zip(names, ns)]
    sizes = [a.extent for a in quantiles.condition_axes]
    if math.prod([*sizes, *ns]) <= HELD_CELLS:
        df = _defined(df, quantiles, temporary, keys, values, names)
        return df.drop(*temporary), axes, names
    if any(is_container(df, c) for c in values):
        raise NotImplementedError("quantiles of arrays need a table of edges that can be held")
    on, bins = list(zip(temporary, keys)), []
    for j, table in enumerate(quantiles.tables):
        side = table.select(*(F.col(k).alias(f"_j{i}") for i, (_, k) in enumerate(on)), F.col("edges").alias("_edges"))
        few = math.prod([*sizes, *ns[:j]]) <= BROADCAST_ROWS
        if on:
            df = df.join(F.broadcast(side) if few else side, [F.col(t) == F.col(f"_j{i}") for i, (t, _) in enumerate(on)], "left").drop(*(f"_j{i}" for i in range(len(on))))
        else:
            row = table.first()  # one row: the edges are literals
            df = df.withColumn("_edges", F.array(*(F.lit(float(e)) for e in row["edges"])))
        value = F.col(f"`{values[j]}`").cast("double")
        place = lookup_column(F.col("_edges"), value, False)
        df = df.withColumn(f"_q{j}", place).withColumn(names[j], lookup_column(F.col("_edges"), value, True) if quantiles.continuous else F.col(f"_q{j}")).drop("_edges")
        bins.append(f"_q{j}")
        on.append((f"_q{j}", f"q{j}"))
    return df.drop(*temporary, *bins), axes, names


def _defined(df: DataFrame, quantiles: Quantiles, temporary: list[str], keys: list[str], values: list[str], names: list[str]) -> DataFrame:
    """One join for all variables: a row for each condition cell, with the edges of all cells of the variables before.

    Values may be arrays, which are looked up element by element (conditions are scalars)."""
    ns = [a.n for a in quantiles.quantile_axes]
    side = None
    for j, table in enumerate(quantiles.tables):
        # the cells of the variables before, in order
        cells = F.transform(F.array_sort(F.collect_list(F.struct(*(f"q{i}" for i in range(j)), "edges"))), lambda s: s["edges"])
        part = (table.groupBy(*keys) if keys else table.groupBy()).agg(cells.alias(f"_e{j}"))
        if side is None:
            side = part
        elif keys:
            side = side.join(part, keys)
        else:
            side = side.withColumn(f"_e{j}", _literal(part.first()[0]))  # one row
    if keys:
        held = side.toArrow()  # at most HELD_CELLS edges' arrays
        side = df.sparkSession.createDataFrame(held, side.schema).toDF(*(f"_j{i}" for i in range(len(keys))), *(f"_e{j}" for j in range(len(ns))))
        df = df.join(F.broadcast(side), [F.col(t) == F.col(f"_j{i}") for i, t in enumerate(temporary)], "left").drop(*(f"_j{i}" for i in range(len(keys))))
    else:
        row = side.first()
        df = df.select("*", *(_literal(row[f"_e{j}"]).alias(f"_e{j}") for j in range(len(ns))))
    held_as = [is_container(df, c) for c in values]
    for j, (c, name) in enumerate(zip(values, names)):

        def look(x: Column, *before: Column, j: int = j, continuous: bool = False) -> Column:
            at: Column = F.lit(0)
            for q, n in zip(before, ns):
                at = at * n + q
            return lookup_column(F.get(F.col(f"_e{j}"), at), x.cast("double"), continuous)

        inputs = [F.col(f"`{c}`"), *(F.col(f"_q{i}") for i in range(j))]
        held = [held_as[j], *(any(held_as[: i + 1]) for i in range(j))]
        df = df.withColumn(f"_q{j}", map_over(look, *inputs, containers=held))
        df = df.withColumn(name, map_over(lambda *a, f=look: f(*a, continuous=True), *inputs, containers=held) if quantiles.continuous else F.col(f"_q{j}"))
    return df.drop(*(f"_e{j}" for j in range(len(ns))), *(f"_q{j}" for j in range(len(ns))))


def _literal(cells: Sequence[Sequence[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(e)) for e in edges)) for edges in cells))


def final_axes(quantiles: Quantiles, names: Sequence[str]) -> list[Axis]:
    """Axes of exactly N bins for the transformed columns."""
    return [Regular(n, False, False, a.n, 0.0, 1.0) if quantiles.continuous else Integer(n, False, False, 0, a.n) for n, a in zip(names, quantiles.quantile_axes)]
