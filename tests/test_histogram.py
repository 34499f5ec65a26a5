"""Axes, fills, storages, projections, tensors, fusion."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fillwise.operators.histogram import histo_1d, histo_2d, histogram, sum_and_count, with_tensor_shape
from fillwise.plans.axes import Boolean, IntCategory, Integer, Regular, StrCategory, Variable, collapse, growable, named
from fillwise.plans.fusion import Fill, fuse, split
from fillwise.plans.storage import sparse, storage_of
from fillwise.sources.readers import generate
from fillwise.sources.sinks import from_arrays, read_histograms, to_arrays, write_histograms

INF, NAN = float("inf"), float("nan")


def indices(spark, axis, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", axis.index(F.col("x"))).collect())]


def test_regular(spark):
    axis = Regular("x", bins=4, lo=0.0, hi=2.0)
    assert indices(spark, axis, [-0.1, 0.0, 0.5, 1.99, 2.0, INF, -INF, NAN, None]) == [-1, 0, 1, 3, 4, 4, -1, 4, None]
    assert (axis.extent, axis.first, axis.last) == (6, -1, 4)


def test_circular(spark):
    axis = Regular("x", bins=4, lo=0.0, hi=2.0, circular=True)
    assert indices(spark, axis, [0.0, 2.0, -0.5, 4.5, NAN, INF, None]) == [0, 0, 3, 1, 4, 4, None]
    assert not axis.underflow


def test_variable(spark):
    axis = Variable("x", at=(0, 1, 3, 10))
    assert indices(spark, axis, [-1.0, 0.0, 0.99, 1.0, 3.0, 9.9, 10.0, NAN, INF, -INF, None]) == [-1, 0, 0, 1, 2, 2, 3, 3, 3, -1, None]


def test_discrete(spark):
    assert indices(spark, Integer("x", lo=2, hi=5), [1, 2, 4, 5, None], "int") == [-1, 0, 2, 3, None]
    assert indices(spark, IntCategory("x", categories=(7, 3)), [3, 7, 4, None], "int") == [1, 0, 2, None]
    assert indices(spark, StrCategory("x", categories=("a", "b")), ["b", "z", "a", None], "string") == [1, 2, 0, None]
    assert indices(spark, Boolean("x"), [True, False, None], "boolean") == [1, 0, None]


def test_refused_axes():
    with pytest.raises(ValueError):
        growable()
    with pytest.raises(ValueError):
        Regular("x", bins=0)
    with pytest.raises(ValueError):
        Variable("x", at=(1, 1))
    with pytest.raises(ValueError):
        named([Regular("a"), Regular("a")])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=9, unique=True))
def test_collapse_keeps_edges(edges):
    edges = sorted(edges)
    axis = collapse(edges, "x")
    assert np.allclose(axis.edges(), edges, rtol=0, atol=1e-7 * max(1.0, edges[-1] - edges[0]))


def test_uniform_1d_sparse(spark):
    df = generate(spark, 20000, x="double(entry % 20) + 0.5", w="1.0D")
    h = histogram(df, "h", [Regular("x", bins=20, lo=0.0, hi=20.0)], ["x", "w"], sparse(1.0))
    assert h.nnz() == 20
    assert (h.to_numpy(flow=False)["value"] == 1000).all()
    assert h.to_numpy()["value"].shape == (22,)


def test_grid_3d_sparse_is_dense(spark):
    df = generate(spark, 24000, x="double(entry % 3)", y="double((entry div 3) % 4)", z="double((entry div 12) % 5)", w="1.0D")
    axes = [Regular(n, False, False, k, 0.0, float(k)) for n, k in (("x", 3), ("y", 4), ("z", 5))]
    a = histogram(df, "a", axes, ["x", "y", "z", "w"], "sparse")
    b = histogram(df, "b", axes, ["x", "y", "z", "w"], "double")
    assert (a.to_numpy()["value"] == 400).all() and a.to_numpy()["value"].shape == (3, 4, 5)
    assert a.equals(b)
    dense = [r.value for r in b.densify().orderBy("flat").collect()]
    assert dense == a.to_numpy()["value"].reshape(-1).tolist()


def test_weights_and_conservation(spark):
    df = spark.createDataFrame([(x, w, 2.0) for x in (-5.0, 0.1, 0.9, 7.0, NAN, None) for w in (1.0, -3.0, None)], "x double, w double, v double")
    h = histogram(df, "h", [Regular("x", bins=2, lo=0.0, hi=1.0)], ["x", "w", "v"])
    got = h.to_numpy()
    assert got["value"].tolist() == [-4.0, -4.0, -4.0, -8.0] and got["variance"].tolist() == [40.0, 40.0, 40.0, 80.0]
    none = histogram(df, "h", [Regular("x", False, False, 2, 0.0, 1.0)], ["x", "w", "v"])
    assert none.to_numpy()["value"].tolist() == [-4.0, -4.0]


def test_partitioning_does_not_matter(spark):
    df = generate(spark, 1000, x="double(entry * 7919 % 101)", w="double(entry % 5)")
    axes = [Regular("x", bins=13, lo=5.0, hi=90.0)]
    assert histogram(df.repartition(1), "h", axes, ["x", "w"]).equals(histogram(df.repartition(8), "h", axes, ["x", "w"]))


def test_errors(spark):
    df = generate(spark, 3, x="double(entry)", a="array(1.0D, 2.0D)", b="array(1.0D)")
    with pytest.raises(RuntimeError):
        histogram(df, "h", [Regular("x"), Regular("y")], ["x"])
    with pytest.raises(NotImplementedError):
        histogram(df, "h", [Regular("x")], ["x"], "mean")
    with pytest.raises(TypeError):
        storage_of("unlimited")
    with pytest.raises(ValueError):
        histogram(df, "h", [Regular("x")], ["x", "x"], "int64")
    with pytest.raises(Exception, match="different lengths"):
        histogram(df, "h", [Regular("x")], ["a", "b"]).data.collect()


def test_containers(spark):
    df = spark.createDataFrame([([0.1, 0.6], [1.0, 2.0], 3.0), ([], [], 1.0), ([0.7], [4.0], 0.5)], "x array<double>, w array<double>, s double")
    got = histogram(df, "h", [Regular("x", bins=2, lo=0.0, hi=1.0)], ["x", "w", "s"]).to_numpy(flow=False)
    assert got["value"].tolist() == [3.0, 8.0] and got["variance"].tolist() == [9.0, 40.0]


@pytest.mark.parametrize("size", [4, 200])
def test_tensor_weight(spark, size):
    df = generate(spark, 30, x="double(entry % 3)").withColumn("t", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i + F.col("entry")).cast("double"))).withColumn("s", F.lit(2.0))
    df = df.select("x", "s", with_tensor_shape(F.col("t"), "t", (2, size // 2)))
    h = histogram(df, "h", [Integer("x", False, False, 0, 3)], ["x", "t", "s"], tensor_axes=["row"])
    assert [a.name for a in h.axes] == ["x", "row", "tensor_axis_1"]
    want = np.zeros((3, size))
    for e in range(30):
        want[e % 3] += 2.0 * (np.arange(size) + e)
    assert np.array_equal(h.to_numpy()["value"].reshape(3, size), want)
    with pytest.raises(ValueError):
        histogram(df, "h", [Integer("x", False, False, 0, 3)], ["x", "t"], tensor_axes=[Integer("r", False, False, 0, 3)])
    with pytest.raises(NotImplementedError):
        histogram(df, "h", [Integer("x", False, False, 0, 3)], ["x", "t"], "sparse")


def test_container_of_tensors(spark):
    df = spark.createDataFrame([([0, 1], [[1.0, 2.0], [3.0, 4.0]]), ([1], [[5.0, 6.0]])], "x array<int>, t array<array<double>>")
    h = histogram(df, "h", [Integer("x", False, False, 0, 2)], ["x", "t"], "double", tensors={"t": (2,)})
    assert h.to_numpy()["value"].tolist() == [[1.0, 2.0], [8.0, 10.0]]


def test_project_and_models(spark):
    df = generate(spark, 100, x="double(entry % 10)", y="double(entry % 4)", w="0.5D")
    h = histo_2d(df, ("h", "", 5, 0.0, 10.0, 2, (0.0, 1.0, 9.0)), "x", "y", "w")
    assert np.array_equal(h.project("axis_0").to_numpy()["value"], h.to_numpy()["value"].sum(1))
    assert histo_1d(df, ("k", "", 5, 0.0, 10.0), "x", "w").equals(h.project("axis_0"))
    with pytest.raises(ValueError):
        h.project("z")


def test_fused_equals_separate(spark):
    df = generate(spark, 500, x="double(entry % 17)", y="int(entry % 5)", w="double(entry % 3)")
    fills = [Fill("a", [Regular("x", bins=6, lo=2.0, hi=12.0)], ["x", "w"]), Fill("b", [Integer("y", False, False, 1, 4), Regular("x", bins=2, lo=0.0, hi=9.0)], ["y", "x"], "int64")]
    for fill, one in zip(fills, split(fuse(df, fills), fills)):
        assert one.equals(histogram(df, fill.name, fill.axes, fill.cols, fill.storage))
    with pytest.raises(ValueError):
        fuse(df, [fills[0], fills[0]])


def test_sum_and_count(spark):
    assert tuple(sum_and_count(generate(spark, 5, x="double(entry)"), "x").first()) == (10.0, 5)


def test_sink_and_conversion(spark, tmp_path):
    df = generate(spark, 50, x="double(entry % 7)", n="int(entry % 3)", w="double(entry)")
    h = histogram(df, "h", [Regular("x", bins=3, lo=1.0, hi=6.0), Integer("n", lo=0, hi=3)], ["x", "n", "w"], metadata={"a": 1})
    write_histograms(spark, str(tmp_path / "out"), [h], {"k": 2})
    back, extra = read_histograms(spark, str(tmp_path / "out"))
    assert extra == {"k": 2} and back["h"].axes == h.axes and back["h"].metadata == {"a": 1} and back["h"].equals(h)
    arrays = to_arrays(h)
    assert arrays["edges"][1] == [-0.5, 0.5, 1.5, 2.5] and arrays["value"].shape == (5, 5)
    again = from_arrays(spark, arrays)
    assert np.array_equal(again.to_numpy()["value"], arrays["value"])
    with pytest.raises(ValueError):
        from_arrays(spark, arrays, ["only one"])
    with pytest.raises(TypeError):
        to_arrays(histogram(df, "c", [IntCategory("n", categories=(0, 1))], ["n"]))
    assert math.isclose(arrays["value"].sum(), 49 * 50 / 2)


def test_bins_without_counterpart_are_left_out(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.5, 1.5, 1.7, 9.0)], "x double")
    full = histogram(df, "h", [Regular("x", bins=3, lo=0.0, hi=3.0)], ["x"])
    bare = from_arrays(spark, to_arrays(full), axes=[Regular("x", False, False, 3, 0.0, 3.0)])
    assert full.to_numpy(flow=True)["value"].tolist() == [1, 1, 2, 0, 1] and bare.to_numpy(flow=True)["value"].tolist() == [1, 2, 0]
