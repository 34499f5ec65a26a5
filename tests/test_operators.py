"""Lookups, quantiles, shift and smear, matrices, arrays, runner, readers, inference, streaming."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillwise.functions import arrays as A
from fillwise.operators import lookup as L
from fillwise.operators import matrix as M
from fillwise.operators import quantiles as Q
from fillwise.operators import shift as S
from fillwise.operators.custom import custom_aggregate
from fillwise.operators.histogram import histogram, sum_and_count
from fillwise.operators.runner import Dataset, build_and_run
from fillwise.plans.axes import Integer, Regular, StrCategory, Variable
from fillwise.plans.fusion import Book, Fill
from fillwise.sources import readers
from fillwise.sources.readers import generate
from fillwise.streaming.histogram import streaming_histogram, to_memory

INTERVALS = '{"273425": [[62, 352], [354, 733]], "9": [[1, 1]]}'


def intervals(spark):
    return readers.intervals_from_json(spark.createDataFrame([(INTERVALS,)], "value string"))


def test_intervals(spark):
    df = spark.createDataFrame([(273425, 352), (273425, 353), (273425, 354), (1, 5), (7, 5), (9, 1), (9, None), (None, 1)], "run bigint, lumi bigint")
    kept = {tuple(r) for r in L.filter_intervals(df, intervals(spark)).collect()}
    assert kept == {(273425, 352), (273425, 354), (1, 5), (9, 1)}
    assert intervals(spark).count() == 3


def test_block_csv_and_lookup(spark, tmp_path):
    path = tmp_path / "lumi.csv"
    path.write_text("#Data tag : x\n#run:fill,ls,time,delivered(/fb),recorded(/fb)\n5:77,1:1,01/31/16 10:00:00,1.0,0.5\n5:77,2:2,01/31/16 10:00:23,1.0,0.25\n5:77,1:1,01/31/16 10:00:00,1.0,9.0\n#Summary:\n")
    table = readers.read_luminosity(spark, str(path))
    df = spark.createDataFrame([(5, 1), (5, 2)], "r bigint, b bigint")
    out = L.lookup(df, table, {"r": "run", "b": "lumi"}, "value", "v", order="line", missing="lumi not found")
    assert {tuple(r) for r in out.collect()} == {(5, 1, 0.5), (5, 2, 0.25)}
    with pytest.raises(Exception, match="lumi not found"):
        L.lookup(spark.createDataFrame([(6, 1)], "r bigint, b bigint"), table, {"r": "run", "b": "lumi"}, "value", "v", missing="lumi not found").collect()
    times = {r.lumi: r.value for r in readers.read_times(spark, str(path)).collect()}
    assert times[2] - times[1] == 23 and times[1] == pd.Timestamp("2016-01-31 10:00:00", tz="UTC").timestamp()


def test_histogram_value_and_payload(spark):
    df = generate(spark, 20, x="double(entry % 5)", k="int(entry % 2)")
    h = histogram(df, "h", [Integer("k", False, False, 0, 2), Regular("x", bins=4, lo=0.0, hi=4.0)], ["k", "x"], "double")
    got = L.histogram_value(df, h, ["k", "x"], "n").select("n").distinct().collect()
    assert [r[0] for r in got] == [2.0]
    payload = {r.k_idx: r.value for r in L.tensor_payload(h, 1).collect()}
    assert payload[0] == [0.0, 2.0, 2.0, 2.0, 2.0, 2.0]
    with pytest.raises(NotImplementedError):
        L.tensor_payload(histogram(df, "h", [Integer("k", lo=0, hi=2)], ["k"], "int64"), 1)


def brute_quantiles(frame, fractions):
    """Sort and slice, variable after variable."""
    cells = {(): frame}
    for j, f in enumerate(fractions):
        new = {}
        for key, part in cells.items():
            part = part.sort_values([f"x{j}", "id"])
            cut = [int(np.rint(v * len(part))) for v in f]
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                new[(*key, k)] = part.iloc[a:b]
        cells = new
    return cells


@pytest.mark.parametrize("how", [Q.WINDOW, Q.RANGES])
def test_build_matches_sort_and_slice(spark, how):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": range(997), "x0": rng.normal(size=997).round(1), "x1": rng.normal(size=997)})
    fractions = [[0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.1, 0.6, 1.0]]
    axes = [Variable(f"q{i}", False, False, tuple(f)) for i, f in enumerate(fractions)]
    q = Q.build_quantiles(spark.createDataFrame(frame), ["x0", "x1"], [], axes, ties=["id"], how=how)
    want = brute_quantiles(frame, fractions)
    for r in q.cells.collect():
        part = want[(r.q0, r.q1)]
        assert (r.min1, r.max1) == (part.x1.min(), part.x1.max())
    edges = q.tables[0].first().edges
    assert edges[0] == frame.x0.min() and edges[-1] == frame.x0.max()


@pytest.mark.parametrize("held", [0, Q.HELD_CELLS])
def test_ranges_are_those_of_one_run(spark, monkeypatch, tmp_path, held):
    """Both variables of many rows; what was written is deleted unless the edges still need it."""
    monkeypatch.setattr(Q, "HELD_CELLS", held)
    paths = (str(tmp_path / str(i)) for i in range(2))
    monkeypatch.setattr(Q.sinks, "shared_folder", lambda _: next(paths))
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": range(20000), "x0": rng.normal(size=20000).round(1), "x1": rng.normal(size=20000)})
    fractions = [[0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.1, 0.6, 1.0]]
    axes = [Variable(f"q{i}", False, False, tuple(f)) for i, f in enumerate(fractions)]
    q = Q.build_quantiles(spark.createDataFrame(frame), ["x0", "x1"], [], axes, ties=["id"], how=Q.RANGES)
    got = {(r.q0, r.q1): (r.min0, r.max0, r.min1, r.max1) for r in q.cells.collect()}
    cells = brute_quantiles(frame, fractions)
    spread = {k: pd.concat([p for c, p in cells.items() if c[0] == k]).x0 for k in range(4)}
    assert got == {c: (spread[c[0]].min(), spread[c[0]].max(), p.x1.min(), p.x1.max()) for c, p in cells.items()}
    assert [p.name for p in tmp_path.iterdir()] == ([] if held else ["1"])


@pytest.mark.parametrize("how", [Q.WINDOW, Q.RANGES])
def test_null_ties_come_last_as_in_sql(spark, how):
    df = spark.createDataFrame([(None, 1.0, 5.0), (7, 1.0, 3.0)], "id int, x double, y double")
    halves = [Regular(f"q{i}", False, False, 2, 0.0, 1.0) for i in range(2)]
    q = Q.build_quantiles(df, ["x", "y"], [], halves, ties=["id"], how=how)
    assert {r.q0: r.max1 for r in q.cells.where("q1 = 1").collect()} == {0: 3.0, 1: 5.0}


def test_empty_cells(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(2)], "c string, x double")
    q = Q.build_quantiles(df, ["c", "x"], [StrCategory("c", overflow=False, categories=("a", "b"))], [Regular("q", False, False, 4, 0.0, 1.0)])
    rows = {(r.c_idx, r.q0): (r.min0, r.max0) for r in q.cells.collect()}
    # 2 rows in 4 bins: cuts at rint(0.5) = 0, 1, rint(1.5) = 2
    assert [rows[(0, k)] for k in range(4)] == [(0.0, -math.inf), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0)]
    assert rows[(1, 0)][1] == -math.inf


def test_static_lookup(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.25, 0.4, 0.6, 0.9, 2.0, -1.0, 0.375)], "x double")
    edges = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.x: (r.i, r.c) for r in Q.static_lookup(Q.static_lookup(df, "i", edges, "x"), "c", edges, "x", True).collect()}
    assert [got[v][0] for v in (0.1, 0.25, 0.4, 0.6, 0.9, 2.0)] == [0, 1, 1, 2, 3, 3]
    assert got[0.25][1] == 0.25 and got[0.375][1] == 0.375 and got[2.0][1] == Q.BELOW_ONE and got[-1.0][1] == 0.0
    arrays = spark.createDataFrame([([0.1, 0.9],)], "x array<double>")
    assert Q.static_lookup(arrays, "i", edges, "x").first().i == [0, 3]


def test_define_quantiles_is_flat(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": range(4000), "c": rng.uniform(size=4000), "x": rng.normal(size=4000)})
    df = spark.createDataFrame(frame)
    for continuous in (False, True):
        q = Q.build_quantiles(df, ["c", "x"], [Regular("c", False, False, 2, 0.0, 1.0)], [Regular("q", False, False, 10, 0.0, 1.0)], continuous, ties=["id"])
        out, axes, names = Q.define_quantiles(df, ["c", "x"], q, label="t")
        assert names == ["x_t_quant" if continuous else "x_t_iquant"] and axes[0].n == 11
        counts = histogram(out, "h", Q.final_axes(q, names), names, "int64").to_numpy()["value"]
        assert counts.sum() == 4000 and abs(counts - 400).max() <= 4
        slots = histogram(out, "h", axes, names, "int64").to_numpy()["value"]
        assert continuous or slots[-1] == 0
    outside = spark.createDataFrame([(5.0, 0.0)], "c double, x double")
    with pytest.raises(Exception, match="outside its axis"):
        Q.define_quantiles(outside, ["c", "x"], q)[0].collect()


def test_from_fine(spark):
    df = generate(spark, 100, x="double(entry)")
    fine = histogram(df, "f", [Regular("x", bins=20, lo=0.0, hi=100.0)], ["x"], "int64")
    q = Q.build_quantiles_from_fine(fine, [], {"x": Regular("q", False, False, 4, 0.0, 1.0)})
    assert q.tables[0].first().edges == [0.0, 25.0, 50.0, 75.0, 100.0]
    with pytest.raises(ValueError):
        Q.build_quantiles_from_fine(histogram(df, "f", [Regular("x", False, True, 20, 0.0, 100.0)], ["x"]), [], {"x": Regular("q", False, False, 4, 0.0, 1.0)})


def test_shift_zero_and_tensor(spark):
    axes = [StrCategory("c", categories=("a", "b", "c")), Regular("x", bins=100, lo=0.0, hi=1.0)]
    df = spark.createDataFrame([(["a", "b"], [0.001, 0.0])], "c array<string>, x array<double>")
    assert S.with_shift_weight(df, "w", axes, ["c", "x"]).first().w == [1.0, 1.0]
    df = spark.createDataFrame([("a", [0.0, 0.0], [[0.001, 0.0], [0.001, 0.0]])], "c string, x array<double>, xs array<array<double>>")
    got = S.with_shift_weight(df, "w", axes, ["c", "x"], ["c", "xs"], ["c", "xs"], tensor=True).first().w
    assert np.allclose(got, [[1.84, 1.0], [1.84, 1.0]])


def test_shift_flow_and_discrete(spark):
    df = spark.createDataFrame([(-1.0, 5), (float("inf"), 5), (0.55, 6)], "x double, k int")
    out = S.with_shift_weight(df.withColumn("y", F.col("x") * 1.1), "w", [Regular("x", bins=2, lo=0.0, hi=1.0)], ["x"], ["y"], nominal="k").collect()
    assert [r.w for r in out[:2]] == [5.0, 5.0] and out[2].w != 6.0
    changed = S.with_shift_weight(df.withColumn("z", F.col("k") + 1), "w", [Integer("k", lo=0, hi=9)], ["k"], ["z"]).collect()
    assert all(math.isnan(r.w) for r in changed)


def test_shifted_histogram_estimates_a_shift(spark):
    df = generate(spark, 40000, x="(entry + 0.5D) / 40000D").withColumn("y", F.col("x") * 1.01)
    axis = [Regular("x", bins=10, lo=0.0, hi=1.0)]
    estimate = S.shifted_histogram(df, "h", axis, ["x"], ["y"]).to_numpy(flow=False)["value"]
    truth = histogram(df, "h", axis, ["y"]).to_numpy(flow=False)["value"]
    assert (abs(estimate[1:9] / truth[1:9] - 1) < 0.01).all()


def test_matrices(spark):
    df = spark.createDataFrame([(1, 3, 5.0), (3, 1, 3.0), (0, 0, 1.0)], "i int, j int, v double")
    cells = M.symmetric(df, "i", "j", "v", n=4)
    assert {(r.i, r.j): (r.value, r.packed) for r in cells.collect()} == {(1, 3): (8.0, 6), (0, 0): (1.0, 0)}
    assert [r.value for r in M.symmetric_row(cells, 1, 4).orderBy("j").collect()] == [0.0, 0.0, 0.0, 8.0]
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (5, 7, 1.5), (0, 0, 2.0), (0, 0, 0.0), (4, 4, 0.0), (3, 3, 1.0), (3, 3, -1.0)], "i int, j int, v double")
    assert {(r.i, r.j): r.value for r in M.sparse_matrix(df, "i", "j", "v").collect()} == {(1, 2): 7.0, (5, 7): 1.5, (0, 0): 2.0, (3, 3): 0.0}
    big = spark.range(8 * 500 * 32).select((F.col("id") % 32).alias("i"), (F.col("id") % 32 * 3 + 1).alias("j"), (1 + 0.01 * F.floor(F.col("id") / 16000)).alias("v")).withColumn("j", F.col("j") % 32)
    assert all(abs(r.value - 4140) < 1e-6 for r in M.sparse_matrix(big, "i", "j", "v").collect())


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [10, 20, 30, 40, 50], 2, 5)], "a array<int>, b array<int>, s int, t int")
    assert A.define(df, "c", lambda x, y: x + y, ["a", "b"]).first().c == [11, 22, 33, 44]
    assert A.define(df, "c", lambda x, y: x + y, ["s", "t"]).first().c == 7
    assert A.define(df, "c", lambda x, y: x * y, ["a", "s"]).first().c == [2, 4, 6, 8]
    assert A.where(df, lambda s: s > 2, ["s"]).count() == 0
    m = A.mask({"a": F.col("a")}, lambda e: e["a"] > 2)
    assert tuple(df.select(A.count_true(m), A.element(A.masked(F.col("a"), m)), A.element(F.col("a"), 9)).first()) == (2, 3, None)
    assert df.select(A.tensor_map(lambda x, s: x - s, F.col("a"), F.col("s"))).first()[0] == [-1, 0, 1, 2]


def test_event_selection(spark):
    """Exactly one loose and one tight object; its values and a tensor of weights are filled."""
    rows = [([20.0, 5.0], [True, True], [True, False], 1.0), ([20.0, 30.0], [True, True], [True, True], 1.0), ([40.0], [True], [True], -2.0)]
    df = spark.createDataFrame(rows, "pt array<double>, loose array<boolean>, tight array<boolean>, gen double").withColumn("weight", A.sign_weight(F.col("gen")))
    df = df.withColumn("veto", A.mask({"p": F.col("pt"), "l": F.col("loose")}, lambda e: (e["p"] > 10) & e["l"])).where(A.count_true(F.col("veto")) == 1)
    df = df.withColumn("pt0", A.element(A.masked(F.col("pt"), F.col("veto"))))
    h = histogram(df, "h", [Regular("pt", bins=2, lo=10.0, hi=50.0)], ["pt0", "weight"])
    assert h.to_numpy(flow=False)["value"].tolist() == [1.0, -1.0]


def test_runner(spark, tmp_path):
    generate(spark, 100, run="entry % 3", luminosityBlock="entry % 10", x="double(entry % 7)").write.parquet(str(tmp_path / "data"))
    spark.createDataFrame([(0, 0), (0, 1), (2, 3)], "run bigint, luminosityBlock bigint").write.parquet(str(tmp_path / "blocks"))
    (tmp_path / "good.json").write_text('{"0": [[0, 4]], "2": [[0, 0]]}')
    (tmp_path / "lumi.csv").write_text("#t\n#run:fill,ls,recorded(/fb)\n0:1,0:0,1.5\n0:1,1:1,2.0\n")
    data = Dataset("data", [str(tmp_path / "data")], True, None, str(tmp_path / "lumi.csv"), str(tmp_path / "good.json"), [str(tmp_path / "blocks")])
    simulated = Dataset("sim", [str(tmp_path / "data")], xsec=2.0)

    def build(df, d):
        df = df.withColumn("w", F.lit(1.0))
        totals = sum_and_count(df, "w")
        return [histogram(df, "h", [Regular("x", bins=7, lo=0.0, hi=7.0)], ["x", "w"])], totals

    out = build_and_run(spark, [data, simulated], build)
    expected = sum(1 for i in range(100) if i % 3 == 1 or (i % 3 == 0 and i % 10 <= 4) or (i % 3 == 2 and i % 10 == 0))
    assert out["data"]["event_count"] == expected and out["data"]["lumi"] == 3.5 and out["sim"]["event_count"] == 100
    assert out["sim"]["output"]["h"].to_numpy()["value"].sum() == 100

    def booked(df, d):
        df = df.withColumn("w", F.lit(1.0))
        fills = [Fill("a", [Regular("x", bins=7, lo=0.0, hi=7.0)], ["x", "w"]), Fill("b", [Integer("run", lo=0, hi=3)], ["run"], "int64")]
        return [Book(df, fills), histogram(df, "c", [Integer("run", lo=0, hi=3)], ["run"])], sum_and_count(df, "w")

    shared = build_and_run(spark, [simulated], booked)["sim"]["output"]
    assert shared["a"].equals(out["sim"]["output"]["h"]) and set(shared) == {"a", "b", "c"}
    assert shared["b"].to_numpy()["value"].tolist() == [0, 34, 33, 33, 0]

    def filtered(df, d):
        df = df.withColumn("w", F.lit(1.0)).where("x > 3")
        return [], sum_and_count(df, "w")

    with pytest.raises(ValueError, match="sum before filtering"):
        build_and_run(spark, [simulated], filtered)
    with pytest.raises(ValueError, match="two results"):
        build_and_run(spark, [simulated], lambda df, d: ([build(df, d)[0][0]] * 2, sum_and_count(df.withColumn("w", F.lit(1.0)), "w")))


def test_readers(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    assert readers.read_events(spark, [str(tmp_path / "a")] * 2).count() == 6
    assert readers.read_events(spark, [str(tmp_path / "a")] * 2, test=True).count() == 3
    assert len(readers.list_files(spark, str(tmp_path / "a" / "*.parquet"))) == 1
    with pytest.raises(ValueError):
        readers.read_events(spark, [])


def test_streaming(spark, tmp_path):
    generate(spark, 60, x="double(entry % 6)", w="2.0D", ts="timestamp_seconds(1000 + entry * 60)").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("entry bigint, x double, w double, ts timestamp").parquet(str(tmp_path / "s"))
    axis = [Regular("x", bins=3, lo=0.0, hi=6.0)]
    q = to_memory(streaming_histogram(stream, "h", axis, ["x", "w"]), "live")
    q.awaitTermination(60)
    assert {(r.x_idx, r.value) for r in spark.table("live").collect()} == {(0, 40.0), (1, 40.0), (2, 40.0)}
    q = to_memory(streaming_histogram(stream, "h", axis, ["x", "w"], time="ts", window="10 minutes"), "windowed")
    q.awaitTermination(60)
    assert spark.table("windowed").agg(F.sum("value")).first()[0] == 120.0


def test_custom_aggregate_over_several_batches(spark):
    def partial(frames):
        parts = [f.groupby("k", as_index=False).agg(s=("v", "sum")) for f in frames if len(f)]
        return pd.concat(parts) if parts else pd.DataFrame({"k": [], "s": []})

    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.col("id").alias("v")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = custom_aggregate(df, partial, "k string, s long", ["k"], [F.sum("s").alias("s")])
        assert {r.k: r.s for r in got.collect()} == {f"k{i}": sum(range(i, 1000, 3)) for i in range(3)}
        some = custom_aggregate(df.repartition(3).where("v < 0 or v = 5"), partial, "k string, s long", ["k"], [F.sum("s").alias("s")])
        assert [tuple(r) for r in some.collect()] == [("k2", 5)]  # most tasks have no rows
        assert custom_aggregate(df.limit(0), partial, "k string, s long", ["k"], [F.sum("s").alias("s")]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
