"""Batched ONNX inference on a model written field by field."""

import pytest
from pyspark.sql import functions as F

from fillwise.functions.inference import onnx_columns, tflite_columns
from fillwise.functions.onnx_models import sum_model

pytest.importorskip("onnxruntime")


def test_onnx(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(sum_model(3))
    df = spark.range(100).select("id", F.array(*(F.col("id").cast("double") + k for k in range(3))).alias("x"), F.array(*(F.lit(1.0) * k for k in range(3))).alias("y")).repartition(3)
    out = onnx_columns(df, str(tmp_path / "m.onnx"), ["x", "y"], {"t": "total", "tt": "twice"}, {"x": (3,)})
    for r in out.collect():
        assert r.t == [r.id, r.id + 2.0, r.id + 4.0] and r.tt == [2 * v for v in r.t]
    assert onnx_columns(df.limit(0), sum_model(3), ["x", "y"], {"t": "total"}).count() == 0
    with pytest.raises(ValueError):
        onnx_columns(df, sum_model(3), ["x", "y"], {"x": "total"})


def test_scalars(spark):
    df = spark.range(5).select("id", F.col("id").cast("double").alias("x"))
    assert [r.t for r in onnx_columns(df, sum_model(1), ["x", "x"], {"t": "total"}).orderBy("id").collect()] == [[2.0 * i] for i in range(5)]


def test_tflite_is_refused():
    with pytest.raises(NotImplementedError):
        tflite_columns()


def test_null_inputs_give_null_outputs(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.5])], "id int, x array<float>").coalesce(1)
    for rows in (df, df.where("x is null"), df.where("x is not null")):
        got = {r.id: r.t for r in onnx_columns(rows, sum_model(2), ["x", "x"], {"t": "total"}).collect()}
        assert got == {i: {1: [2.0, 4.0], 2: None, 3: [6.0, 9.0]}[i] for i in got} and len(got) == rows.count()
