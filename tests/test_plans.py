"""Physical plans: columns are pruned, filters pushed, fills shuffled once and free of Python."""

import os
import re

import pytest
from oracle import DATA

from fillwise import queries as Q
from fillwise.operators.histogram import histogram
from fillwise.plans.axes import Regular

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_is_one_exchange_within_generated_code(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_shipdate >= '1995-01-01'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(histogram(df, "h", [Regular("qty", bins=20, lo=0.0, hi=60.0)], ["l_quantity", "l_tax"]).data)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_tax:double,l_shipdate:timestamp\w*>", text)
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert not re.search("Python|Arrow|Pandas", text)


def test_fused_fills_share_one_scan(spark):
    text = plan(Q.fused_histograms(spark, FOLDER))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - {"user_aggregate", "onnx_inference"}))
def test_no_python_and_no_products(spark, name):
    text = plan(Q.QUERIES[name](spark, FOLDER))
    assert not re.search("PythonUDF|MapInPandas|ArrowEvalPython|CartesianProduct", text)
