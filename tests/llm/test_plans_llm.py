"""The two native operators run no Python on the executors."""

import os
import re

import pytest
from oracle import DATA

import corpus_pipeline as C
from fillwise.llm import queries as Q

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_source_mix", "op8_quality_rules"])
def test_queries(spark, name):
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan(Q.queries()[name](spark, FOLDER)))


@pytest.mark.parametrize("stage", [C.quality_rules, C.source_mix])
def test_stages(spark, stage):
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan(stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)))


def test_a_filter_does_not_repeat_the_measures(spark):
    """The filter on the verdict stays above the measures, which a plan with one split of the text shows."""
    text = plan(C.quality_rules(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER))
    assert text.count("xxhash64") < 12
