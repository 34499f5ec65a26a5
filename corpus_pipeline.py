"""A corpus pipeline: quality rules, near copies, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared folder
and reads it again for the next.  All but the last return the columns of ``documents``.

Defined results: a null, empty or white text fails the quality rules, so it ends there; a null id takes part in all stages,
is never the reference of a repeated passage, and stays unless a document with an id is its near copy; of rows with equal
id and text one stays after the near copies, the same on every run; a null source is a source of its own; of n_chars only
the text's own length counts after a stage that changes texts; further columns are dropped, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import materialize
from fillwise.llm.jaccard import without_near_copies
from fillwise.llm.mixing import apply_mix
from fillwise.llm.packing import pack
from fillwise.llm.quality import quality_cascade
from fillwise.llm.substrings import dedup_substrings
from fillwise.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list:
    """The columns of documents; n_chars follows the text where a stage changed it."""
    return [F.col(c) if c != "n_chars" else F.length("text").cast("long").alias(c) for c in COLUMNS]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_cascade(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    return without_near_copies(docs.select(*COLUMNS), n=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds."""
    out = dedup_substrings(docs.select(*COLUMNS), window=50, keep_text=True)
    return out.select(*_columns(out))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last copy of a source's last one is cut to the words owed."""
    out = apply_mix(docs.select(*COLUMNS))
    return out.select(*_columns(out))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), "spaces", end_id=0, capacity=2048)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("mixing sources", source_mix), ("best-fit packing", packed)]

#: Packing needs token ids, which SQL cannot give; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
