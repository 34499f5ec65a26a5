"""The registered queries of the training-data operators and their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm import sql
from fillwise.llm.jaccard import similarity_join
from fillwise.llm.lm import cross_entropy_difference
from fillwise.llm.mixing import mix
from fillwise.llm.topk import top_k
from fillwise.llm.toxicity import score_toxicity
from fillwise.llm.repair import token_files
from fillwise.llm.substrings import dedup_substrings
from fillwise.llm.tokens import tokenizer_path
from fillwise.llm.packing import pack
from fillwise.llm.pages import extract_pages
from fillwise.llm.quality import quality_cascade

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


#: Ids of byte_bpe_50k end below this.
BYTE_BPE_IDS = 50_257


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, tokenizer_path("byte_bpe_50k.json"), "bytes", end_id=2, base=BYTE_BPE_IDS)


def op3_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), "spaces", end_id=0, capacity=2048)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, window=50, keep_text=False).drop("text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_join(docs, n=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def queries() -> dict[str, Query]:
    found = [op1_page_text, op2_token_files, op3_packed_sequences, op4_source_mix, op5_substring_dedup, op6_toxicity, op7_exact_top_k, op8_quality_rules, op9_cross_entropy_difference, op10_jaccard_join]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": sql.OP4, "op5_substring_dedup": sql.OP5, "op7_exact_top_k": sql.OP7, "op8_quality_rules": sql.OP8, "op9_cross_entropy_difference": sql.OP9}
