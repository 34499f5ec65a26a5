"""Queries of the subpackage against their SQL, and the pipeline against a brute-force version."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA, connect, same

import corpus_pipeline as C
from fillwise.llm import queries as Q
from fillwise.llm.common import materialize
from fillwise.llm.tokens import Encoder, tokenizer_path

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(Q.queries()[name](spark, FOLDER), connect(FOLDER), Q.oracle_sql()[name])


def test_ten_queries_and_the_pipeline():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{k}" for k in range(1, 11)}
    assert [n for n, _ in C.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]


def test_pipeline(spark):
    """Each stage from what its predecessor kept, by plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = [materialize(docs)]
    for _, f in C.STAGES:
        stages.append(materialize(f(spark, stages[-1], FOLDER)))
    assert all(s.columns == docs.columns for s in stages[:-1])
    start, good, single, clean, mixed = ([r.asDict() for r in s.collect()] for s in stages[:-1])

    kept = {r.doc_id for r in Q.op8_quality_rules(spark, FOLDER).where("kept").collect()}
    assert {r["doc_id"]: r for r in good} == {r["doc_id"]: r for r in start if r["doc_id"] in kept}

    grams = {}
    for r in good:
        w = WORD.findall(r["text"])
        grams[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in grams}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(grams)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(grams[a] & grams[b])
            if 9 * both >= 4 * (len(grams[a]) + len(grams[b])):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in single) == sorted({root(i) for i in ids})

    first = {}
    for r in sorted(single, key=lambda r: r["doc_id"]):
        w = WORD.findall(r["text"])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), r["doc_id"])
    after = {r["doc_id"]: r for r in clean}
    for r in single:
        w = WORD.findall(r["text"])
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r["doc_id"] for j in range(50)}
        left = [x for k, x in enumerate(w) if k not in gone]
        assert WORD.findall(after[r["doc_id"]]["text"]) == left and (gone or after[r["doc_id"]]["text"] == r["text"])
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])

    size, taken = Counter(), Counter()
    for r in clean:
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        assert after[r["doc_id"]]["text"].split()[:3] == r["text"].split()[:3]
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) and all(taken[s] <= 2 * size[s] for s in size)

    ids_, bounds = Encoder(tokenizer_path("word_bpe_49k.json"), "none").encode(pa.array([r["text"] for r in mixed]))
    want = Counter()
    for r, a, b in zip(mixed, bounds[:-1], bounds[1:]):
        one = np.append(ids_[a:b], 0).astype("<u4")
        for k in range(0, len(one), 2048):
            want[(r["doc_id"], k // 2048, zlib.crc32(one[k : k + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in stages[-1].collect()) == want


def test_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one two", None, None, 7), (3, " ".join(f"w{i}" for i in range(3000)), "en", "b", 1), (4, " ".join(f"w{i}" for i in range(3000)), "en", "b", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, f in C.STAGES:
            f(spark, docs, "").collect()
