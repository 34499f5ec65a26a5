"""Quality rules and source mixing."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fillwise.llm.mixing import apply_mix, mix
from fillwise.llm.quality import MEASURES, SYMBOLS, Rule, default_rules, estimate, measures, ordered_rules, quality_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b\x0bc\x0cd\re", "é́ 日本 \x1c x", "a a a a a a a a a a", "# $% <|> & * x", "line\nline\n  \nline \nother\n",
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8 end", " ".join(f"t{i % 9}" for i in range(60)), " ".join(f"word{i}" for i in range(50)), "x" * 5000, "GO!! " * 40,
    " ".join(f"u{i}" for i in range(3000)) + " " + " ".join(f"u{i}" for i in range(100, 140)),
]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), len(hit), sum(a == b for a, b in zip(w, w[1:]))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string, _t int")


def test_measures(spark):
    out = measures(frame(spark, TEXTS))
    assert out.columns == ["doc_id", "text", "_t", *MEASURES]  # the clashing column is replaced
    for r in out.collect():
        assert tuple(r[m] for m in MEASURES) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_cascade_is_independent_of_order(spark):
    docs = frame(spark, TEXTS)
    rules = default_rules()
    kept = []
    for order in (rules, rules[::-1]):
        estimates = [{"rule": r.name, "cost": 1.0, "rejects": float(len(order) - i)} for i, r in enumerate(order)]
        assert [r.name for r in ordered_rules(rules, estimates)] == [r.name for r in order]
        kept.append(sorted((r.doc_id, r.kept) for r in quality_cascade(docs, estimates=estimates).collect()))
    assert kept[0] == kept[1]
    verdicts = dict(kept[0])
    assert verdicts[11] and not verdicts[13] and not verdicts[0] and not verdicts[6]


def test_estimates_order_by_rejection_per_cost(spark):
    sample = measures(spark.createDataFrame([(i, f"a b c {i}") for i in range(200)], "doc_id bigint, text string")).select("text", *MEASURES)
    rules = [Rule("never", F.lit(False)), Rule("often", F.col("n_words") > 3)]
    found = estimate(sample, rules, rows=50, share=1.0)
    assert {e["rule"]: e["rejects"] for e in found} == {"never": 0.0, "often": 1.0}
    assert [r.name for r in ordered_rules(rules, found)] == ["often", "never"]


def test_a_rejected_document_is_not_looked_at_again(spark):
    """A later rule, and what it alone needs, is evaluated only where all rules before it (and the base) pass."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10 if i % 7 == 0 else 30 + i % 2))) for i in range(200)], "doc_id bigint, text string")
    seen = F.raise_error(F.concat(F.lit("looked at "), F.col("n_words").cast("string"))).cast("boolean")
    rules = [Rule("odd", F.col("n_words") == 31), Rule("strict", F.when(F.col("n_words") != 30, seen).otherwise(F.size("words") < 0))]
    estimates = [{"rule": "odd", "cost": 1.0, "rejects": 0.5}, {"rule": "strict", "cost": 9.0, "rejects": 0.5}]
    got = {r.doc_id: r.kept for r in quality_cascade(docs, rules=rules, estimates=estimates).collect()}
    assert got == {i: i % 7 != 0 and i % 2 == 0 for i in range(200)}
    with pytest.raises(Exception, match="looked at"):
        quality_cascade(docs, rules=rules, estimates=[{**e, "rejects": 1 - 0.9 * (e["rule"] == "odd")} | {"cost": 1.0} for e in estimates]).collect()


def test_sample_comes_from_all_partitions(spark):
    docs = spark.createDataFrame([(i, f"p{i // 500} " + "word " * 30) for i in range(4000)], "doc_id bigint, text string").repartition(8, "doc_id").sortWithinPartitions("doc_id")
    rules = [Rule(f"p{k}", F.element_at("words", 1) == f"p{k}") for k in range(8)]
    from fillwise.llm.quality import _measured

    found = {e["rule"]: e["rejects"] for e in estimate(_measured(docs.select("text"), ["text"]), rules, rows=400)}
    assert all(0.04 < v < 0.25 for v in found.values()) and 0.99 < sum(found.values()) < 1.01


def test_empty_tables(spark):
    assert quality_cascade(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mix(docs).count() == 0 and apply_mix(docs).count() == 0


def words(n, k=0):
    return " ".join(f"w{i % (7 + k)}" for i in range(n))


def mixture(spark):
    rows = [(i, "abc"[i % 3], words(5 + i * 7 % 40, i)) for i in range(300)] + [(1000 + i, None, words(3)) for i in range(4)] + [(5, "b", None), (6, "b", ""), (7, "", words(9)), (None, "a", words(8))]
    rows += [(8, "c", words(11))] * 3
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, text string, size string")


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("ranges", [1, 64, 16384])
def test_mix(spark, ranges):
    rows, docs = mixture(spark)
    got = mix(docs, ranges=ranges).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_md5, r.taken)
    assert sorted(got, key=key) == sorted(mix(docs.repartition(7), ranges=ranges).collect(), key=key)


def test_selection_follows_the_keys(spark):
    """Without a second epoch, documents enter whole in the order of their keys until the words are owed no more."""
    _, docs = mixture(spark)
    one, many = (Counter((r.doc_id, r.text_md5, r.taken) for r in mix(docs, ranges=n).collect()) for n in (1, 4096))
    assert one == many


def test_apply_mix(spark):
    rows, docs = mixture(spark)
    out = apply_mix(docs)
    assert out.columns == docs.columns
    total = {}
    for r in out.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + len(WORD.findall(r.text))
    plan = {}
    for r in mix(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    assert total == {k: v for k, v in plan.items() if v}
