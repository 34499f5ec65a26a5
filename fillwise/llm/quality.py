"""Quality rules as a short-circuit cascade.

Each rule is a boolean column that is true where a document is rejected.  Cost and rejected share of each rule are
estimated on a small sample from all partitions; the rules then run in the order of rejected share per cost, and a
document that one rule rejects is not looked at by the next (one CASE, so a later rule is not evaluated, nor what it
alone needs).  The order changes the cost only: a document is kept exactly if no rule rejects it.

Only what every document is reported with (BASE) is computed up front; a rule counts whatever else it needs within its
own expression.  Documents that fail the base rule skip the cascade.

Defined results: a null or empty text has no words and fails the base rule; equal rows give equal results; an empty
table gives an empty result; further columns are passed on, whatever their names (a result's name is taken over).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import SPACE_RUN, SPACES, discard, materialize, neutral, restored, trimmed

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What every document is reported with, and all that ``measures`` adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule turns down.

    It may read BASE and the columns ``text``, ``words`` (array) and ``lines`` (array of the lines that hold a word)."""

    name: str
    rejects: Column


def same_words() -> Column:
    """How many words are the word before them."""
    following = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    return F.size(F.filter(F.zip_with("words", following, lambda a, b: a == b), lambda x: x)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add MEASURES; columns of the input with these names are replaced."""
    df, names = neutral(docs, text=text)
    df = _measured(df, names).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_same_words", same_words())
    return restored(df, names, docs.columns, MEASURES)


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """``words``, ``lines`` and BASE of the column ``text``, behind the columns ``names``.

    The chain of projections keeps every array that is used twice a column of its own, so that none is computed
    again for each element of another.
    """
    own = [F.col(c) for c in names]
    whole = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*own, trimmed("text").alias("_t"))
    df = df.select(*own, "_t", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACE_RUN)).alias("words"))
    # the characters of SYMBOLS all count as themselves within brackets
    symbols = F.length("_t") - F.length(F.regexp_replace("_t", f"[{SYMBOLS}]", ""))
    df = df.select(
        *own, "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    kept = [*own, "words", "lines", "n_words", "word_chars", "n_symbols"]
    for span in (1, 2, 4):
        # hash of 2, 4, 8 words from each position on; what runs over the end is null
        df = df.select(*kept, F.zip_with(f"_h{span}", F.slice(f"_h{span}", span + 1, F.greatest(F.size(f"_h{span}"), F.lit(1))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))).alias(f"_h{2 * span}"))
    windows = F.when(F.col("n_words") >= WINDOW, F.slice("_h8", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, windows.alias("_v"))
    # only texts with a window that occurs again are sorted
    again = F.size(F.array_distinct("_v")) < F.size("_v")
    ordered = F.when(again, F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*kept, ordered.alias("_s"))
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    neighbours = F.arrays_zip(F.col("_s").alias("own"), F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))).alias("after"), F.concat(F.array(none), F.col("_s")).alias("before"))
    df = df.select(*kept, F.when(F.col("_s").isNotNull(), neighbours).alias("_z"))
    hit = F.filter("_z", lambda e: (e["own"]["h"] == e["after"]["h"]) | (e["own"]["h"] == e["before"]["h"]))
    places = F.array_sort(F.transform(hit, lambda e: e["own"]["i"].cast("long")))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return df.select(
        *kept,
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_z").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """The bounds are lenient: they turn down junk, not unusual prose."""
    text = F.coalesce("text", F.lit(""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 4 * F.size("lines"))),
        Rule("shouting", 5 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > 2 * F.col("n_words")),
        Rule("stutter", 2 * same_words() > F.col("n_words")),  # half of the words are the word before them
    ]


def estimate(measured: DataFrame, rules: list[Rule], rows: int = 1000, share: float | None = None, seed: int = 7, repeats: int = 16) -> list[dict]:
    """Rejected share and cost (seconds a row) of each rule on about ``rows`` rows drawn from all partitions.

    Each rule is evaluated ``repeats`` times on every row of the sample in one task; a run of the same rows without a
    rule is taken off.  What two such runs differ by is the least cost that can be told.  The sample bounds the work,
    not the result: only the order of the rules depends on it.  It reads the texts' columns once more, which is little
    beside measuring them; a caller who runs often can hand ``quality_cascade`` the estimates of an earlier run."""
    if share is None:
        share = min(1.0, rows / max(1, measured.count()))
    drawn = materialize((measured.sample(share, seed=seed) if share < 1 else measured).repartition(1))
    sample = drawn.persist()
    again = F.explode(F.array(*map(F.lit, range(repeats))))
    try:
        n = max(1, sample.count())

        def timed(column: Column) -> tuple[float, float]:
            for _ in range(2):  # the first run also compiles
                began = time.perf_counter()
                hits = sample.select("*", again.alias("_again")).agg(F.sum(F.when(column, 1).otherwise(0))).first()[0] or 0
            return time.perf_counter() - began, hits / repeats / n

        nothing = F.col("text").isNull() & F.col("text").isNotNull()
        idle = sorted(timed(nothing)[0] for _ in range(2))
        took = {r.name: timed(r.rejects) for r in rules}
    finally:
        sample.unpersist()
    discard(drawn)
    return [{"rule": r.name, "cost": max(took[r.name][0] - idle[0], idle[1] - idle[0]) / (n * repeats), "rejects": took[r.name][1]} for r in rules]


def ordered_rules(rules: list[Rule], estimates: list[dict]) -> list[Rule]:
    """Most rejections per cost first; equal ones by name."""
    value = {e["rule"]: e["rejects"] / e["cost"] if e["cost"] > 0 else (float("inf") if e["rejects"] else 0.0) for e in estimates}
    return sorted(rules, key=lambda r: (-value[r.name], r.name))


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule in order that rejects the row, else null.  CASE stops at the first hit."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].rejects, rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects, rule.name)
    return out


def quality_cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, estimates: list[dict] | None = None, sample_rows: int = 1000) -> DataFrame:
    """``docs`` with BASE, ``base_failed`` and ``kept``; columns of the input with these names are replaced.

    ``rules`` default to ``default_rules``; ``estimates`` (of ``estimate``) can be given, else a sample is taken."""
    rules = default_rules() if rules is None else rules
    df, names = neutral(docs, text=text)
    measured = _measured(df, names)
    if estimates is None:
        # the share is known before anything is measured, so that only the sample is
        share = min(1.0, sample_rows / max(1, docs.count()))
        drawn = df.select("text").sample(share, seed=7) if share < 1 else df.select("text")
        estimates = estimate(_measured(drawn, ["text"]), rules, share=1.0)
    # always true; being nondeterministic to the optimizer, it keeps a filter on ``kept`` above the measures, which
    # would else be put into the filter in full for each mention
    once = F.monotonically_increasing_id() >= 0
    judged = measured.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(once & verdict(ordered_rules(rules, estimates)).isNull()))
    return restored(judged, names, docs.columns, [*BASE, "base_failed", "kept"])
