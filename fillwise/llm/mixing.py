"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

A target is set for each source by weight, with a ceiling of ``max_epochs`` times the source's own size; what a source
cannot take goes to the others by weight.  A source is first taken whole as often as its target allows; the rest is
drawn: every document gets the key ``-ln(u) / quality`` with u from a hash of the document, and documents enter in the
order of their keys until the words owed are reached.  The document that crosses that line gives its leading words
only, so that a source's words meet its target to the word.

The prefix sums never gather a source in one task: words are first summed by (source, key range); the range that
crosses the line is found on these sums, and only its documents (a 1/``ranges`` share) are sorted.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order;
equal keys are ordered by id and text; equal rows are interchangeable; an empty table gives an empty result; further
columns are ignored by ``mix`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.llm.common import SPACE_RUN, SPACES, any_order, materialize, n_words_column, neutral, restored

#: Sources up to which the table of sources is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
RANGES = 16_384
#: Hexadecimal digits of the hash that make u.
DIGITS = 12


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns: the same on every run and every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def document_quality(text: str = "text") -> Column:
    """1 for plain prose, down to 0.1 as symbols other than letters, digits and spaces pile up."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "#*$%&|<>!", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - odd.cast("double") / F.greatest(F.length(t), F.lit(1)))


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Water filling in closed form: in the order of ceiling per weight, a source is at its ceiling exactly if the level
    that the sources from it on would share is not below its own ratio.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(alone) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("long")).withColumn("cap", max_epochs * F.col("source_size"))
    # exact comparison of cap / weight by cross products is not needed: ties are at one level either way
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = ranked.withColumn("left", left).withColumn("weight_left", weight_left).withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    # from the first source below its ceiling on, the level stays
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), (-F.col("weight_left")).alias("after"), F.col("left").alias("left")))).over(everything)
    open_left, open_weight = first.getField("left"), -first.getField("after")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_left * F.col("weight") / open_weight)
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 11, text: str = "text", source: str = "source", doc_id: str = "doc_id", ranges: int = RANGES) -> DataFrame:
    """One row per document: its columns without the text, and size, source_size, target, taken."""
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words_column(F.col(f"`{text}`")).alias("size"),
        (-F.log(uniform(seed, F.col(f"`{doc_id}`"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))) / document_quality(text)).alias("key"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_md5"),
    )
    slim = materialize(slim)  # the texts are read once; all that follows works on a few numbers per document
    # exp(-key) is a key's place in (0, 1): ranges in ascending order of the key
    slim = slim.withColumn("range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("key"))) * ranges)).cast("int"))
    # both tables hold one row per source (and key range): a full pass over the documents is not needed again
    by_range = materialize(slim.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sizes = by_range.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    targets = targets.withColumn("owed", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    crossing = by_range.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)).cast("long"))
    t = targets.alias("t")
    crossing = crossing.alias("r").join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).where((F.col("before") < F.col("owed")) & (F.col("before") + F.col("words") >= F.col("owed")))
    crossing = crossing.select(F.col("r.source").alias("source"), F.col("range").alias("at"), "before")
    table = targets.alias("t").join(crossing.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", F.coalesce("at", F.lit(-1)).alias("at"), "before")
    table = materialize(table)
    n_sources = table.count()
    side = F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table
    joined = slim.alias("s").join(side.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target", "t.epochs", "t.owed", "t.at", "t.before")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(F.col("range") == F.col("at")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("owed") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    rest = joined.where(F.col("range") != F.col("at")).withColumn("part", F.when(F.col("range") < F.col("at"), F.col("size")).otherwise(0))
    return rest.unionByName(edge).select("doc_id", "source", "text_md5", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed documents themselves: each row as often as it was taken, the last copy cut to the words it gives.

    Returns the columns of ``docs``.  Rows that the mix does not take are left out.
    """
    original = docs.columns
    docs, own = neutral(docs, text=text, source=source, doc_id=doc_id)
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    fingerprint = F.md5(F.coalesce("text", F.lit("")))
    joined = docs.join(plan.where(F.col("_taken") > 0), F.col("doc_id").eqNullSafe(F.col("_id")) & (fingerprint == F.col("_md5")))
    # equal rows share what they were given: the first ones take the odd words
    same = Window.partitionBy("_id", "_md5").orderBy(any_order(joined, own))
    joined = joined.withColumn("_k", F.row_number().over(same) - 1)
    mine = F.floor(F.col("_taken") / F.col("_rows")) + F.when(F.col("_k") < F.col("_taken") % F.col("_rows"), 1).otherwise(0)
    joined = joined.withColumn("_mine", mine).where(F.col("_mine") > 0)
    joined = joined.select(*own, "_size", "_mine", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_mine") / F.col("_size")) - 1)).alias("_copy"))
    words = F.least(F.col("_size"), F.col("_mine") - F.col("_copy") * F.col("_size"))
    cut = F.concat_ws(" ", F.slice(F.split(F.btrim("text", F.lit(SPACES)), SPACE_RUN), 1, words.cast("int")))
    return restored(joined.withColumn("text", F.when(words >= F.col("_size"), F.col("text")).otherwise(cut)), own, original)
