"""Substring deduplication by relative Lempel-Ziv parsing.

A passage of ``window`` words is a duplicate if the same words also start in a document with a smaller id.

The reference is indexed by anchors: of the n-grams of ``window // 2 + 1`` words inside every window, the one with
the smallest hash.  A window that occurs twice has the same anchor both times, so the anchors (about one word in
thirteen) are enough to find every reference.  For each occurrence of an anchor the index gives two reference blocks: the
first document that holds it and the last one before its own.

Every document is then factored greedily against the indexed references: a factor is the longest run of anchors that
stand in one earlier document at one distance.  Neighbouring anchors overlap, so the words of a factor are equal
throughout, and every window inside is a duplicate.  Windows that reach over a factor's boundary, and those of an
anchor's first document, are checked by their own 128-bit hash: a window is a duplicate if its hash has a smaller
document.  The smallest document of a window never finds it inside a factor, so the check is exact, whatever references
the index gave.

Shuffled are anchors, boundary windows and the texts.  No key is hot: those with more than 1 / HOT_KEYS of all rows (there
can't be more than HOT_KEYS of them) are found by sums that are combined before the shuffle; these sums are broadcast, and
such a key's rows are dealt out in shares.

Defined results: a null text has no words; a null id is never a reference and loses nothing; rows with one id do not
count against each other; equal rows give equal results; an empty table gives an empty result; columns of the input
are kept, whatever their names (a result's name is taken over).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fillwise.llm.common import HOT_KEYS, HOT_ROWS, Words, discard, grams, materialize, neutral, restored, slices

#: Bits of a place within a batch, in the keys from which the smallest is taken.
PLACE_BITS = 30
#: Shares of a frequent key's rows.
SALTS = 4096
SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def sliding_min(keys: np.ndarray, n: int) -> np.ndarray:
    """The minimum of n consecutive keys from each place on."""
    out, span = keys, 1
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = n - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """The windows of a batch of texts: ``at`` their first words, ``text`` their texts, ``anchor`` their anchors' places."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        starts = self.words.starts
        self.span = window // 2 + 1
        self.grams = grams(self.hashes, self.span)
        per_text = np.maximum(self.words.lengths - window + 1, 0)
        self.text = np.repeat(np.arange(len(per_text)), per_text)
        self.at = np.arange(int(per_text.sum())) + np.repeat(starts[:-1] - (np.cumsum(per_text) - per_text), per_text)
        if len(self.at):
            keys = (self.grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(self.grams), dtype=np.uint64)
            low = sliding_min(keys, window - self.span + 1)
            self.anchor = (low[self.at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        else:
            self.anchor = np.zeros(0, np.int64)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tie, anchor, place) lists of every document with a window; place is the word's number in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Windows(batch.column(2), window)
            place = np.unique(w.anchor)
            text = np.searchsorted(w.words.starts, place, "right") - 1
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            rows = np.flatnonzero(np.diff(bounds))
            ends = pa.array(np.concatenate(([0], bounds[rows + 1])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(w.grams[place].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((place - w.words.starts[text]).astype(np.int32)))],
                ["doc_id", "tie", "anchors", "places"],
            )

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, anchors array<long>, places array<int>")


def factors(place: np.ndarray, references: list[tuple[np.ndarray, np.ndarray]], doc_id: int, span: int) -> list[tuple[int, int]]:
    """(first word, end) of the runs of anchors that stand in one earlier document at one distance.

    ``references`` has (document, text's tie and place in one number) of each place; a run goes on while one of its
    documents does.  Places ascend."""
    found: list[set] = [set() for _ in place]
    for docs, refs in references:
        for k in np.flatnonzero(docs < doc_id).tolist():
            ref = int(refs[k])
            found[k].add((int(docs[k]), ref >> 32, (ref & 0xFFFFFFFF) - int(place[k])))
    at_words = place.tolist()
    out, at = [], 0
    while at < len(at_words):
        active, to = found[at], at
        while active and to + 1 < len(at_words) and at_words[to + 1] - at_words[to] <= span and active & found[to + 1]:
            to += 1
            active = active & found[to]
        if active:
            out.append((at_words[at], at_words[to] + span))
        at = to + 1
    return out


def covered(n: int, window: int, spans: list[tuple[int, int]], starts: np.ndarray | None) -> np.ndarray:
    """Which of n words lie in a span of at least ``window`` words or a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    for a, b in spans:
        if b - a >= window:
            step[a] += 1
            step[b] -= 1
    if starts is not None and len(starts):
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def _result(text: str | None, gone: np.ndarray | None, keep_text: bool) -> tuple[int, int, str, str | None]:
    """(n_words, n_removed, kept_sha256, kept text)."""
    words = (text or "").encode().split()
    kept = words if gone is None or not gone.any() else list(compress(words, ~gone))
    joined = b" ".join(kept)
    same = len(kept) == len(words)
    return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), (text if same else joined.decode()) if keep_text else None


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def dedup_substrings(docs: DataFrame, window: int = 50, keep_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256; the text is what is left of it (or null unless ``keep_text``).

    A text that loses nothing stays as it is; of others the kept words are joined by one space."""
    if window < 4:
        raise ValueError("a window has 4 words at least")
    original = docs.columns
    docs, own = neutral(docs, doc_id=doc_id, text=text)
    text = "text"
    text_at = own.index(text)
    docs = docs.select(*own, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tie"))
    slim = docs.select(F.col("_id").alias("doc_id"), F.col("_tie").alias("tie"), F.col(f"`{text}`").alias("text"))
    found = materialize(anchors(slim, window))
    rows = found.select("doc_id", "tie", F.explode(F.arrays_zip("anchors", "places")).alias("a"))
    # 32 bits of the text's tie and the place in one number; it tells rows of one id apart as well
    rows = rows.select(F.col("a.anchors").alias("anchor"), "doc_id", F.shiftleft("tie", 32).bitwiseOR(F.col("a.places").cast("long")).alias("at"))
    one = F.struct("doc_id", "at")
    total = found.agg(F.sum(F.size("anchors"))).first()[0] or 0
    sums = rows.groupBy("anchor").agg(F.min(one).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    hot = materialize(sums.where((F.col("n") >= max(HOT_ROWS, total // HOT_KEYS)) & (F.col("last") > F.col("first.doc_id"))).select("anchor", "first"))
    # the rows of a frequent anchor are dealt out by place; each share gives references of its own beside the first of all
    known = rows.join(F.broadcast(hot.withColumnRenamed("first", "first_of_all")), "anchor", "left")
    known = known.withColumn("salt", F.when(F.col("first_of_all").isNotNull(), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))).otherwise(0))
    share = Window.partitionBy("anchor", "salt")
    earlier = share.orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    again = F.col("first_of_all").isNotNull() | (F.min("doc_id").over(share) < F.max("doc_id").over(share))
    matched = known.select("doc_id", "at", F.coalesce("first_of_all", F.first(one).over(earlier)).alias("first"), F.last(one).over(earlier).alias("before"), again.alias("again")).where("again")
    fields = [F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("place")]
    for k in ("first", "before"):
        fields += [F.coalesce(F.col(f"{k}.doc_id"), "doc_id").alias(f"{k}_doc"), F.coalesce(F.col(f"{k}.at"), F.lit(0)).alias(f"{k}_at")]
    matched = matched.groupBy(F.col("doc_id").alias("_mid"), F.shiftright("at", 32).cast("int").alias("_mtie")).agg(F.collect_list(F.struct(*fields)).alias("_found"))
    low = F.shiftright(F.shiftleft("_tie", 32), 32).cast("int")
    joined = docs.join(matched, (F.col("_id") == F.col("_mid")) & (low == F.col("_mtie")), "left").drop("_mid", "_mtie")

    pending = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in own)).schema, T.StructField("_id", T.LongType()), T.StructField("_tie", T.LongType()), *_RESULT, *(T.StructField(f"_{n}", T.ArrayType(k)) for n, k in (("begin", T.IntegerType()), ("end", T.IntegerType()), ("start", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in pending]
        for batch in slices(batches, text):
            lists = batch.column(len(own) + 2)
            n = batch.num_rows
            texts = batch.column(text_at).to_pylist()
            ids = batch.column(len(own)).to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            starts: list[np.ndarray | None] = [None] * n
            h1: list[np.ndarray | None] = [None] * n
            h2: list[np.ndarray | None] = [None] * n
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                part = batch.take(pa.array(some))
                w = Windows(part.column(text_at), window)
                bounds = w.words.starts
                first, second = (grams(w.hashes, window, s).view(np.int64) for s in SEEDS)
                window_bounds = np.searchsorted(w.text, np.arange(len(some) + 1))
                lists = part.column(len(own) + 2)
                offsets, flat = lists.offsets.to_numpy(), lists.values
                place, *references = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
                for j, row in enumerate(some.tolist()):
                    a, b = offsets[j], offsets[j + 1]
                    one, at = np.unique(place[a:b], return_index=True)
                    held = [x[a:b][at] for x in references]
                    runs = factors(one, [(held[0], held[1]), (held[2], held[3])], ids[row], w.span)
                    spans[row] = [r for r in runs if r[1] - r[0] >= window]
                    own_at = w.at[window_bounds[j] : window_bounds[j + 1]]
                    own_anchor = w.anchor[window_bounds[j] : window_bounds[j + 1]] - bounds[j]
                    k = np.minimum(np.searchsorted(one, own_anchor), len(one) - 1)
                    open_ = one[k] == own_anchor
                    local = own_at - bounds[j]
                    for s, e in spans[row]:
                        open_ &= (local < s) | (local + window > e)
                    if open_.any():
                        starts[row] = local[open_]
                        h1[row], h2[row] = first[own_at[open_]], second[own_at[open_]]
            results = []
            for i in range(n):
                if starts[i] is None:
                    size = max((e for _, e in spans[i]), default=0)
                    gone = None
                    if size:
                        size = len((texts[i] or "").encode().split())
                        gone = covered(size, window, spans[i], None)
                    results.append(_result(texts[i], gone, keep_text))
                else:
                    results.append((None, None, None, texts[i]))
            columns = batch.columns[: len(own)]
            columns[text_at] = pa.array([r[3] for r in results], pa.string())
            columns += [batch.column(len(own)), batch.column(len(own) + 1)]
            columns += [pa.array([r[k] for r in results], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            columns += [pa.array([None if x is None else x.astype(np.int32) for x in starts], pa.list_(pa.int32()))]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays(columns, names)

    parsed = materialize(joined.mapInArrow(parse, pending))
    discard(found, hot)
    open_ = parsed.where(F.col("_start").isNotNull())
    checks = open_.select("_id", "_tie", F.explode(F.arrays_zip("_start", "_h1", "_h2")).alias("c")).select("_id", "_tie", F.col("c._start").alias("start"), F.col("c._h1").alias("h1"), F.col("c._h2").alias("h2"))
    total = parsed.agg(F.sum(F.when(F.col("_start").isNotNull(), F.size("_start")))).first()[0] or 0
    sums = checks.groupBy("h1", "h2").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count(F.lit(1)).alias("n"))
    often = materialize(sums.where((F.col("n") >= max(HOT_ROWS, total // HOT_KEYS)) & (F.col("most") > F.col("least"))).select("h1", "h2", "least"))
    known = checks.join(F.broadcast(often.withColumnRenamed("least", "least_of_all")), ["h1", "h2"], "left")
    known = known.withColumn("salt", F.when(F.col("least_of_all").isNotNull(), F.pmod(F.xxhash64("_id", "start"), F.lit(SALTS))).otherwise(0))
    repeats = known.withColumn("least", F.coalesce("least_of_all", F.min("_id").over(Window.partitionBy("h1", "h2", "salt")))).where(F.col("least") < F.col("_id"))
    again = repeats.groupBy(F.col("_id").alias("_aid"), F.col("_tie").alias("_atie")).agg(F.collect_set("start").alias("_again"))
    finished = parsed.where(F.col("_start").isNull()).select(*(F.col(f"`{c}`") for c in own), "n_words", "n_removed", "kept_sha256")
    rest = open_.drop("n_words", "n_removed", "kept_sha256", "_start", "_h1", "_h2").join(again, (F.col("_id") == F.col("_aid")) & (F.col("_tie") == F.col("_atie")), "left").drop("_id", "_tie", "_aid", "_atie")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*own, "n_words", "n_removed", "kept_sha256"]
        for batch in slices(batches, text):
            begin, end, extra = (batch.column(len(own) + k).to_pylist() for k in range(3))
            results = []
            for t, b, e, x in zip(batch.column(text_at).to_pylist(), begin, end, extra):
                n = len((t or "").encode().split())
                gone = covered(n, window, list(zip(b, e)), np.array(x or [], np.int64))
                results.append(_result(t, gone, keep_text))
            columns = batch.columns[: len(own)]
            columns[text_at] = pa.array([r[3] for r in results], pa.string())
            columns += [pa.array([r[k] for r in results], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in own)).schema, *_RESULT])
    return restored(finished.unionByName(rest.mapInArrow(finish, schema)), own, original, [f.name for f in _RESULT])
