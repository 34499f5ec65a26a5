"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term.  A block of candidates is an inverted file: for each term the candidates' weights, in one
contiguous posting list.  Query rows are sparse (term, weight) lists; term by term their weighted postings are
scattered into a dense array of scores, from which each query's best k are picked by partition selection.  The picks
of all blocks are merged by query.

Queries are broadcast in chunks of at most ``chunk`` rows (their number is checked, each further chunk is one more
pass over the candidates); candidates are never moved.  Scores are exact: single precision while every partial sum
fits 24 bits, double while it fits 53, Python integers beyond (a score that no 64-bit integer holds is an error).

A query's own row is a candidate like any other until the merge, which asks for one more and takes the own row out.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; queries and candidates are rows, so each of several rows with one id is answered (under that id) and is
a candidate for the others; a null id takes no part; ties go to the smaller id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.llm.common import materialize

#: Candidates and queries that meet in one dense array of scores (4 bytes each).
BLOCK, QUERY_BLOCK = 2048, 512
#: Query rows of one broadcast; at 64 components of 8 bytes, 8 MB.
CHUNK = 16_384


def quantized(embedding: str, factor: int = 64) -> Column:
    """floor(factor * x) of every component, x as double."""
    return F.transform(F.col(f"`{embedding}`"), lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(embedding: str) -> Column:
    e = F.col(f"`{embedding}`")
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def dense(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of numbers as a matrix, padded with zeros."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def score_type(queries: np.ndarray, candidates: np.ndarray):
    """The smallest type in which every partial sum is exact."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, min(queries.shape[1], candidates.shape[1]))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def accumulate(queries: np.ndarray, postings: np.ndarray, scores: np.ndarray, work: np.ndarray) -> None:
    """scores[i, j] = inner product, term at a time; ``postings`` has one row per term."""
    scores[:] = 0
    for term in range(min(queries.shape[1], postings.shape[0])):
        weights = queries[:, term]
        rows = np.flatnonzero(weights)
        if len(rows) == len(weights):
            np.multiply(weights[:, None], postings[term][None, :], out=work)
            scores += work
        elif len(rows):
            scores[rows] += weights[rows, None] * postings[term][None, :]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best columns, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    rows_out, ids_out, score_out = [], [], []
    floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k and scores.dtype != object else None
    for r, row in enumerate(scores):
        at = np.flatnonzero(row >= floor[r]) if floor is not None else np.arange(n)
        at = at[np.argsort(-row[at], kind="stable")[:k]]
        rows_out.append(np.full(len(at), r))
        ids_out.append(ids[at])
        score_out.append(row[at].astype(np.int64) if row.dtype != object else np.array(row[at], dtype=object))
    return np.concatenate(rows_out), np.concatenate(ids_out), np.concatenate(score_out)


def search(ids: np.ndarray, matrix: np.ndarray, query_matrix: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query block's best k among the candidates given: (row of ``query_matrix``, vec_id, score)."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    kind = score_type(query_matrix, matrix)
    postings = np.ascontiguousarray(matrix.T.astype(kind))
    for at in range(0, len(query_matrix), QUERY_BLOCK):
        q = query_matrix[at : at + QUERY_BLOCK].astype(kind)
        found: list[tuple] = []
        for b in range(0, len(ids), BLOCK):
            scores = np.zeros((len(q), len(ids[b : b + BLOCK])), kind)
            accumulate(q, postings[:, b : b + BLOCK], scores, np.empty_like(scores))
            found.append(best(scores, ids[b : b + BLOCK], k))
        rows, vec, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((vec, -score.astype(np.int64) if score.dtype != object else -score, rows))
        rows, vec, score = rows[order], vec[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        yield rows[keep] + at, vec[keep], score[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 64, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products."""
    spark = vectors.sparkSession
    good = vectors.where(usable(embedding) & F.col(f"`{vec_id}`").isNotNull())
    rows = good.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), quantized(embedding, factor).alias("v"))
    # equal query rows are asked once and answered each
    asked = good.where(is_query).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), quantized(embedding, factor).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    chunks = max(1, -(-asked.count() // chunk))
    schema = "query int, query_id long, copies long, vec_id long, score long, own boolean"
    parts = []
    for c in range(chunks):
        some = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)) == c)
        got = some.orderBy("vec_id", "v").toArrow()  # bounded by the size of a chunk
        lists = got.column("v").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if got.num_rows else pa.array([], pa.list_(pa.int64()))
        held = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), got.column("copies").to_numpy(), dense(lists)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            query_ids, copies, query_matrix = held.value
            wide = query_matrix.astype(object) if np.abs(query_matrix).max(initial=0) >= 1 << 28 else query_matrix
            own_score = (wide * wide).sum(1)
            group: list[pa.RecordBatch] = []

            def flush() -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches(group)
                lists = t.column("v").combine_chunks()
                for q, v, s in search(t.column("vec_id").to_numpy(), dense(lists), query_matrix, k + 1):
                    score = pa.array([int(x) for x in s] if s.dtype == object else s, pa.int64())
                    own = pa.array((v == query_ids[q]) & (s == own_score[q]), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(query_ids[q], pa.int64()), pa.array(copies[q], pa.int64()), pa.array(v, pa.int64()), score, own], ["query", "query_id", "copies", "vec_id", "score", "own"])

            for batch in batches:
                if not batch.num_rows or not len(query_ids):
                    continue
                group.append(batch)
                if sum(b.num_rows for b in group) >= 16 * BLOCK:
                    yield from flush()
                    group = []
            if group:
                yield from flush()

        part = _merge(rows.mapInArrow(run, schema), k)
        parts.append(part if chunks == 1 else materialize(part))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query without its own row.

    The own row is one with the query's id and its score with itself; it can't be told from others like it, nor need it."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best_ = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    best_ = best_.withColumn("owns", F.sum(F.col("own").cast("int")).over(upto))
    rank = F.col("place") - F.least(F.col("owns"), F.lit(1))
    best_ = best_.withColumn("rank", rank.cast("int")).where(~(F.col("own") & (F.col("owns") == 1)) & (F.col("rank") <= k))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return best_.select("query_id", "rank", "vec_id", "score", again).drop("_copy")
