"""Packing documents into sequences of fixed length by a configuration linear program.

A configuration is a set of piece lengths that fits one sequence.  The linear program over the length histogram asks
for the fewest configurations that hold every piece.  It is solved by multiplicative weights: each length has a
price; a knapsack over the prices (dynamic programming) gives, for every length, the best configuration that holds it;
those that are worth about as much as the best of all enter the solution, and the prices of the lengths that they use
fall.  The fractional solution is rounded: whole parts first, then the largest fractions, as far as the pieces go and the
sequences' empty room stays within what the program's value allows.  The program is solved again for what is left, a few
times; the last pieces go by best fit, longest first.

Tokens are counted in parallel; only the histogram (one number per length) reaches the driver, so the program's cost
does not depend on the number of documents.  The plan is a table of slots; each piece finds its slot from its rank
among the pieces of its length.  Ranks are counted within (length, chunk) and offset by sums over the chunks, so no
length, however common, is gathered in one task.

Defined results: a null or empty text is its end id alone; rows with equal ids are packed each; equal lengths are
ordered by chunk, id, text, piece; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.llm.common import materialize, ranges, slices
from fillwise.llm.tokens import append, encoder

#: Rows of a (length, chunk) group, about.
CHUNK_ROWS = 8_192
#: Settings of the program: up to so many distinct lengths, small steps; else large ones, since a round costs more.
FEW_LENGTHS = 128
FINE = ({"step": 0.05, "rate": 10.0, "slack": 0.01, "rounds": 400}, {"step": 0.25, "slack": 0.02})
COARSE = ({"step": 1.0}, {"step": 0.5})


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(worth of the dearest filling of each room, the length that it ends with or 0); lengths (indices) of price 0 are out.

    Of fillings of one worth that with the longest piece is taken, which leaves short pieces for later."""
    items = np.flatnonzero(prices > 0)[::-1]
    price = prices[items]
    first = len(items) - np.searchsorted(items[::-1], np.arange(capacity + 1), "right")
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = first[room]
        if k < len(items):
            worth = best[room - items[k:]] + price[k:]
            j = int(worth.argmax())
            if worth[j] > best[room] + 1e-12:
                best[room], choice[room] = worth[j], items[k + j]
    return best, choice.tolist()


def filling(choice: list[int], room: int) -> list[int]:
    """The lengths of the dearest filling of ``room``."""
    out = []
    while room > 0:
        if choice[room]:
            out.append(choice[room])
        room -= choice[room] or 1
    return out


Configuration = tuple[int, ...]


def solve(counts: np.ndarray, capacity: int, step: float = 1.0, rate: float = 1.0, slack: float = 0.05, rounds: int = 160) -> tuple[dict[Configuration, float], np.ndarray]:
    """(configurations with fractions, the covered share of each length): multiplicative weights.

    A length starts at the price of its size and loses a factor e**-rate until it is covered; a covered one is free.  In a
    round a length is covered by a share ``step`` at most, and only configurations worth (1 - slack) of the best enter."""
    size = np.arange(capacity + 1) / capacity
    covered = np.where(counts > 0, 0.0, 1.0)
    columns: dict[Configuration, float] = {}
    n = counts.tolist()
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        prices = np.zeros(capacity + 1)
        prices[open_] = size[open_] * np.exp(-rate * covered[open_])
        best, choice = knapsack(prices, capacity)
        good = open_[prices[open_] + best[capacity - open_] >= (1 - slack) * best[capacity]]
        most, share = np.minimum(1.0, covered + step).tolist(), covered.tolist()
        for length in good[::-1].tolist():
            if share[length] >= most[length] - 1e-9:
                continue
            items = (length, *filling(choice, capacity - length))
            used = Counter(items)
            x = min((most[i] - share[i]) * n[i] / k for i, k in used.items())
            if x > 1e-9:
                columns[items] = columns.get(items, 0.0) + x
                for i, k in used.items():
                    share[i] += k * x / n[i]
        covered = np.array(share)
    return columns, covered


def value(columns: dict[Configuration, float], covered: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Sequences that the fractional solution takes; what it leaves uncovered counts by its size."""
    return sum(columns.values()) + float((counts * (1 - np.minimum(covered, 1)) * np.arange(capacity + 1)).sum()) / capacity


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, how many sequences): best fit, longest first, many equal ones at a time."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    free = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = np.flatnonzero(free[length:])
            if not len(at):
                per = min(capacity // length, left)
                n = left // per
                left -= n * per
                room = capacity - per * length
                groups.setdefault(room, []).append(([length] * per, n))
                free[room] += n
                continue
            room = length + int(at[0])
            items, n = groups[room].pop()
            take = min(n, left)
            if n > take:
                groups[room].append((items, n - take))
            free[room] -= take
            groups.setdefault(room - length, []).append(([*items, length], take))
            free[room - length] += take
            left -= take
    return [g for held in groups.values() for g in held]


Plan = list[tuple[list[int], int]]


def rounded(counts: np.ndarray, capacity: int, most_rounds: int = 8, **options) -> list[Plan]:
    """The whole configurations of each round: solve, round, solve again for what is left."""
    left, size = counts.astype(np.int64), np.arange(capacity + 1)
    out: list[Plan] = []
    for _ in range(most_rounds):
        before = int(left.sum())
        if not before:
            break
        columns, covered = solve(left, capacity, **options)
        room = max(0.0, np.ceil(value(columns, covered, left, capacity) - 1e-6) * capacity - float((left * size).sum()))
        have = left.tolist()
        found: Counter[Configuration] = Counter()
        # full configurations first, the largest fractions first
        order = sorted(columns.items(), key=lambda c: (capacity - sum(c[0]), -(c[1] % 1), c[0]))
        for part in (lambda x: int(x + 1e-9), lambda x: int(x % 1 > 1e-9)):
            for items, x in order:
                used, waste = Counter(items), capacity - sum(items)
                n = min(part(x), *(have[i] // k for i, k in used.items()))
                n = min(n, int(room // waste)) if waste else n
                if n > 0:
                    room -= waste * n
                    found[items] += n
                    for i, k in used.items():
                        have[i] -= k * n
        out.append([(list(items), n) for items, n in found.items()])
        left = np.array(have)
        if before - int(left.sum()) < 0.02 * before:
            break
    return out


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """(lengths, how many sequences) that use every piece of the histogram ``counts`` (index = length) exactly once.

    The program is solved in coarse or, where lengths are few, fine steps, and one or more of its rounds are kept, or of
    these the full configurations; the fewest sequences win, equal ones with the most of the program's configurations."""
    counts = counts.astype(np.int64)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)  # nothing can be fewer
    few = int((counts > 0).sum()) <= FEW_LENGTHS
    tries: list[Plan] = []
    for options in FINE if few else COARSE:
        found = rounded(counts, capacity, **options)
        kinds = [[c for part in found[:k] for c in part] for k in (len(found), 2, 1) if k <= len(found)]
        for kept in [*kinds, [c for c in kinds[0] if sum(c[0]) == capacity] if kinds else []]:
            left = counts.copy()
            for items, n in kept:
                np.subtract.at(left, items, n)
            tries.append(kept + best_fit(left, capacity))
            if sum(n for _, n in tries[-1]) == least:
                return tries[-1]
    return min(tries, key=lambda t: sum(n for _, n in t), default=[])


def slots(found: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as runs of slots: by length, ranks first..first+n-1 go to sequences sequence.. at one offset."""
    rows, sequence = [], 0
    next_rank = np.zeros(capacity + 1, np.int64)
    for items, n in found:
        offset = 0
        for length in items:
            rows.append((length, next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 4)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "key": table[:, 0] << 44 | table[:, 1]}


def token_pieces(docs: DataFrame, tokenizer: str, pieces: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tie, piece, start, length, ids_crc32): the pieces of every document."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pieces).encode
        for batch in slices(batches, rows=8192, size=12_000_000):
            ids, bounds = append(*encode(batch.column(1)), end_id)
            n = np.diff(bounds)
            parts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = ranges(parts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            view = memoryview(ids.astype("<u4")).cast("B")
            begin = bounds[doc] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "tie", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id long, tie long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, pieces: str, end_id: int, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(token_pieces(docs, tokenizer, pieces, end_id, capacity, doc_id, text))
    histogram = cut.groupBy("length").count().collect()  # one row per length: at most ``capacity``
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    held = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity), capacity))
    chunks = max(1, min(1 << 20, int(counts.max(initial=0)) // CHUNK_ROWS + 1))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(chunks)).cast("int"))
    sums = cut.groupBy("length", "chunk").count()
    along = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "chunk", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "tie", "piece")
    ranked = cut.select(*own, "chunk", (F.row_number().over(inside) - 1).alias("k")).join(sums, ["length", "chunk"]).select(*own, (F.col("first") + F.col("k")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(s["key"], length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s["sequence"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])], [*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
