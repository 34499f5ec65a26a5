"""Binary token files with Re-Pair grammar compression.

The documents are dealt out by ranges of ``doc_id`` and written shard by shard, in ascending order (null ids last,
equal ids by text).  A shard is a self-contained block of bytes, kept as one row of a Parquet folder, so that Spark's
commit protocol covers it.  Layout, little-endian:

    "RPG2" | u32 docs | u32 rules | u64 symbols | u64 ids | u8 bits of a symbol (16 or more) | u32 base
    docs x (i64 doc_id, u8 null, u32 ids of the document, u32 its symbols)
    rules x left, rules x right            nonterminal r is symbol base + r; its parts are smaller symbols
    symbols x symbol

A run of symbols is their low 16 bits one after the other, then each higher bit as a plane of n bits, padded to a byte.

Re-Pair replaces the most frequent pair of neighbours by a new nonterminal, again and again, until no pair is
frequent.  Here a round replaces all frequent pairs at once (most frequent first where they overlap): the counts come
from one sort of the shard's pairs, and the number of rounds is logarithmic.  No pair reaches over the end of a
document, so a document is a run of symbols; the expansion lengths, summed from the rules, lead to any id within it without decoding
the rest.

Defined results: a null or empty text is its end id alone; rows with equal ids are all written; an empty table gives
no shard and an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillwise.llm.common import ranges, shared_dir, slices
from fillwise.llm.tokens import append, encoder

MAGIC = b"RPG2"
HEAD = "<4sIIQQBI"
#: Ids of a shard, at least, before it is closed.
SHARD_IDS = 1_000_000
#: Pieces that a Python worker remembers.
CACHE = 1_250_000
#: A pair is replaced if it occurs so often in its shard; a round must save this share of the symbols for another.
LEAST, WORTH = 4, 0.0
#: Rules of a round, at most; the most frequent pairs come first.
ROUND = 4096
SLOT_BITS = 19


def _slots(pairs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        if pairs.dtype == np.uint32:
            return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _codes(bits: int) -> tuple[type, np.unsignedinteger, np.unsignedinteger]:
    """(type of a pair, its shift and mask) for symbols of ``bits``."""
    kind = np.uint32 if bits == 16 else np.uint64
    return kind, kind(bits), kind((1 << bits) - 1)


def most_frequent(count: np.ndarray, room: int) -> np.ndarray:
    """Places of the ``room`` highest counts (below 2^31), the highest first and equal ones in order."""
    # one number holds a count and its place, so that all but ``room`` need no sorting
    key = (-count.astype(np.int64) << np.int64(32)) | np.arange(len(count))
    if room < len(key):
        key.partition(room)
    return np.sort(key[:room]) & np.int64(0xFFFFFFFF)


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, least: int = LEAST, worth: float = WORTH, most_rules: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds of the documents' symbols, rules).  By default it ends when no pair is frequent.

    A pair of known symbols only gets rarer, and a round's new pairs hold a symbol of that round.  So a pair that was
    counted below ``least`` is never frequent again, and each round counts the others only."""
    if most_rules is None:
        most_rules = len(ids)
    # a pair in one number; half the width as long as all symbols fit 16 bits
    kind, shift, mask = _codes(16 if base < 65536 else 32)
    s = ids.astype(np.uint32)
    full = np.diff(bounds) > 0
    ends = bounds[1:][full] - 1  # the last symbol of each document
    rules: list[np.ndarray] = []
    n_rules = 0
    live = np.ones(len(s), bool)  # whether the pair that starts here may be frequent
    live[ends] = False
    while n_rules < most_rules:
        at = np.flatnonzero(live)
        if not len(at):
            break
        code = (s.take(at).astype(kind, copy=False) << shift) | s.take(at + 1)
        ordered = np.sort(code)
        edge = np.flatnonzero(ordered[1:] != ordered[:-1])
        edge = np.concatenate(([0], edge + 1))
        count = np.diff(edge, append=len(ordered)).astype(np.int32)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        slots = _slots(code)
        table = np.full(1 << SLOT_BITS, -2, np.int32)  # -2: rare, -1: frequent
        table[_slots(ordered[edge[often]])] = -1
        room = min(most_rules - n_rules, ROUND)
        if len(often) > room:
            often = often[most_frequent(count[often], room)]
        # a pair is found by a hash into a table; of two pairs in one slot the more frequent one is replaced now
        order = np.argsort(count[often], kind="stable")
        pairs, count = ordered[edge[often]][order], count[often][order]
        table[_slots(pairs)] = np.arange(len(pairs), dtype=np.int32)
        rank = table.take(slots)
        live[at] = rank > -2  # a rare pair in a frequent one's slot is counted again, at all its places
        where = np.flatnonzero(rank >= 0)
        rank = rank.take(where)
        same = np.flatnonzero(pairs.take(rank) == code.take(where))
        where, rank = at.take(where.take(same)), rank.take(same)
        # of two pairs that overlap, the more frequent one stays; equal ones alternate along their run
        touch = np.diff(where) == 1
        weight = count[rank]
        lighter, heavier = weight[1:] < weight[:-1], weight[1:] > weight[:-1]
        strong = np.ones(len(where), bool)
        strong[1:] &= ~(touch & lighter)
        strong[:-1] &= ~(touch & heavier)
        strong = np.flatnonzero(strong)
        where, rank = where.take(strong), rank.take(strong)
        touch = where[1:] == where[:-1] + 1
        if touch.any():
            second = np.flatnonzero(touch) + 1
            fresh = np.concatenate(([True], second[1:] != second[:-1] + 1))
            starts = np.flatnonzero(fresh)
            odd = (np.arange(len(second)) - np.repeat(starts, np.diff(starts, append=len(second)))) % 2 == 0
            keep = np.ones(len(where), bool)
            keep[second[odd]] = False
            where, rank = where[keep], rank[keep]
        good = np.bincount(rank, minlength=len(pairs)) >= 2
        if not good.any():
            break
        if not good.all():
            use = good[rank]
            where, rank = where[use], rank[use]
        rules.append(np.stack((pairs[good] >> shift, pairs[good] & mask), 1).astype(np.uint32))
        if kind is np.uint32 and base + n_rules + len(rules[-1]) > 65535:
            kind, shift, mask = _codes(32)
        number = (np.cumsum(good) - 1).astype(np.uint32)
        s[where] = number[rank] + np.uint32(base + n_rules)
        n_rules += int(good.sum())
        live[where] = True
        live[np.maximum(where, 1) - 1] = True
        where += 1
        left = np.ones(len(s), bool)
        left[where] = False
        saved = len(where) / len(s)
        s, live = s[left], live[left]
        ends = ends - np.searchsorted(where, ends, "right")
        live[ends] = False
        if saved < worth:
            break
    counts = np.zeros(len(bounds) - 1, np.int64)
    counts[full] = np.diff(ends, prepend=-1)
    return s, np.concatenate(([0], np.cumsum(counts))), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):
        # rules refer to earlier ones; those whose parts are all known form a prefix of what is left
        open_ = np.flatnonzero((rules[done:].astype(np.int64) >= base + done).any(1))
        to = done + int(open_[0]) if len(open_) else len(rules)
        part = rules[done:to].astype(np.int64) - base
        out[done:to] = np.where(part >= 0, out[np.maximum(part, 0)], 1).sum(1)
        done = to
    return out


def expansions(rules: np.ndarray, base: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all nonterminals one after the other, bounds)."""
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.zeros(int(bounds[-1]), np.uint32)
    done = 0
    while done < len(rules):
        open_ = np.flatnonzero((rules[done:].astype(np.int64) >= base + done).any(1))
        to = done + int(open_[0]) if len(open_) else len(rules)
        at = bounds[done:to].copy()
        for side in (0, 1):
            part = rules[done:to, side].astype(np.int64)
            inner = part >= base
            n = np.where(inner, lengths[np.where(inner, part - base, 0)], 1)
            flat[at[~inner]] = part[~inner]
            if inner.any():
                k = n[inner]
                step = ranges(k)
                flat[np.repeat(at[inner], k) + step] = flat[np.repeat(bounds[part[inner] - base], k) + step]
            at += n
        done = to
    return flat, bounds


def narrow(x: np.ndarray, bits: int) -> bytes:
    """Symbols in ``bits`` bits each."""
    return b"".join((x.astype("<u2").tobytes(), *(np.packbits((x >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(16, bits))))


def widen(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """(n symbols that narrow() wrote at ``at``, where they end)."""
    out = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for b in range(16, bits):
        size = -(-n // 8)
        out |= np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(np.uint32) << np.uint32(b)
        at += size
    return out, at


def pack(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, base: int) -> bytes:
    """One shard as bytes."""
    symbols, symbol_bounds, rules = compress(ids, bounds, base)
    bits = max(16, (base + len(rules) - 1).bit_length())
    docs = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("symbols", "<u4")]))
    docs["id"] = [0 if d is None else d for d in doc_ids]
    docs["null"] = [d is None for d in doc_ids]
    docs["ids"], docs["symbols"] = np.diff(bounds), np.diff(symbol_bounds)
    head = struct.pack(HEAD, MAGIC, len(docs), len(rules), len(symbols), len(ids), bits, base)
    return b"".join((head, docs.tobytes(), *(narrow(x, bits) for x in (rules[:, 0], rules[:, 1], symbols))))


class Shard:
    """A reader of one shard."""

    def __init__(self, data: bytes):
        magic, n_docs, n_rules, n_symbols, self.n_ids, bits, self.base = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)
        docs = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("symbols", "<u4")]), n_docs, at)
        at += docs.nbytes
        left, at = widen(data, at, n_rules, bits)
        right, at = widen(data, at, n_rules, bits)
        self.rules = np.stack((left, right), 1)
        self.lengths = expansion_lengths(self.rules, self.base)
        self.symbols, at = widen(data, at, n_symbols, bits)
        self.doc_ids = [None if null else int(i) for i, null in zip(docs["id"], docs["null"])]
        self.starts = np.concatenate(([0], np.cumsum(docs["ids"].astype(np.int64))))
        self.symbol_starts = np.concatenate(([0], np.cumsum(docs["symbols"].astype(np.int64))))
        self._expanded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._expanded is None:
            # one table for all symbols: an id stands for itself, a nonterminal for its expansion
            flat, bounds = expansions(self.rules, self.base, self.lengths)
            self._expanded = np.concatenate((np.arange(self.base, dtype=np.uint32), flat)), np.concatenate((np.arange(self.base), self.base + bounds[:-1])).astype(np.int32), np.concatenate((np.ones(self.base, np.int32), self.lengths.astype(np.int32)))
        flat, first, lengths = self._expanded
        n = lengths[symbols]
        ends = np.cumsum(n, dtype=np.int64)
        kind = np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64
        at = np.repeat(first[symbols] - (ends - n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        return flat[at]

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]])

    def window(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]].astype(np.int64)
        inner = symbols >= self.base
        n = np.where(inner, self.lengths[np.where(inner, symbols - self.base, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        ends = np.cumsum(n)
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skip = start - (int(ends[first - 1]) if first else 0)
        return self._expand(symbols[first : last + 1])[skip : skip + stop - start]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pieces: str, end_id: int, base: int, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of ``doc_id``.

    ``base`` is the first symbol that is no id; ``shards`` the number of ranges (default: the shuffle partitions)."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, *keys[:2]).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, pieces, CACHE).encode
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data = pack(doc_ids, ids, np.concatenate(([0], np.cumsum(np.concatenate(lengths)))), base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "data"])

        for batch in slices(batches, rows=8192, size=12_000_000):
            ids, bounds = append(*encode(batch.column(1)), end_id)
            doc_ids += batch.column(0).to_pylist()
            held.append(ids)
            lengths.append(np.diff(bounds))
            if sum(map(len, held)) >= shard_ids:
                yield flush()
                seq, doc_ids, held, lengths = seq + 1, [], [], []
        if doc_ids:
            yield flush()

    rows.mapInArrow(run, "part long, seq long, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``, in no set order."""
    schema = "part long, seq long, n_ids long, data binary"
    files = spark.read.schema(schema).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                shard = Shard(data)
                ids = shard.ids().astype("<u4")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1], pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "seq", "data").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row per shard: where it starts among all ids
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, pieces: str, end_id: int, base: int, path: str | None = None, **options) -> DataFrame:
    """Write the files (to a folder of the shared one if none is given) and read them back."""
    path = path or shared_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer, pieces, end_id, base, **options)
    return read_token_files(docs.sparkSession, path)
