"""Language-model scoring by cross-entropy difference.

Two bigram models that match in everything but their counts: the target's from a set of texts in the wanted domain, the
background's from every document.  They share one vocabulary, every word of either.  A document's score is the mean over
its words of (loss under the target - loss under the background), in nats: the lower, the closer to the target.

With c the counts of a model, N its words, V the vocabulary's size, u the word before v (a start mark before the first):

    p(v)     = (c(v) + 1) / (N + V + 1)
    p(v | u) = (c(u, v) + strength * p(v)) / (c(u) + strength)

Both the vocabulary and the counts grow with the corpus, so neither is gathered anywhere.  Documents are written in blocks
of bounded size.  A block sorts its distinct keys (a 56-bit hash and a kind: words, last words of texts, pairs) and deals
them out by range as compressed arrays, one row for each range.  A range of keys, about RANGE_KEYS over all blocks, is summed in
one task, and each block gets back the sums of the keys that it shares with others; of the rest it knows the counts itself.
A key stands in a block once, so the commonest pair is no hot key.  c(u) as a context is the count of u less the texts that
end with it.  Loss differences are kept per pair in whole millionths, so that a document's sum does not depend on its order.

Defined results: a text without words (or null) has the score 0; equal rows get equal scores; a null id is kept; an
empty target gives a model without counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fillwise.llm.common import Words, discard, give_back, materialize, mix64, slices

#: Documents of a block, and bytes of text at most (one document at least).
BLOCK_ROWS, BLOCK_BYTES = 16_384, 6_000_000
#: Keys of a range, about, over all blocks (some 50 bytes each in a task); ranges at least.  There is a row for each block
#: and range, so that wide ranges count for more than the task's memory.
RANGE_KEYS, LEAST_RANGES = 4_000_000, 64
#: Kinds of keys, in their two lowest bits.
WORD, END, PAIR = 0, 1, 2
KEY_BITS = 58
_START = np.uint64(0x5D1F3C2B9A876E41)


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h) >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(kind)


class Keys:
    """The keys of a block's texts: of each word (place) its own and its pair's, and of the texts' ends.

    ``distinct`` are the keys in order and ``counts`` how often each occurs; ``word``, ``pair`` and ``before`` (the word
    before; -1 for none) are places in it."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        h = w.hashes()
        some = w.lengths > 0
        first = w.starts[:-1][some]
        before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
        before[first] = _START
        with np.errstate(over="ignore"):
            pair = _key(mix64(before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + h, PAIR)
        word = _key(h, WORD)
        end = word[w.starts[1:][some] - 1] | np.uint64(END)
        self.starts, n = w.starts, len(word)
        self.distinct, where, self.counts = np.unique(np.concatenate((word, pair, end)), return_inverse=True, return_counts=True)
        self.word, self.pair = where[:n], where[n : 2 * n]
        self.before = np.concatenate((np.full(1, -1), self.word[:-1])) if n else self.word
        self.before[first] = -1


def packed(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, compressed byte by byte; sorted ones best as differences."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view(kind).reshape(n)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, kind: str) -> DataFrame:
    """(block, n_words, docs): documents (doc_id, text) in blocks (compressed Arrow streams), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t)
            words = int(pc.sum(pc.count_substring(t.column("text"), " ")).as_py() or 0) + t.num_rows
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([words], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_words", "docs"])

        for batch in slices(batches, rows=256, size=BLOCK_BYTES // 4):
            if held and (rows + batch.num_rows > BLOCK_ROWS or size + batch.nbytes > BLOCK_BYTES):
                yield flush()
                seq, held, rows, size = seq + 1, [], 0, 0
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if held:
            yield flush()

    return materialize(docs.mapInArrow(run, "block long, n_words long, docs binary"))


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def n_ranges(words: int) -> int:
    """Ranges of a corpus of so many words."""
    return max(LEAST_RANGES, -(-words // RANGE_KEYS))


def dealt(held: DataFrame, ranges: int) -> DataFrame:
    """(range, block, size, keys, n) of each block: the keys of a range in order and their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first key of each range; a word and its end are in one
        first = (np.arange(1, ranges, dtype=object) * (1 << KEY_BITS) // ranges).astype(np.uint64) & ~np.uint64(3)
        for batch in batches:
            for block, data in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                k = Keys(opened(data).column("text").combine_chunks())
                ends = np.concatenate(([0], np.searchsorted(k.distinct, first), [len(k.distinct)]))
                at = np.flatnonzero(np.diff(ends))
                n = k.counts.astype(np.int64)
                for part in (at[i : i + 256] for i in range(0, len(at), 256)):
                    cut = [slice(ends[i], ends[i + 1]) for i in part.tolist()]
                    columns = [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), block)), pa.array(np.diff(ends)[part].astype(np.int32))]
                    columns += [pa.array([packed_keys(k.distinct[c]) for c in cut], pa.binary()), pa.array([packed(n[c]) for c in cut], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "block", "size", "keys", "n"])
                del k
                give_back()

    return held.select("block", "docs").mapInArrow(run, "range int, block long, size int, keys binary, n binary")


_KNOWN = "block long, size int, keys binary, b binary, t binary, words long, all_b long, all_t long, texts long"


def summed(rows: DataFrame) -> DataFrame:
    """Of each range, what every block is to know: the keys that it shares with other blocks or the target, and their sums.

    ``rows`` is what ``dealt`` gives with ``target``.  A row without block has the sums over the words and the texts."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy().astype(np.int64)
        keys = [unpacked_keys(x, k) for x, k in zip(table.column("keys").to_pylist(), sizes.tolist())]
        keys = np.concatenate(keys)
        one, which = np.unique(keys, return_inverse=True)
        del keys
        # of one block: its texts have fewer words than 2^31
        n = np.concatenate([unpacked(x, k, np.int64).astype(np.int32) for x, k in zip(table.column("n").to_pylist(), sizes.tolist())])
        target = table.column("target").to_numpy()
        wanted = np.repeat(target, sizes)
        b, t = (np.bincount(which, np.where(side, n, 0), len(one)).astype(np.int64) for side in (~wanted, wanted))
        is_word, is_end = (one & np.uint64(3)) == WORD, (one & np.uint64(3)) == END
        out: list[tuple] = [(None, 0, b"", b"", b"", int(is_word.sum()), int(b[is_word].sum()), int(t[is_word].sum()), int(b[is_end].sum()) << 32 | int(t[is_end].sum()))]
        shared = (b[which] > n) | (t[which] > 0)
        # a word's end follows it; a block is to know it even if none of its own texts ends so
        end_of = np.full(len(one), -1)
        end_of[:-1] = np.where(is_word[:-1] & (one[1:] == one[:-1] | np.uint64(END)), np.arange(1, len(one)), -1)
        for block, to, size, other in zip(table.column("block").to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), target.tolist()):
            mine = which[to - size : to][shared[to - size : to]]
            if not other and len(mine):
                ends = end_of[mine]
                mine = np.union1d(mine, ends[ends >= 0])
                out.append((block, len(mine), packed_keys(one[mine]), packed(b[mine]), packed(t[mine]), 0, 0, 0, 0))
        give_back()
        names = [c.split()[0] for c in _KNOWN.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.groupBy("range").applyInArrow(run, _KNOWN)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", strength: float = 8.0) -> DataFrame:
    """(doc_id, n_words, score) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = blocks(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), kind)
    wanted = blocks(target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_text}`").alias("text")), "int")
    words = sum(x.agg(F.sum("n_words")).first()[0] or 0 for x in (held, wanted))
    ranges = n_ranges(words)
    rows = dealt(held, ranges).withColumn("target", F.lit(False)).unionByName(dealt(wanted, ranges).withColumn("target", F.lit(True)))
    known = materialize(summed(rows))
    discard(wanted)
    high, low = F.shiftright("texts", 32), F.col("texts").bitwiseAND(0xFFFFFFFF)
    row = known.where("block is null").agg(*map(F.sum, ("words", "all_b", "all_t")), F.sum(high), F.sum(low)).first()
    size, all_b, all_t, texts_b, texts_t = (x or 0 for x in row)

    def score(key, block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"doc_id": pa.array([], pa.null()), "n_words": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}).cast(result)
        docs_ = opened(block.column("docs")[0].as_py())
        k = Keys(docs_.column("text").combine_chunks())
        own = k.distinct
        # sums of each key: the block's own counts, or what it was told; of a word's end they stand with the word
        b, t = k.counts.astype(np.float64), np.zeros(len(own))
        ends_b, ends_t = np.zeros(len(own)), np.zeros(len(own))
        here = np.flatnonzero((own & np.uint64(3)) == END)
        ends_b[np.searchsorted(own, own[here] & ~np.uint64(3))] = b[here]
        told = [(unpacked_keys(keys_, size_), unpacked(b_, size_, np.int64), unpacked(t_, size_, np.int64)) for size_, keys_, b_, t_ in zip(*(found.column(c).to_pylist() for c in ("size", "keys", "b", "t")))]
        if told:
            keys_, b_, t_ = map(np.concatenate, zip(*told))
            del told
            end = (keys_ & np.uint64(3)) == END
            at = np.searchsorted(own, keys_[~end])
            b[at], t[at] = b_[~end], t_[~end]
            at = np.searchsorted(own, keys_[end] & ~np.uint64(3))
            ends_b[at], ends_t[at] = b_[end], t_[end]
        start = k.before < 0

        def losses(c: np.ndarray, ends: np.ndarray, n: int, texts: int) -> np.ndarray:
            one = (c + 1.0) / (n + size + 1)
            # a word is a context as often as it occurs, but for the texts that end with it
            context = np.where(start, texts, (c - ends)[k.before])
            return np.log((c[k.pair] + strength * one[k.word]) / (context + strength))

        loss = np.rint((losses(b, ends_b, all_b, texts_b) - losses(t, ends_t, all_t, texts_t)) * 1e6).astype(np.int64)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(loss)))
        n, sums = np.diff(k.starts), np.diff(total[k.starts])
        ids = docs_.column("doc_id")
        del k, b, t
        give_back()
        return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "score": np.where(n > 0, sums / (1e6 * np.maximum(n, 1)), 0.0)})

    result = pa.schema([("doc_id", to_arrow_type(docs.schema[doc_id].dataType)), ("n_words", pa.int64()), ("score", pa.float64())])
    sums = known.where("block is not null").select("block", "size", "keys", "b", "t")
    return held.select("block", "docs").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, score double")
