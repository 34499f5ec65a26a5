"""Helpers shared by the training-data operators: shared storage, word columns, word hashing in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Words, for DuckDB.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Rows of an Arrow batch that are worked on at once, and characters at most.
SLICE_ROWS, SLICE_BYTES = 2048, 8_000_000


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="fillwise-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only a session that runs in one process may leave that unset: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/fillwise-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.  Cuts the lineage; survives lost executors.

    The shuffle files behind it are deleted with the write, so that the next step has the disk."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._fillwise_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing may read ``frames`` any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._fillwise_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A table of frequent keys has so many rows at most; a key with fewer rows than HOT_ROWS is never in it.
HOT_KEYS, HOT_ROWS = 20_000, 256


def join_sums(rows: DataFrame, sums: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``sums``, which has one row per key and the number ``n`` of the key's rows (dropped).

    A key of more than 1 / HOT_KEYS of the ``total`` rows is frequent; there can't be more than HOT_KEYS of them.  Their
    sums are broadcast and their rows stay where they are; the rows of the other keys are dealt out by key."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    if total < least:  # no key can be frequent
        return rows.join(sums.drop("n"), keys, how)
    hot = materialize(sums.where(F.col("n") >= least).drop("n"))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(sums.where(F.col("n") < least).drop("n"), keys, how)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def neutral(df: DataFrame, **roles: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by place (c0, c1, ...) or, for those given as role=name, by role.

    Whatever the caller's columns are called, they cannot clash with an operator's own.  Also returns the new names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    for role, name in roles.items():
        names[df.columns.index(name)] = role
    return df.toDF(*names), names


def restored(df: DataFrame, names: list[str], original: list[str], results: list[str] = ()) -> DataFrame:
    """The columns ``names`` under their original names and then ``results``, which replace columns of the same name."""
    taken = {r.lower() for r in results}
    return df.select(*(F.col(n).alias(o) for n, o in zip(names, original) if o.lower() not in taken), *results)


def any_order(df: DataFrame, names: list[str]) -> Column:
    """Some order of rows by all of these columns, the same on every run (rows that tie are equal, or nearly never not)."""
    return F.xxhash64(*(F.col(f.name) for f in df.schema if f.name in names and "map<" not in f.dataType.simpleString()))


def trimmed(text: str | Column) -> Column:
    """The text without white space at its ends; a null text is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words_column(text: str | Column) -> Column:
    """The words of a text; ``['']`` for a text without words (see ``n_words_column``)."""
    return F.split(trimmed(text), SPACE_RUN)


def n_words_column(text: str | Column) -> Column:
    """How many words a text has."""
    t = trimmed(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def crc32_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


# --- Arrow batches -----------------------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker stays alive and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """Words of a batch of texts: ``codes`` index ``vocabulary`` (unique words), ``starts`` bounds each text's words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        encoded = flat.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = encoded.dictionary
        empty = pc.index(self.vocabulary, pa.scalar("", type=self.vocabulary.type)).as_py() if len(self.vocabulary) else -1
        if empty >= 0:
            keep = codes != empty
            kept_before = np.concatenate(([0], np.cumsum(keep)))
            bounds = kept_before[bounds]
            codes = codes[keep]
        self.codes, self.starts = codes, bounds

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        return table[self.codes] if len(table) else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the n consecutive words from each position on (without regard to text bounds; the last n-1 are left out)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total, done, span, block = None, 0, 1, hashes.astype(np.uint64)
    # Doubling: a block covers ``span`` words; n is put together from its binary digits.
    with np.errstate(over="ignore"):
        while True:
            if n & span:
                part = block[done:]
                total = part if total is None else mix64(total[: len(part)] * np.uint64(seed | 1) + part[: len(total)])
                done += span
            if span * 2 > n:
                break
            head, tail = block[: len(block) - span], block[span:]
            block = mix64(head * np.uint64(0xD6E8FEB86659FD93 ^ (seed & ~1)) + tail * np.uint64(3))
            span *= 2
    return total[:m]


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each group of the given lengths, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)
