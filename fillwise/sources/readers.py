"""Sources: event tables, per-block CSV tables, certified intervals, generated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, paths: Sequence[str] | str, pattern: str | None = None, test: bool = False) -> DataFrame:
    """Several Parquet files or folders as one table; ``test`` takes the first path only."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no paths")
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.parquet(*(paths[:1] if test else paths))


def list_files(spark: SparkSession, pattern: str, test: bool = False) -> list[str]:
    """The files that match a pattern, on whatever file system it names, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    files = sorted(str(s.getPath()) for s in found or [])
    return files[:1] if test else files


def read_block_csv(spark: SparkSession, path: str, value: str, convert: Column | None = None) -> DataFrame:
    """(run, lumi, value, line) from a per-block table; ``line`` orders the lines of all its files.

    The first line is a tag; the header is the line that starts ``#run``; other lines that start ``#`` are comments.  Run
    and block are what stands before the colon in ``run:fill`` and ``ls``.  ``convert`` is an expression over ``raw``."""
    # the order of lines: by file, by block of the file, by line within
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("line"))
    header = lines.where(F.col("value").startswith("#run")).first()
    if header is None:
        raise ValueError("no header line")
    names = header[0].lstrip("#").split(",")
    if value not in names or "run:fill" not in names or "ls" not in names:
        raise ValueError(f"columns {names} lack {value}, run:fill or ls")
    parts = F.split("value", ",")
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").contains(":"))
    rows = rows.select(*(F.get(parts, F.lit(names.index(c))).alias(n) for c, n in (("run:fill", "r"), ("ls", "l"), (value, "raw"))), "line")
    convert = F.col("raw").cast("double") if convert is None else convert
    return rows.select(F.split("r", ":")[0].cast("long").alias("run"), F.split("l", ":")[0].cast("long").alias("lumi"), convert.alias("value"), "line")


def read_luminosity(spark: SparkSession, path: str) -> DataFrame:
    """(run, lumi, value, line) with the recorded luminosity."""
    return read_block_csv(spark, path, "recorded(/fb)")


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """(run, lumi, value, line) with the block's time in seconds since 1970, read in the session's time zone."""
    return read_block_csv(spark, path, "time", F.unix_timestamp(F.to_timestamp("raw", "MM/dd/yy HH:mm:ss")).cast("double"))


def intervals_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """(run, first, last) from texts that map a run to its list of [first, last]."""
    runs = lines.select(F.explode(F.from_json(column, "map<string,array<array<bigint>>>")).alias("run", "ranges"))
    pairs = runs.select(F.col("run").cast("long").alias("run"), F.explode("ranges").alias("p"))
    return pairs.select("run", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("last"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(run, first, last) from a JSON file of certified intervals."""
    return intervals_from_json(spark.read.option("wholetext", True).text(path))


def generate(spark: SparkSession, rows: int, /, **columns: str) -> DataFrame:
    """``rows`` rows numbered by ``entry``, with columns given as SQL expressions of it and of the columns before them."""
    df = spark.range(rows).withColumnRenamed("id", "entry")
    for name, expression in columns.items():
        df = df.withColumn(name, F.expr(expression))
    return df
