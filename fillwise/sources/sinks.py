"""Sinks: histograms as folders of Parquet with a manifest, conversion to arrays and back; intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

import json
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fillwise.operators.histogram import Histogram, index_name
from fillwise.plans.axes import Axis, collapse, from_description, named
from fillwise.plans.storage import storage_of


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="fillwise-")
    return f"{base.rstrip('/')}/fillwise-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_rows(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it again; the shuffle files behind it are deleted with the write."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete what ``write_rows`` wrote; nothing may read it any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_histograms(spark: SparkSession, path: str, histograms: list[Histogram], extra: dict | None = None) -> None:
    """``path/<name>`` for each histogram and ``path/manifest`` with axes, storages and ``extra``."""
    names = [h.name for h in histograms]
    if len(set(names)) != len(names):
        raise ValueError("histogram names are distinct")
    for h in histograms:
        h.data.write.mode("overwrite").parquet(f"{path}/{h.name}")
    manifest = {"histograms": [{"name": h.name, "storage": h.storage.name, "axes": [a.describe() for a in h.axes], "metadata": h.metadata} for h in histograms], "extra": extra or {}}
    _write_text(spark, f"{path}/manifest", json.dumps(manifest))


def read_histograms(spark: SparkSession, path: str) -> tuple[dict[str, Histogram], dict]:
    """(histograms by name, extra); the data stays on disk until it is used."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    out = {}
    for h in manifest["histograms"]:
        out[h["name"]] = Histogram(h["name"], [from_description(a) for a in h["axes"]], storage_of(h["storage"]), spark.read.parquet(f"{path}/{h['name']}"), h["metadata"])
    return out, manifest["extra"]


def to_arrays(hist: Histogram) -> dict:
    """Edges per axis and contents with flow bins on all axes (bins that the histogram lacks hold 0); categories raise."""
    edges, flows = [], []
    for a in hist.axes:
        if type(a).__name__.endswith("Category"):
            raise TypeError("category axes have no edges")
        edges.append(a.edges())
        flows.append((a.underflow, a.overflow))
    filled = hist.to_numpy(flow=True)
    pad = [(0 if u else 1, 0 if o else 1) for u, o in flows]
    return {"name": hist.name, "axis_names": [a.name for a in hist.axes], "edges": edges, "storage": hist.storage.name, **{k: np.pad(v, pad) for k, v in filled.items()}}


def from_arrays(spark: SparkSession, arrays: dict, axis_names: list[str] | None = None, axes: Sequence[Axis] | None = None) -> Histogram:
    """A histogram from ``to_arrays``' form; evenly spaced edges make a regular axis.

    With ``axes``, of as many bins each, contents in flow bins that an axis lacks are left out."""
    names = axis_names or arrays["axis_names"]
    if len(names) != len(arrays["edges"]):
        raise ValueError("one name per axis")
    axes = list(axes) if axes is not None else named([collapse(e, n) for e, n in zip(arrays["edges"], names)])
    value = np.asarray(arrays["value"])
    if value.shape != tuple(a.n + 2 for a in axes):
        raise ValueError("contents and edges disagree")
    at = np.nonzero((value != 0) | (np.asarray(arrays.get("variance", value)) != 0))
    kept = np.ones(len(at[0]), bool)
    for a, i in zip(axes, at):
        kept &= (i - 1 >= a.first) & (i - 1 < a.first + a.extent)
    at = tuple(i[kept] for i in at)
    frame = pd.DataFrame({index_name(a): (i - 1).astype("int32") for a, i in zip(axes, at)})
    storage = storage_of(arrays.get("storage", "weight"))
    for c in storage.columns:
        frame[c] = np.asarray(arrays[c])[at]
    kind = "bigint" if storage.name == "int64" else "double"
    schema = ", ".join([*(f"`{index_name(a)}` int" for a in axes), *(f"{c} {kind}" for c in storage.columns)])
    return Histogram(arrays.get("name", "h"), axes, storage, spark.createDataFrame(frame, schema) if len(frame) else spark.createDataFrame([], schema))


