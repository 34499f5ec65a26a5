"""One user query over many datasets, with certified intervals and normalisation.

Plans of all datasets are built first; their jobs then run at the same time from a pool of threads (use the FAIR
scheduler to share executors evenly).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fillwise.operators.histogram import Histogram, sum_and_count
from fillwise.operators.lookup import filter_intervals, lookup
from fillwise.plans.fusion import Book, fuse, split
from fillwise.sources.readers import read_events, read_intervals, read_luminosity


@dataclass(frozen=True)
class Dataset:
    """A set of files.  Data may name a table of certified intervals and one of luminosities; simulation has a cross section."""

    name: str
    paths: Sequence[str] = field(default_factory=tuple)
    is_data: bool = False
    xsec: float | None = None
    lumi_csv: str | None = None
    lumi_json: str | None = None
    lumi_paths: Sequence[str] = field(default_factory=tuple)
    group: str | None = None


Build = Callable[[DataFrame, Dataset], tuple[list, DataFrame]]


def certified(df: DataFrame, dataset: Dataset, run_col: str, lumi_col: str) -> DataFrame:
    if not dataset.lumi_json:
        return df
    return filter_intervals(df, read_intervals(df.sparkSession, dataset.lumi_json), run_col, lumi_col)


def luminosity(spark: SparkSession, dataset: Dataset, run_col: str = "run", lumi_col: str = "luminosityBlock") -> DataFrame:
    """(lumi): the recorded luminosity of the certified blocks."""
    blocks = certified(read_events(spark, dataset.lumi_paths), dataset, run_col, lumi_col)
    table = read_luminosity(spark, dataset.lumi_csv)
    return lookup(blocks, table, {run_col: "run", lumi_col: "lumi"}, "value", "_lumi", order="line", missing="lumi not found").agg(F.sum("_lumi").alias("lumi"))


def result_name(result) -> str:
    return getattr(result, "name", None) or uuid.uuid4().hex


def build_and_run(spark: SparkSession, datasets: Sequence[Dataset], build: Build, run_col: str = "run", lumi_col: str = "luminosityBlock", threads: int = 8, report: Callable[[str], None] | None = None) -> dict:
    """{dataset: {meta..., weight_sum, event_count, [lumi], output}}.

    ``build`` gets the certified events and the dataset and returns (results, ``sum_and_count`` of the weight).  Results
    are histograms, DataFrames or a ``Book`` of fills that share one pass.  If the count that it returns is not that of the certified events, the user has
    filtered before summing, and a ValueError is raised; so it is for two results of one name."""
    began = time.monotonic()
    names = [d.name for d in datasets]
    if len(set(names)) != len(names):
        raise ValueError("dataset names are distinct")
    plans = []
    for d in datasets:
        # the events are counted by whatever job reads them first, which is that of the totals
        seen = Observation()
        events = certified(read_events(spark, d.paths), d, run_col, lumi_col).observe(seen, F.count(F.lit(1)).alias("n"))
        results, totals = build(events, d)
        named: dict = {}
        for r in results:
            for name in [f.name for f in r.fills] if isinstance(r, Book) else [result_name(r)]:
                if name in named:
                    raise ValueError(f"{d.name}: two results named {name}")
                named[name] = r
        lumi = luminosity(spark, d, run_col, lumi_col) if d.is_data and d.lumi_csv else None
        plans.append((d, events, seen, named, totals, lumi))
    tell = report or (lambda _: None)
    tell(f"plans built after {time.monotonic() - began:.1f} s")

    done: list[str] = []

    def run(plan) -> tuple[str, dict]:
        d, events, seen, named, totals, lumi = plan
        total = totals.first()
        counted = "CollectMetrics" in totals._jdf.queryExecution().optimizedPlan().toString()
        count = seen.get["n"] if counted else events.count()
        if total["count"] != count:
            raise ValueError(f"{d.name}: the weight sum covers {total['count']} of {count} events; sum before filtering")
        out = {"name": d.name, "is_data": d.is_data, "xsec": d.xsec, "group": d.group, "weight_sum": total["sum"], "event_count": count, "output": {}}
        if lumi is not None:
            out["lumi"] = lumi.first()[0]
        for book in {id(r): r for r in named.values() if isinstance(r, Book)}.values():
            fused = fuse(book.df, book.fills).persist()  # one pass for all of them
            fused.count()
            out["output"] |= {h.name: h for h in split(fused, book.fills)}
        for name, r in named.items():
            if isinstance(r, Book):
                continue
            frame = r.data if isinstance(r, Histogram) else r
            held = frame.persist()
            held.count()
            out["output"][name] = Histogram(r.name, r.axes, r.storage, held, r.metadata) if isinstance(r, Histogram) else held
        spent = time.monotonic() - began
        done.append(d.name)
        tell(f"{d.name}: {count} events after {spent:.1f} s ({count / max(spent, 1e-9):.0f} a second), {len(done)} of {len(plans)} datasets")
        return d.name, out

    with ThreadPoolExecutor(max(1, min(threads, len(plans) or 1))) as pool:
        return dict(pool.map(run, plans))


def release(results: dict) -> None:
    """Free what the results of ``build_and_run`` hold in memory."""
    for found in results.values():
        for r in found["output"].values():
            (r.data if isinstance(r, Histogram) else r).unpersist()


__all__ = ["Dataset", "build_and_run", "certified", "luminosity", "release", "sum_and_count"]
