"""The registered queries of the histogram operators, each with its SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.functions import arrays as A
from fillwise.functions.inference import onnx_columns
from fillwise.functions.onnx_models import sum_model
from fillwise.operators import histogram as H
from fillwise.operators import lookup as L
from fillwise.operators import matrix as M
from fillwise.operators import quantiles as Q
from fillwise.operators import runner as R
from fillwise.operators import shift as S
from fillwise.operators.custom import custom_aggregate
from fillwise.plans.axes import Boolean, IntCategory, Integer, Regular, StrCategory, Variable
from fillwise.plans.fusion import Fill, fuse
from fillwise.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    names = names or ("value", "variance")
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


def _reg(x: str, n: int, lo: float, hi: float) -> str:
    z = f"(({x})::DOUBLE - {lo}::DOUBLE) / {hi - lo}::DOUBLE"
    return f"(CASE WHEN {z} < 1 THEN CASE WHEN {z} >= 0 THEN least(floor({z} * {n}), {n - 1}) ELSE -1 END ELSE {n} END)::INT"


def _var(x: str, edges) -> str:
    return "(" + " + ".join(f"(({x}) >= {float(e)}::DOUBLE)::INT" for e in edges) + " - 1)::INT"


def _int(x: str, lo: int, hi: int) -> str:
    return f"(CASE WHEN {x} < {lo} THEN -1 WHEN {x} >= {hi} THEN {hi - lo} ELSE {x} - {lo} END)::INT"


_QTY = Regular("qty", True, True, 20, 0.0, 60.0)
_EDGES = (0.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0)
_TYPES = ("click", "view", "purchase")


@query(f"""WITH g AS (SELECT range::BIGINT AS flat, (range - 1)::INT AS qty_idx FROM range(22)),
h AS (SELECT {_reg('l_quantity', 20, 0, 60)} AS qty_idx, sum(1 - l_discount) AS value, sum((1 - l_discount) * (1 - l_discount)) AS variance FROM lineitem GROUP BY 1)
SELECT flat, qty_idx, round(coalesce(value, 0.0), 4) AS value, round(coalesce(variance, 0.0), 6) AS variance FROM g LEFT JOIN h USING (qty_idx)""")
def hist1d_regular_weight(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", (1 - F.col("l_discount")).alias("w"))
    return rounded(rounded(H.histogram(df, "h", [_QTY], ["l_quantity", "w"]).densify(), 4, "value"), 6, "variance")


@query(f"SELECT {_var('value', _EDGES)} AS value_idx, count(*)::DOUBLE AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def hist1d_variable(spark, d):
    return H.histogram(table(spark, d, "events").select("value"), "h", [Variable("value", at=_EDGES)], ["value"], "double").data


@query(f"SELECT {_int('l_linenumber', 2, 6)} AS line_idx, count(*)::BIGINT AS value FROM lineitem GROUP BY 1")
def hist1d_integer_int64(spark, d):
    return H.histogram(table(spark, d, "lineitem"), "h", [Integer("line", lo=2, hi=6)], ["l_linenumber"], "int64").data


@query("SELECT (CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END)::INT AS kind_idx, count(*)::BIGINT AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def hist_category_overflow(spark, d):
    return H.histogram(table(spark, d, "events"), "h", [StrCategory("kind", categories=_TYPES)], ["event_type"], "int64").data


@query("SELECT (CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END)::INT AS kind_idx, count(*)::BIGINT AS value FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def hist_category_dropped(spark, d):
    return H.histogram(table(spark, d, "events"), "h", [StrCategory("kind", overflow=False, categories=_TYPES)], ["event_type"], "int64").data


@query("SELECT (CASE l_linenumber WHEN 1 THEN 0 WHEN 5 THEN 1 WHEN 3 THEN 2 ELSE 3 END)::INT AS line_idx, count(*)::BIGINT AS value FROM lineitem GROUP BY 1")
def hist_int_category(spark, d):
    return H.histogram(table(spark, d, "lineitem"), "h", [IntCategory("line", categories=(1, 5, 3))], ["l_linenumber"], "int64").data


@query("SELECT (l_discount > 0.05::DOUBLE)::INT AS big_idx, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance FROM lineitem GROUP BY 1")
def hist_boolean(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_discount") > 0.05).alias("big"))
    return H.histogram(df, "h", [Boolean("big")], ["big"]).data


@query("SELECT (((l_linenumber - 1) % 4))::INT AS phase_idx, count(*)::BIGINT AS value FROM lineitem GROUP BY 1")
def hist_circular(spark, d):
    return H.histogram(table(spark, d, "lineitem"), "h", [Regular("phase", bins=4, lo=1.0, hi=5.0, circular=True)], ["l_linenumber"], "int64").data


_AXES3 = [Regular("qty", True, True, 5, 0.0, 50.0), Regular("disc", True, True, 4, 0.0, 0.1), StrCategory("flag", categories=("A", "N"))]
_KEY3 = f"{_reg('l_quantity', 5, 0, 50)} AS qty_idx, {_reg('l_discount', 4, 0, 0.1)} AS disc_idx, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS flag_idx"
_SPARSE3 = f"SELECT {_KEY3}, round(sum(l_tax), 4) AS value FROM lineitem GROUP BY 1, 2, 3"


@query(_SPARSE3)
def hist3d_sparse(spark, d):
    return rounded(H.histogram(table(spark, d, "lineitem"), "h", _AXES3, ["l_quantity", "l_discount", "l_returnflag", "l_tax"], "sparse").data)


@query(f"""WITH h AS ({_SPARSE3}), g AS (SELECT q.range * 18 + s.range * 3 + f.range AS flat, (q.range - 1)::INT AS qty_idx, (s.range - 1)::INT AS disc_idx, f.range::INT AS flag_idx
FROM range(7) q, range(6) s, range(3) f) SELECT flat::BIGINT AS flat, qty_idx, disc_idx, flag_idx, coalesce(value, 0.0) AS value FROM g LEFT JOIN h USING (qty_idx, disc_idx, flag_idx)""")
def hist3d_dense(spark, d):
    return rounded(H.histogram(table(spark, d, "lineitem"), "h", _AXES3, ["l_quantity", "l_discount", "l_returnflag", "l_tax"], "double").densify())


@query(f"SELECT {_reg('l_quantity', 5, 0, 50)} AS qty_idx, round(sum(l_tax), 4) AS value FROM lineitem GROUP BY 1")
def hist_project(spark, d):
    h = H.histogram(table(spark, d, "lineitem"), "h", _AXES3, ["l_quantity", "l_discount", "l_returnflag", "l_tax"], "double")
    return rounded(h.project("qty").data)


@query(f"""SELECT {_reg('l_quantity', 5, 0, 50)} AS qty_idx, round(sum(l_tax * l_discount * l_linenumber), 4) AS value,
round(sum((l_tax * l_discount * l_linenumber) * (l_tax * l_discount * l_linenumber)), 4) AS variance FROM lineitem GROUP BY 1""")
def hist_multi_weight(spark, d):
    return rounded(H.histogram(table(spark, d, "lineitem"), "h", [_AXES3[0]], ["l_quantity", "l_tax", "l_discount", "l_linenumber"]).data)


@query(f"SELECT {_reg('l_extendedprice', 8, 20000.5, 60000.5)} AS price_idx, count(*)::BIGINT AS value FROM lineitem WHERE l_extendedprice >= 20000.5::DOUBLE AND l_extendedprice < 60000.5::DOUBLE GROUP BY 1")
def hist_noflow_drop(spark, d):
    return H.histogram(table(spark, d, "lineitem"), "h", [Regular("price", False, False, 8, 20000.5, 60000.5)], ["l_extendedprice"], "int64").data


@query(f"SELECT {_reg('l_quantity', 5, 0, 50)} AS axis_0_idx, {_reg('l_discount', 4, 0, 0.1)} AS axis_1_idx, round(sum(l_tax), 4) AS value, round(sum(l_tax * l_tax), 4) AS variance FROM lineitem GROUP BY 1, 2")
def histnd_model(spark, d):
    model = ("h", "", 2, [5, 4], [0.0, 0.0], [50.0, 0.1])
    return rounded(H.histo_nd(table(spark, d, "lineitem"), model, ["l_quantity", "l_discount", "l_tax"]).data)


@query(f"SELECT {_reg('l_quantity', 10, 0, 50)} AS axis_0_idx, round(sum(l_tax), 4) AS value, round(sum(l_tax * l_tax), 4) AS variance FROM lineitem GROUP BY 1")
def histo1d_model(spark, d):
    return rounded(H.histo_1d(table(spark, d, "lineitem"), ("h", "", 10, 0.0, 50.0), "l_quantity", "l_tax").data)


@query(f"SELECT {_reg('l_quantity', 10, 0, 50)} AS axis_0_idx, {_var('l_tax', (0.0, 0.025, 0.055, 0.1))} AS axis_1_idx, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance FROM lineitem GROUP BY 1, 2")
def histo2d_model(spark, d):
    return H.histo_2d(table(spark, d, "lineitem"), ("h", "", 10, 0.0, 50.0, 3, (0.0, 0.025, 0.055, 0.1)), "l_quantity", "l_tax").data


@query(f"SELECT {_reg('l_quantity', 4, 0, 60)} AS axis_0_idx, {_reg('l_discount', 3, -0.005, 0.115)} AS axis_1_idx, {_reg('l_linenumber', 7, 0.5, 7.5)} AS axis_2_idx, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance FROM lineitem GROUP BY 1, 2, 3")
def histo3d_model(spark, d):
    model = ("h", "", 4, 0.0, 60.0, 3, -0.005, 0.115, 7, 0.5, 7.5)
    return H.histo_3d(table(spark, d, "lineitem"), model, "l_quantity", "l_discount", "l_linenumber").data


def _orders(spark, d) -> DataFrame:
    """Lines as parallel arrays per order; sorted, so that the arrays of an order do not depend on the partitioning."""
    row = F.struct("l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_partkey", "l_suppkey", "l_tax")
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    names = {"line": "l_linenumber", "qty": "l_quantity", "disc": "l_discount", "price": "l_extendedprice", "tax": "l_tax"}
    return grouped.select("l_orderkey", *(F.col("r")[c].alias(n) for n, c in names.items()))


@query(f"SELECT {_reg('l_quantity', 5, 0, 50)} AS qty_idx, round(sum((1 - l_discount) * (l_orderkey % 3)), 4) AS value, round(sum(((1 - l_discount) * (l_orderkey % 3)) * ((1 - l_discount) * (l_orderkey % 3))), 4) AS variance FROM lineitem GROUP BY 1")
def ragged_fill(spark, d):
    df = _orders(spark, d).select("qty", F.transform("disc", lambda x: 1 - x).alias("w"), (F.col("l_orderkey") % 3).alias("s"))
    return rounded(H.histogram(df, "h", [_AXES3[0]], ["qty", "w", "s"]).data)


@query("""WITH g AS (SELECT l_orderkey, list(struct_pack(a := l_linenumber, b := l_quantity, c := l_discount, d := l_extendedprice, e := l_partkey, f := l_suppkey, g := l_tax)
  ORDER BY l_linenumber, l_quantity, l_discount, l_extendedprice, l_partkey, l_suppkey, l_tax) AS r FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, list_filter(r, lambda x: x.b > 20 AND x.c < 0.05::DOUBLE) AS k FROM g)
SELECT l_orderkey, len(k)::INT AS n_good, k[1].d AS first_price FROM m WHERE len(k) >= 1""")
def ragged_mask_first(spark, d):
    df = _orders(spark, d)
    good = A.mask({"q": F.col("qty"), "s": F.col("disc")}, lambda e: (e["q"] > 20) & (e["s"] < 0.05))
    df = df.withColumn("good", good).where(A.count_true(F.col("good")) >= 1)
    return df.select("l_orderkey", A.count_true(F.col("good")).alias("n_good"), A.element(A.masked(F.col("price"), F.col("good"))).alias("first_price"))


@query("""WITH e AS (SELECT label, vec_id % 3 + 1 AS s, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label::INT AS label_idx, (pos // 8)::INT AS row_idx, (pos % 8)::INT AS tensor_axis_1_idx, round(sum(floor(x * 1000) * s), 4) AS value, round(sum((floor(x * 1000) * s) * (floor(x * 1000) * s)), 4) AS variance FROM e GROUP BY 1, 2, 3""")
def tensor_fill(spark, d):
    df = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 + 1).alias("s"), H.with_tensor_shape(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")), "w", (8, 8)))
    return rounded(H.histogram(df, "h", [Integer("label", False, False, 0, 10)], ["label", "w", "s"], tensor_axes=["row"]).data)


@query(f"""SELECT {_reg('l_quantity', 5, 0, 50)} AS qty_idx, t.k::INT AS syst_idx, round(sum(CASE t.k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN l_tax * 100 ELSE l_discount * 100 END), 4) AS value
FROM lineitem, range(3) t(k) GROUP BY 1, 2""")
def ragged_tensor_fill(spark, d):
    w = F.transform(F.arrays_zip("tax", "disc"), lambda e: F.array(F.lit(1.0), e["tax"] * 100, e["disc"] * 100))
    df = _orders(spark, d).select("qty", H.with_tensor_shape(w, "w", (3,)))
    return rounded(H.histogram(df, "h", [_AXES3[0]], ["qty", "w"], "double", tensor_axes=["syst"]).data)


@query("SELECT round(sum(value), 2) AS sum, count(*)::BIGINT AS count FROM events")
def sum_and_count(spark, d):
    return rounded(H.sum_and_count(table(spark, d, "events"), "value"), 2, "sum")


@query("SELECT event_id, (CASE WHEN value - 100 < 0 THEN -1.0 ELSE 1.0 END)::DOUBLE AS w FROM events")
def sign_weight(spark, d):
    return table(spark, d, "events").select("event_id", A.sign_weight(F.col("value") - 100).alias("w"))


@query(f"""SELECT n.name, {_var('value', _EDGES)} AS value_idx, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance, (SELECT count(*) FROM events)::BIGINT AS event_count,
(CASE n.name WHEN 'click' THEN 1 ELSE 2 END * (SELECT count(*) FROM events))::DOUBLE AS weight_sum FROM events JOIN (VALUES ('click'), ('view')) n(name) ON event_type = n.name GROUP BY 1, 2""")
def run_datasets(spark, d):
    def build(df, dataset):
        df = df.withColumn("weight", F.lit(1.0 if dataset.is_data else 2.0))
        totals = H.sum_and_count(df, "weight")
        df = df.where(F.col("event_type") == dataset.name)
        return [H.histogram(df, "h", [Variable("value", at=_EDGES)], ["value"])], totals

    sets = [R.Dataset("click", [f"{d}/events.parquet"], is_data=True), R.Dataset("view", [f"{d}/events.parquet"], xsec=1.0)]
    out = R.build_and_run(spark, sets, build)
    parts = [r["output"]["h"].data.select(F.lit(k).alias("name"), "*", F.lit(r["event_count"]).cast("long").alias("event_count"), F.lit(r["weight_sum"]).alias("weight_sum")) for k, r in out.items()]
    return parts[0].unionByName(parts[1])


_IV = {2: [[0, 199], [500, 749]], 5: [[100, 900]], 7: [[3, 3]], 11: [[0, 0], [2, 999]]}
_IV_SQL = " OR ".join(f"(user_id = {r} AND event_id % 1000 BETWEEN {a} AND {b})" for r, v in _IV.items() for a, b in v)


def _intervals(spark) -> DataFrame:
    text = "{" + ", ".join(f'"{r}": {v}' for r, v in _IV.items()) + "}"
    return readers.intervals_from_json(spark.range(1).select(F.lit(text).alias("value")))


@query(f"SELECT event_id, user_id FROM events WHERE {_IV_SQL}")
def interval_filter(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 1000).alias("lumi"))
    return L.filter_intervals(df, _intervals(spark), "user_id", "lumi", bypass=None).drop("lumi")


@query(f"SELECT event_id, user_id FROM events WHERE user_id = 1 OR {_IV_SQL}")
def interval_bypass(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 1000).alias("lumi"))
    return L.filter_intervals(df, _intervals(spark), "user_id", "lumi").drop("lumi")


@query("SELECT * FROM (VALUES " + ", ".join(f"({r}::BIGINT, {a}::BIGINT, {b}::BIGINT)" for r, v in _IV.items() for a, b in v) + ") t(run, first, last)")
def json_intervals(spark, d):
    return _intervals(spark)


@query("SELECT user_id, round(sum(user_id * 0.5::DOUBLE), 4) AS lumi, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def key_lookup_sum(spark, d):
    events = table(spark, d, "events")
    keys = events.select("user_id").distinct()
    # each key twice: the first by order counts
    lookup = keys.select(F.col("user_id").alias("k"), (F.col("user_id") * 0.5).alias("v"), F.lit(0).alias("o")).unionAll(keys.select(F.col("user_id").alias("k"), F.lit(-1.0).alias("v"), F.lit(1).alias("o")))
    out = L.lookup(events, lookup, {"user_id": "k"}, "v", "lumi", order="o")
    return out.groupBy("user_id").agg(F.round(F.sum("lumi"), 4).alias("lumi"), F.count(F.lit(1)).alias("n"))


@query("SELECT (event_id % 7)::BIGINT AS run, (event_id % 5)::BIGINT AS lumi, round(sum((event_id % 7) * 10 + event_id % 5), 4)::DOUBLE AS recorded, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def csv_lookup(spark, d):
    path = sinks.shared_folder(spark)
    lines = ["#tag, synthetic", "#run:fill,ls,time,delivered(/fb),recorded(/fb)"]
    lines += [f"{r}:77,{b}:{b},01/02/16 03:04:{b:02d},1.0,{r * 10 + b}.0" for r in range(7) for b in range(5)] + ["1:77,1:1,01/02/16 03:04:05,1.0,999.0", "#summary"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    events = table(spark, d, "events").select((F.col("event_id") % 7).alias("run"), (F.col("event_id") % 5).alias("lumi"))
    out = L.lookup(events, readers.read_luminosity(spark, path), {"run": "run", "lumi": "lumi"}, "value", "recorded", order="line")
    return out.groupBy("run", "lumi").agg(F.round(F.sum("recorded"), 4).alias("recorded"), F.count(F.lit(1)).alias("n"))


@query("SELECT e.event_id, h.n AS bin_content FROM events e JOIN (SELECT " + _var("value", _EDGES) + " AS b, count(*)::DOUBLE AS n FROM events GROUP BY 1) h ON " + _var("e.value", _EDGES) + " = h.b")
def hist_lookup(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    h = H.histogram(events, "h", [Variable("value", at=_EDGES)], ["value"], "double")
    return L.histogram_value(events, h, ["value"], "bin_content").select("event_id", "bin_content")


@query(f"""WITH h AS (SELECT {_int('l_linenumber', 1, 4)} AS line_idx, {_reg('l_quantity', 3, 0, 60)} AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)
SELECT line_idx, [coalesce(sum(n) FILTER (q = -1), 0.0), coalesce(sum(n) FILTER (q = 0), 0.0), coalesce(sum(n) FILTER (q = 1), 0.0), coalesce(sum(n) FILTER (q = 2), 0.0), coalesce(sum(n) FILTER (q = 3), 0.0)]::VARCHAR AS value FROM h GROUP BY 1""")
def tensor_payload(spark, d):
    h = H.histogram(table(spark, d, "lineitem"), "h", [Integer("line", lo=1, hi=4), Regular("q", bins=3, lo=0.0, hi=60.0)], ["l_linenumber", "l_quantity"], "double")
    out = L.tensor_payload(h, 1)
    return out.select("line_idx", F.concat(F.lit("["), F.concat_ws(", ", F.transform("value", lambda x: x.cast("string"))), F.lit("]")).alias("value"))


_KINDS = ("click", "view", "purchase", "signup", "error")
_COND = [StrCategory("kind", overflow=True, categories=_KINDS)]
_QUANT = [Regular("qv", False, False, 5, 0.0, 1.0), Variable("qu", False, False, (0.0, 0.1, 0.35, 0.5, 0.8, 1.0))]
_KIND_SQL = "(CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS)) + f" ELSE {len(_KINDS)} END)::INT"
_CUTS_SQL = f"""e AS (SELECT event_id, {_KIND_SQL} AS kind_idx, value AS v, user_id::DOUBLE AS u FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
r0 AS (SELECT *, row_number() OVER (PARTITION BY kind_idx ORDER BY v, event_id) - 1 AS r, count(*) OVER (PARTITION BY kind_idx) AS n FROM e),
c0 AS (SELECT event_id, kind_idx, v, u, ({" + ".join(f"(round_even({f}::DOUBLE * n, 0) <= r)::INT" for f in (0.2, 0.4, 0.6000000000000001, 0.8))})::INT AS q0 FROM r0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY kind_idx, q0 ORDER BY u, event_id) - 1 AS r, count(*) OVER (PARTITION BY kind_idx, q0) AS n FROM c0),
c1 AS (SELECT event_id, kind_idx, v, u, q0, ({" + ".join(f"(round_even({f}::DOUBLE * n, 0) <= r)::INT" for f in (0.1, 0.35, 0.5, 0.8))})::INT AS q1 FROM r1)"""
_EDGE_SQL = """, m0 AS (SELECT kind_idx, q0, min(v) AS lo, max(v) AS hi FROM c1 GROUP BY 1, 2), m1 AS (SELECT kind_idx, q0, q1, min(u) AS lo, max(u) AS hi FROM c1 GROUP BY 1, 2, 3)"""


def _quantiles(spark, d, continuous: bool = False) -> tuple[DataFrame, Q.Quantiles]:
    events = table(spark, d, "events").select("event_id", "event_type", "value", F.col("user_id").cast("double").alias("user"))
    return events, Q.build_quantiles(events, ["event_type", "value", "user"], _COND, _QUANT, continuous, ties=["event_id"])


@query(f"WITH {_CUTS_SQL}{_EDGE_SQL} SELECT kind_idx, q0, q1, lo AS min1, hi AS max1 FROM m1")
def quantile_build(spark, d):
    # cells that no event reached have no SQL row
    return _quantiles(spark, d)[1].cells.where(F.col("max1") > float("-inf")).select("kind_idx", "q0", "q1", "min1", "max1")


@query(f"""WITH {_CUTS_SQL}{_EDGE_SQL} SELECT kind_idx, q0, q1, 'qu' AS coord, (lo + hi) / 2 AS center, hi - lo AS width FROM m1
UNION ALL SELECT kind_idx, q0, q1, 'qv', (m0.lo + m0.hi) / 2, m0.hi - m0.lo FROM m1 JOIN m0 USING (kind_idx, q0)""")
def quantile_centers(spark, d):
    out = _quantiles(spark, d)[1].coordinates()
    return out.where((F.col("center") > float("-inf")) & ~F.isnan("width"))


@query(f"WITH {_CUTS_SQL}{_EDGE_SQL} SELECT kind_idx, q0, q1, round((m0.hi - m0.lo) * (m1.hi - m1.lo), 6) AS volume FROM m1 JOIN m0 USING (kind_idx, q0)")
def quantile_volumes(spark, d):
    out = _quantiles(spark, d)[1].volumes()
    return out.where(~F.isnan("volume")).select("kind_idx", "q0", "q1", F.round("volume", 6).alias("volume"))


_APPLY_SQL = f"""WITH {_CUTS_SQL}{_EDGE_SQL},
t0 AS (SELECT kind_idx, list_prepend(first(lo ORDER BY q0), list(hi ORDER BY q0)) AS e FROM m0 GROUP BY 1),
t1 AS (SELECT kind_idx, q0, list_prepend(first(lo ORDER BY q1), list(hi ORDER BY q1)) AS e FROM m1 GROUP BY 1, 2),
a0 AS (SELECT event_id, kind_idx, v, u, t0.e AS e0, greatest(0, least(4, len(list_filter(t0.e, lambda x: x <= v)) - 1))::INT AS i0 FROM e JOIN t0 USING (kind_idx)),
a1 AS (SELECT a0.*, t1.e AS e1, greatest(0, least(4, len(list_filter(t1.e, lambda x: x <= u)) - 1))::INT AS i1 FROM a0 JOIN t1 ON a0.kind_idx = t1.kind_idx AND a0.i0 = t1.q0)"""


@query(_APPLY_SQL + " SELECT event_id, i0 AS value_iquant, i1 AS user_iquant FROM a1")
def quantile_apply_int(spark, d):
    events, q = _quantiles(spark, d)
    return Q.define_quantiles(events, ["event_type", "value", "user"], q)[0].select("event_id", "value_iquant", "user_iquant")


def _cdf(e: str, i: str, x: str) -> str:
    lo, hi = f"{e}[{i} + 1]", f"{e}[{i} + 2]"
    return f"round(greatest(0.0, least(0.9999999999999999::DOUBLE, ({i} + CASE WHEN {hi} = {lo} THEN 0.5 ELSE ({x} - {lo}) / ({hi} - {lo}) END) / 5)), 9)"


@query(_APPLY_SQL + f" SELECT event_id, {_cdf('e0', 'i0', 'v')} AS value_quant, {_cdf('e1', 'i1', 'u')} AS user_quant FROM a1")
def quantile_apply_cont(spark, d):
    events, q = _quantiles(spark, d, continuous=True)
    return rounded(Q.define_quantiles(events, ["event_type", "value", "user"], q)[0].select("event_id", "value_quant", "user_quant"), 9, "value_quant", "user_quant")


@query(_APPLY_SQL + " SELECT i0 AS value_iquant_idx, i1 AS user_iquant_idx, count(*)::BIGINT AS value FROM a1 GROUP BY 1, 2")
def quantile_hist(spark, d):
    events, q = _quantiles(spark, d)
    df, axes, names = Q.define_quantiles(events, ["event_type", "value", "user"], q)
    return H.histogram(df, "h", axes, names, "int64").data


_FINE = Regular("fine", True, True, 49, 0.0, 490.0)


@query(f"""WITH f AS (SELECT {_KIND_SQL} AS kind_idx, {_reg('value', 49, 0, 490)} AS b, count(*) AS n FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind_idx ORDER BY b) AS cum, sum(n) OVER (PARTITION BY kind_idx) AS total FROM f),
k AS (SELECT kind_idx, t.k, min(b) FILTER (cum >= [0.2, 0.4, 0.6000000000000001, 0.8, 1.0][t.k + 1]::DOUBLE * total) AS cut FROM c, range(5) t(k) GROUP BY 1, 2)
SELECT kind_idx, k::INT AS q0, greatest(0, least(49, cut + 1)) * 10.0::DOUBLE AS edge FROM k""")
def quantile_from_fine(spark, d):
    fine = H.histogram(table(spark, d, "events"), "fine", [_COND[0], _FINE], ["event_type", "value"], "int64")
    q = Q.build_quantiles_from_fine(fine, ["kind"], {"fine": _QUANT[0]})
    return q.cells.where(F.col("max0") > float("-inf")).select("kind_idx", "q0", F.col("max0").alias("edge"))


@query("""SELECT event_id, greatest(0, least(3, len(list_filter([0.0, 100.0, 200.0, 300.0, 400.0], lambda x: x <= value)) - 1))::INT AS bin FROM events""")
def quantile_static(spark, d):
    return Q.static_lookup(table(spark, d, "events").select("event_id", "value"), "bin", [0.0, 100.0, 200.0, 300.0, 400.0], "value").select("event_id", "bin")


_PRICE = Regular("price", True, True, 10, 900.0, 105000.0)
_W = "(104100.0::DOUBLE / 10)"
_U = f"((l_extendedprice - (900.0::DOUBLE + ({_reg('l_extendedprice', 10, 900, 105000)} + 0.5::DOUBLE) * {_W})) / {_W})"
_IN = f"({_reg('l_extendedprice', 10, 900, 105000)} BETWEEN 0 AND 9)"
_SHIFT = f"(CASE WHEN {_IN} THEN 1.0 - 12.0 * ((l_extendedprice * 1.01::DOUBLE - l_extendedprice) / {_W}) * {_U} ELSE 1.0 END)"
_V = f"((l_extendedprice * 1.02::DOUBLE - l_extendedprice) / {_W})"
_SMEAR = f"(CASE WHEN {_IN} THEN 1.0 - 12.0 * {_V} * {_V} + (12.0 * {_V} * {_U}) * (12.0 * {_V} * {_U}) ELSE 1.0 END)"


def _priced(spark, d) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", (p * 1.01).alias("up"), (p * 1.02).alias("wide"))


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, round({_SHIFT}, 6) AS w FROM lineitem")
def shift_weight(spark, d):
    df = S.with_shift_weight(_priced(spark, d), "w", [_PRICE], ["l_extendedprice"], ["up"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_extendedprice", "w"), 6, "w")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, round({_SMEAR}, 6) AS w FROM lineitem")
def smear_weight(spark, d):
    df = S.with_shift_weight(_priced(spark, d), "w", [_PRICE], ["l_extendedprice"], None, ["wide"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_extendedprice", "w"), 6, "w")


@query(f"SELECT {_reg('l_extendedprice', 10, 900, 105000)} AS price_idx, round(sum({_SHIFT}), 4) AS value, round(sum({_SHIFT} * {_SHIFT}), 4) AS variance FROM lineitem GROUP BY 1")
def shifted_hist(spark, d):
    return rounded(S.shifted_histogram(_priced(spark, d), "h", [_PRICE], ["l_extendedprice"], ["up"]).data)


@query("SELECT l_returnflag, count(*)::BIGINT AS n, sum((l_returnflag = 'N')::INT)::BIGINT AS changed FROM lineitem GROUP BY 1")
def shift_discrete(spark, d):
    df = _priced(spark, d).withColumn("other", F.when(F.col("l_returnflag") == "N", "A").otherwise(F.col("l_returnflag")))
    df = S.with_shift_weight(df, "w", [StrCategory("flag", categories=("A", "N", "R"))], ["l_returnflag"], ["other"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.isnan("w").cast("long")).alias("changed"))


@query("""WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 100)::BIGINT FOR x IN embedding[1:10]] AS a, [floor(x::DOUBLE * 100)::BIGINT FOR x IN embedding[11:17]] AS b FROM embeddings)
SELECT vec_id, [a[i] * 2 + b[i] + vec_id FOR i IN range(1, 8)]::VARCHAR AS s FROM v""")
def map_broadcast(spark, d):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))
    df = table(spark, d, "embeddings").select("vec_id", F.slice(whole, 1, 10).alias("a"), F.slice(whole, 11, 7).alias("b"))
    df = A.define(df, "s", lambda a, b, v: a * 2 + b + v, ["a", "b", "vec_id"])
    return df.select("vec_id", F.concat(F.lit("["), F.concat_ws(", ", F.transform("s", lambda x: x.cast("string"))), F.lit("]")).alias("s"))


@query("SELECT vec_id, list_sum([floor(x::DOUBLE * 100)::BIGINT * (label + 1) FOR x IN embedding])::BIGINT AS total FROM embeddings")
def tensor_map(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("t"))
    out = A.tensor_map(lambda x, s: x * (s + 1), F.col("t"), F.col("label"))
    return df.select("vec_id", F.aggregate(out, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT least(l_linenumber, l_quantity::INT % 7) AS i, greatest(l_linenumber, l_quantity::INT % 7) AS j, sum(l_partkey)::BIGINT AS value FROM lineitem GROUP BY 1, 2")
def sym_matrix(spark, d):
    df = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity").cast("int") % 7).alias("k"), "l_partkey")
    return M.symmetric(df, "l_linenumber", "k", "l_partkey")


@query("SELECT (l_suppkey % 20)::BIGINT AS i, (l_partkey % 30)::BIGINT AS j, sum(l_linenumber - 1)::BIGINT AS value FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2")
def sparse_matrix(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 30).alias("b"), (F.col("l_linenumber") - 1).alias("v"))
    return M.sparse_matrix(df, "a", "b", "v")


@query("SELECT user_id AS key, min_by(event_type, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def flat_map_insert(spark, d):
    return M.insert_if_absent(table(spark, d, "events").where("user_id is not null"), "user_id", "event_type", "event_id")


_FUSED = [
    Fill("qty", [Regular("qty", True, True, 20, 0.0, 60.0)], ["l_quantity"]),
    Fill("price", [Regular("price", True, True, 50, 900.0, 105000.0)], ["l_extendedprice", "l_linenumber"]),
    Fill("line_tax", [Integer("line", lo=2, hi=6), Regular("tax", True, True, 4, 0.0, 0.1)], ["l_linenumber", "l_tax"]),
]


@query(f"""SELECT 0 AS hist, ({_reg('l_quantity', 20, 0, 60)} + 1)::BIGINT AS flat, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance FROM lineitem GROUP BY 2
UNION ALL SELECT 1, ({_reg('l_extendedprice', 50, 900, 105000)} + 1)::BIGINT, sum(l_linenumber)::DOUBLE, sum(l_linenumber * l_linenumber)::DOUBLE FROM lineitem GROUP BY 2
UNION ALL SELECT 2, (({_int('l_linenumber', 2, 6)} + 1) * 6 + {_reg('l_tax', 4, 0, 0.1)} + 1)::BIGINT, count(*)::DOUBLE, count(*)::DOUBLE FROM lineitem GROUP BY 2""")
def fused_histograms(spark, d):
    return fuse(table(spark, d, "lineitem"), _FUSED)


@query("SELECT round(sum((event_id % 7) * 10 + event_id % 5), 4)::DOUBLE AS lumi FROM events WHERE event_id % 7 = 1 OR (event_id % 7 = 3 AND event_id % 5 BETWEEN 1 AND 2)")
def luminosity_sum(spark, d):
    # one row per block is simulated by the events themselves
    path = sinks.shared_folder(spark)
    lines = ["#tag", "#run:fill,ls,recorded(/fb)"] + [f"{r}:1,{b}:{b},{r * 10 + b}.0" for r in range(7) for b in range(5)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    blocks = table(spark, d, "events").select((F.col("event_id") % 7).alias("run"), (F.col("event_id") % 5).alias("lumi"))
    certified = readers.intervals_from_json(spark.range(1).select(F.lit('{"1": [[0, 0]], "3": [[1, 2]]}').alias("value")))
    kept = L.filter_intervals(blocks, certified, "run", "lumi")
    out = L.lookup(kept, readers.read_luminosity(spark, path), {"run": "run", "lumi": "lumi"}, "value", "v", order="line", missing="lumi not found")
    return out.agg(F.round(F.sum("v"), 4).alias("lumi"))


@query("SELECT * FROM (VALUES (5::BIGINT, 1::BIGINT, 1454234400.0::DOUBLE), (5::BIGINT, 2::BIGINT, 1454234423.0::DOUBLE)) t(run, lumi, value)")
def csv_times(spark, d):
    path = sinks.shared_folder(spark)
    lines = ["#tag", "#run:fill,ls,time", "5:77,1:1,01/31/16 10:00:00", "5:77,2:2,01/31/16 10:00:23", "#end"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return readers.read_times(spark, path).select("run", "lumi", "value")


@query(_SPARSE3)
def histogram_sink(spark, d):
    """Written with its manifest and read back."""
    path = sinks.shared_folder(spark)
    sinks.write_histograms(spark, path, [H.histogram(table(spark, d, "lineitem"), "h", _AXES3, ["l_quantity", "l_discount", "l_returnflag", "l_tax"], "sparse")])
    return rounded(sinks.read_histograms(spark, path)[0]["h"].data)


@query(f"SELECT {_reg('l_quantity', 20, 0, 60)} AS qty_idx, {_int('l_linenumber', 2, 6)} AS line_idx, count(*)::DOUBLE AS value, count(*)::DOUBLE AS variance FROM lineitem GROUP BY 1, 2")
def histogram_conversion(spark, d):
    """To arrays with flow bins and back."""
    h = H.histogram(table(spark, d, "lineitem"), "h", [_QTY, Integer("line", lo=2, hi=6)], ["l_quantity", "l_linenumber"])
    return sinks.from_arrays(spark, sinks.to_arrays(h)).data


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS total, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def user_aggregate(spark, d):
    def partial(frames):
        import pandas as pd

        parts = [f.groupby("l_returnflag", as_index=False).agg(s=("l_linenumber", "sum"), m=("l_quantity", "max")) for f in frames if len(f)]
        return pd.concat(parts) if parts else pd.DataFrame({"l_returnflag": [], "s": [], "m": []})

    df = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    return custom_aggregate(df, partial, "l_returnflag string, s long, m double", ["l_returnflag"], [F.sum("s").alias("total"), F.max("m").alias("most")])


@query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) * 2, 3) + 0.0 AS y FROM embeddings")
def onnx_inference(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("a"), F.slice("embedding", 3, 2).alias("b"))
    return onnx_columns(df, sum_model(2), ["a", "b"], {"out": "twice"}).select("vec_id", F.round(F.col("out")[0], 3).alias("y"))


@query("SELECT range::BIGINT AS entry, (range % 20 + 0.5)::DOUBLE AS x FROM range(100)")
def generated_rows(spark, d):
    return readers.generate(spark, 100, x="double(entry % 20) + 0.5D")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)")
def multi_file_scan(spark, d):
    return readers.read_events(spark, [f"{d}/events.parquet", f"{d}/events.parquet"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i AS j, coalesce((SELECT sum(l_partkey) FROM lineitem WHERE (l_linenumber = 2 AND l_quantity::INT % 7 = i AND i >= 2) OR (l_quantity::INT % 7 = 2 AND l_linenumber = i AND i > 2)), 0)::DOUBLE AS value FROM range(8) r(i)")
def sym_matrix_row(spark, d):
    df = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity").cast("int") % 7).alias("k"), F.col("l_partkey").cast("double").alias("v"))
    return M.symmetric_row(M.symmetric(df, "l_linenumber", "k", "v"), 2, 8)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 * l_linenumber")
def flexible_filter(spark, d):
    return A.where(table(spark, d, "lineitem"), lambda q, n: q > 10 * n, ["l_quantity", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*)::BIGINT AS n, sum(n_nationkey)::BIGINT AS keys FROM nation")
def file_discovery(spark, d):
    """A table of the files that a pattern finds."""
    files = readers.list_files(spark, f"{d}/nation*.parquet")
    return readers.read_events(spark, files).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").cast("bigint").alias("keys"))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
c AS (SELECT value, ((round_even(0.2::DOUBLE * n, 0) <= r)::INT + (round_even(0.4::DOUBLE * n, 0) <= r)::INT + (round_even(0.6000000000000001::DOUBLE * n, 0) <= r)::INT + (round_even(0.8::DOUBLE * n, 0) <= r)::INT)::INT AS q0 FROM r)
SELECT q0, min(value) AS min0, max(value) AS max0 FROM c GROUP BY q0""")
def quantile_no_condition(spark, d):
    """No condition axes; ranked by range partitions."""
    events = table(spark, d, "events").select("event_id", "value")
    return Q.build_quantiles(events, ["value"], [], _QUANT[:1], ties=["event_id"], how=Q.RANGES).cells.select("q0", "min0", "max0")


_LOOK = "greatest(0, least(4, len(list_filter(t0.e, lambda y: y <= x)) - 1))::INT"


@query(_APPLY_SQL.split(",\na0 AS")[0] + f""" SELECT event_id, array_to_string([{_LOOK.replace('x)', 'v)')}, {_LOOK.replace('x)', 'v / 2)')}, {_LOOK.replace('x)', '2 * v)')}], ',') AS bins
FROM e JOIN t0 USING (kind_idx)""")
def quantile_array(spark, d):
    """An array column, looked up element by element in the edges of its row's condition."""
    events, q = _quantiles(spark, d)
    first = Q.Quantiles(q.tables[:1], q.cells, q.condition_axes, q.quantile_axes[:1], q.columns[:2], False)
    rows = events.where(F.col("value").isNotNull() & F.col("event_type").isNotNull() & F.col("user").isNotNull()).withColumn("values", F.array(F.col("value"), F.col("value") / 2, 2 * F.col("value")))
    out = Q.define_quantiles(rows, ["event_type", "values"], first)[0]
    return out.select("event_id", F.array_join(F.transform("values_iquant", lambda x: x.cast("string")), ",").alias("bins"))


@query(f"""WITH {_CUTS_SQL}{_EDGE_SQL}, g AS (SELECT k.k::INT AS kind_idx, q.q::INT AS q0 FROM range({len(_KINDS) + 1}) k(k), range(5) q(q))
SELECT g.kind_idx, g.q0, coalesce(m0.hi, '-infinity'::DOUBLE) AS max0 FROM g LEFT JOIN m0 USING (kind_idx, q0)""")
def quantile_empty_cells(spark, d):
    """Every cell, also of conditions that no event has (minus infinity)."""
    q = _quantiles(spark, d)[1]
    return q.cells.select("kind_idx", "q0", "max0").distinct()
