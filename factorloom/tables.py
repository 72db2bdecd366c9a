"""Panels and small lists made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources.panels import pct_change


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coin-like daily panel: one asset for each user; volume is missing on days divisible by 7.

    Sums are rounded, so that the order in which rows arrive decides nothing. A day opens and closes with
    events that have a value, as the SQL's arg_min and arg_max do; of several at one time, the first counts.
    """
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "value", "event_id")
    valued = F.col("value").isNotNull() & F.col("ts").isNotNull()
    earliest, latest = (F.when(valued, F.struct("ts", i)) for i in (F.col("event_id"), F.bitwise_not("event_id")))
    bars = e.groupBy("user_id", "day").agg(
        F.min_by("value", earliest).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", latest).alias("close"), F.round(F.sum("value"), 6).alias("volume")
    )
    out = bars.select(F.col("user_id").cast("string").alias("asset"), F.col("day").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.when(F.dayofmonth("day") % 7 != 0, F.col("volume")).alias("volume"))
    return out.withColumn("returns", pct_change(F.col("close"), "asset", order="ts"))


USER_DAY = """
b AS (SELECT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS DATE) AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close", round(sum(value), 6) AS vol
    FROM events GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN extract(day FROM day) % 7 <> 0 THEN vol END AS volume, lag("close") OVER a AS prev, lead("close") OVER a AS nxt, row_number() OVER a AS rn FROM b WINDOW a AS (PARTITION BY asset ORDER BY day)),
p AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN prev = 0 THEN CASE WHEN "close" > 0 THEN 'inf'::DOUBLE WHEN "close" < 0 THEN '-inf'::DOUBLE END ELSE "close" / prev END - 1 AS "returns",
    CASE WHEN "close" = 0 THEN CASE WHEN nxt > 0 THEN 'inf'::DOUBLE WHEN nxt < 0 THEN '-inf'::DOUBLE END ELSE nxt / "close" END - 1 AS fwd FROM q)"""


def user_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock-like panel over the same assets with times of its own: every third event, by half days."""
    e = load(spark, sf_dir, "events").where(F.col("event_id") % 3 == 0)
    half = F.date_trunc("day", "ts") + F.when(F.hour("ts") < 12, F.expr("INTERVAL 0 HOURS")).otherwise(F.expr("INTERVAL 12 HOURS"))
    rows = e.groupBy(F.col("user_id").cast("string").alias("asset"), half.cast("timestamp_ntz").alias("ts"))
    return rows.agg(F.max("value").alias("dlyclose"), F.count("*").cast("double").alias("dlyvol"))


USER_SPOT = """
sp AS (SELECT CAST(user_id AS VARCHAR) AS asset, CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE WHEN extract(hour FROM ts) < 12 THEN INTERVAL 0 HOURS ELSE INTERVAL 12 HOURS END AS t, max(value) AS dlyclose, count(*)::DOUBLE AS dlyvol FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)"""


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-equity-like rows: one asset for each brand, by month."""
    l = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = l.join(p, "l_partkey").groupBy(F.col("p_brand").alias("asset"), F.trunc("l_shipdate", "month").alias("day"))
    out = rows.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("dlyclose"), F.sum("l_quantity").alias("dlyvol"), F.sum("l_extendedprice").alias("dlycap"), F.max("l_extendedprice").alias("dlyhigh"), F.min("l_extendedprice").alias("dlylow"))
    before = F.lag("dlyclose").over(Window.partitionBy("asset").orderBy("day"))
    return out.withColumns({"dlyopen": F.col("dlyclose"), "dlyret": F.col("dlyclose") / before - 1})


BRAND_MONTH = """
bm AS (SELECT *, dlyclose AS dlyopen, dlyclose / lag(dlyclose) OVER (PARTITION BY asset ORDER BY day) - 1 AS dlyret FROM (
    SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS dlyclose, sum(l_quantity) AS dlyvol, sum(l_extendedprice) AS dlycap, max(l_extendedprice) AS dlyhigh, min(l_extendedprice) AS dlylow
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with quotes: one symbol for each event type; every eleventh trade has no quotes."""
    e = load(spark, sf_dir, "events")
    size = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)) + 1
    has = F.col("event_id") % 11 != 0
    middle = F.floor("value")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), size.alias("size"), F.when(has, middle + 0.95).alias("nbo"), F.when(has, middle + 0.05).alias("nbb"))


TICKS = """
tk AS (SELECT upper(trim(event_type)) AS symbol, ts, value AS price, coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0) + 1 AS size,
    CASE WHEN event_id % 11 <> 0 THEN ((floor(value) + 0.95::DOUBLE) + (floor(value) + 0.05::DOUBLE)) / 2.0::DOUBLE END AS mid,
    CASE WHEN event_id % 11 <> 0 THEN (floor(value) + 0.95::DOUBLE) - (floor(value) + 0.05::DOUBLE) END AS sp FROM events)"""

#: Completions as a model might write them, one for each order, by its key ``k``; the same text in Spark's SQL and DuckDB's.
_FUNCTION = "CASE k % 9 WHEN 0 THEN 'ts_mean' WHEN 1 THEN 'ts_std' WHEN 2 THEN 'ts_max' WHEN 3 THEN 'first' WHEN 4 THEN 'diff' WHEN 5 THEN 'zscore' WHEN 6 THEN 'abs' WHEN 7 THEN 'last' ELSE 'nofn' END"
_FIELD = "CASE k % 4 WHEN 0 THEN 'close' WHEN 1 THEN 'volume' WHEN 2 THEN 'returns' ELSE 'dlyclose' END"
_PARTS = f"SELECT k, {_FUNCTION} AS fn, {_FIELD} AS fd, CAST(k % 37 AS STRING) AS n, CAST(k % 11 + 2 AS STRING) AS m FROM (SELECT o_orderkey AS k FROM orders)"
_TWO = "SELECT *, fn || '(crypto.' || fd || '(' || n || '))' AS e1, CASE WHEN k % 2 = 0 THEN 'add(' || fn || '(crypto.' || fd || '(' || n || ')), ts_std(crypto.close(' || m || ')))' ELSE 'add(ts_std(crypto.close(' || m || ')), ' || fn || '(crypto.' || fd || '(' || n || ')))' END AS e2 FROM parts"
_TEXT = "CASE k % 7 WHEN 0 THEN '<expr>' || e1 || '</expr> and <EXPR> ' || e2 || chr(10) || '</EXPR>' WHEN 1 THEN 'so: <expr>' || e1 || '</expr><expr>' || e2 || '</expr>' WHEN 2 THEN e1 || chr(10) || chr(10) || '   ' || e2 || '  ' WHEN 3 THEN '  ' || e1 || chr(10) || e2 WHEN 4 THEN 'no expression here' WHEN 5 THEN '' ELSE '<expr></expr><expr>' || e2 || '</expr>' END"
COMPLETIONS_SQL = f"parts AS ({_PARTS}), two AS ({_TWO}), c AS (SELECT k AS ordinal, {_TEXT} AS text FROM two)"
#: What is in them; canonical forms are put together from the parts, not read.
REALIZED_SQL = """f AS (SELECT *, CASE WHEN fn = 'nofn' THEN 'syntax' WHEN fd = 'dlyclose' OR n = '0' THEN 'limit' ELSE '' END AS problem, CASE WHEN fn IN ('diff', 'zscore', 'abs') THEN 'array' ELSE 'scalar' END AS kind, fn <> 'nofn' AND fd <> 'dlyclose' AND n <> '0' AS ok, 'call:' || fn || '(field:crypto.' || fd || ':' || n || ')' AS f1, 'call:ts_std(field:crypto.close:' || m || ')' AS f3 FROM two),
r0 AS (SELECT k * 10 AS ordinal, e1 AS expr, ok AS valid, f1 AS form FROM f WHERE k % 7 < 4
    UNION ALL SELECT k * 10 + CASE WHEN k % 7 < 4 THEN 1 ELSE 0 END, e2, ok, 'call:add(' || least(f1, f3) || ',' || greatest(f1, f3) || ')' FROM f WHERE k % 7 < 4 OR k % 7 = 6
    UNION ALL SELECT k * 10, 'no expression here', false, '' FROM f WHERE k % 7 = 4),
r AS (SELECT ordinal, expr, valid, CASE WHEN valid THEN sha256(form) ELSE '' END AS signature FROM r0)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordinal, text``."""
    parts = spark.sql("WITH " + COMPLETIONS_SQL.replace("FROM orders", "FROM {orders}") + " SELECT ordinal, text FROM c", orders=load(spark, sf_dir, "orders"))
    return parts


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, metrics``: what each user's events are like; some metrics are missing for some."""
    e = load(spark, sf_dir, "events")
    p = e.groupBy("user_id").agg(
        F.count("*").cast("double").alias("events"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.min("value").alias("low"), F.stddev_samp("value").alias("spread"),
        F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("bought"), F.sum(F.when(F.col("event_id") % 17 == 0, F.col("value"))).alias("rare"),
    )
    names = [c for c in p.columns if c != "user_id"]
    return p.select("user_id", F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*names)).alias("metrics"))


PROFILES_SQL = """prof AS (SELECT user_id, count(*)::DOUBLE AS events, avg(value) AS mean, max(value) AS high, min(value) AS low, stddev_samp(value) AS spread, avg(CASE WHEN event_type = 'purchase' THEN value END) AS bought, sum(CASE WHEN event_id % 17 = 0 THEN value END) AS rare FROM events GROUP BY user_id),
long AS (SELECT * FROM (UNPIVOT prof ON events, mean, high, low, spread, bought, rare INTO NAME name VALUE x) WHERE isfinite(x))"""

#: Completions as a model might write them.
COMPLETIONS = (
    "<expr>ts_mean(crypto.close(5))</expr> and <EXPR> add(ts_mean(crypto.volume(3)), ts_std(crypto.close(4)))\n</EXPR>",
    "add(ts_std(crypto.close(4)), ts_mean(crypto.volume(3)))\n\n   neg(ts_mean(crypto.returns(3)))  ",
    "<expr>unknown(crypto.close(5))</expr>",
    "<expr>last(crsp.dlyclose(1))</expr>",
    "no expression here",
    "",
    "<expr></expr><expr>corr(crypto.close(9), crypto.volume(9))</expr>",
)
