"""Queries over the call log: counts, windows, sessions, rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources.domain import table
from factloom.streaming.windows import sessions, windowed_counts


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


@query("tool_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-30, SRC-18."""
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """STM-01."""
    return windowed_counts(events(spark, sf), "ts", ["event_type"], "1 hour").withColumn("start", _text("start"))


@query("sliding_counts", "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """STM-01: windows of an hour every half hour."""
    return windowed_counts(events(spark, sf), "ts", ["event_type"], "1 hour", "30 minutes").withColumn("start", _text("start"))


@query(
    "session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """STM-01: sessions by a gap of six hours."""
    s = sessions(events(spark, sf), "ts", ["user_id"], "6 hours")
    return s.select("user_id", _text("start").alias("start"), _text("end").alias("end"), "n")


@query("daily_recurrence", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1, 2")
def daily_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """STM-02: recurrence counted once a day."""
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"))


@query("call_log_ring", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def call_log_ring(spark: SparkSession, sf: str) -> DataFrame:
    """STM-06."""
    return events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query("event_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, date_trunc('day', ts)")
def event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """STM-03: the first of each day, without shuffling payloads."""
    return events(spark, sf).groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("d")).agg(F.min("event_id").alias("event_id")).drop("d")


@query("latest_price_as_of", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey % 50 AS k, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 50, o_orderdate ORDER BY o_orderkey) = 1) o ON e.user_id % 50 = o.k AND e.ts >= o.o_orderdate")
def latest_price_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """An as-of lookup, which the domain lacks: each event with the last order before it, by one union and a window."""
    e = events(spark, sf).select((F.col("user_id") % 50).alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("long").alias("o"), F.lit(1).alias("side"))
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.col("o_orderdate").alias("t")).agg(F.min("o_orderkey").alias("o"))
    o = o.select("k", "t", F.lit(None).cast("long").alias("event_id"), "o", F.lit(0).alias("side"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w)).where("side = 1").select("event_id", "o_orderkey")


# Shapes over the star schema, where a domain relation is too thin


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with pushed filter, pruned columns and partial aggregation."""
    l = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    "revenue_by_nation",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Joins over three sizes; nation is a dimension of fixed size."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("top_customers_per_segment", "SELECT c_mktsegment, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 15")
def top_customers_per_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k per group with the window limit pushed below the shuffle."""
    from factloom.operators.relational import top_per_group

    return top_per_group(table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 15).select("c_mktsegment", "c_custkey", "rank")


@query("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
