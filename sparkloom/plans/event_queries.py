"""Registered queries over events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunks, usage
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import table

SECONDS = "epoch_us(ts) / 1e6"


@query(
    "event_stats_rollup",
    """WITH e AS (SELECT event_type AS h, (user_id % 7)::VARCHAR AS t, floor(value * 10)::BIGINT AS b, floor(value * 7)::BIGINT AS a, event_id % 5 AS d, CASE WHEN event_id % 11 = 0 THEN 'context' WHEN event_id % 13 = 0 THEN 'off' ELSE 'on' END AS s FROM events)
SELECT h, t, count(*) FILTER (WHERE s <> 'context')::BIGINT AS calls, count(*) FILTER (WHERE s <> 'context' AND a < b)::BIGINT AS changed, count(*) FILTER (WHERE s = 'off')::BIGINT AS off,
    coalesce(sum(b) FILTER (WHERE s <> 'context'), 0)::BIGINT AS before, coalesce(sum(a) FILTER (WHERE s <> 'context'), 0)::BIGINT AS after, coalesce(sum(d) FILTER (WHERE s <> 'context'), 0)::BIGINT AS dedup, coalesce(sum(d) FILTER (WHERE s = 'context'), 0)::BIGINT AS request_dedup
FROM e GROUP BY GROUPING SETS ((h), (t), ())""",
)
def event_stats_rollup(spark, sf_dir):
    state = F.when(F.col("event_id") % 11 == 0, "context").when(F.col("event_id") % 13 == 0, "off").otherwise("on")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("h"), (F.col("user_id") % 7).cast("string").alias("t"), F.floor(F.col("value") * 10).alias("b"), F.floor(F.col("value") * 7).alias("a"), (F.col("event_id") % 5).alias("d"), state.alias("s")
    )
    return usage.summarize(rows)


@query(
    "event_gap_policy",
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, (event_id % 4000)::DOUBLE AS fresh, (event_id * 7 % 60000)::DOUBLE AS read, (event_id * 13 % 50000)::DOUBLE AS written, (event_id % 900)::DOUBLE AS output FROM events),
x AS (SELECT *, fresh + read + written AS total FROM e),
y AS (SELECT *, t - lag(t) OVER w AS gap, lag(total) OVER w AS before, lead(t) OVER w IS NULL AS last FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
z AS (SELECT *, fresh * 4 + read * 0.2 + output * 20 AS base, total >= 20000 AND written > 0.5 * total AS rewrite, coalesce(gap >= 300 AND gap < 3600, false) AS idle FROM y)
SELECT user_id, count(*)::BIGINT AS requests,
    round(sum(base + written * 5 + CASE WHEN idle AND NOT rewrite THEN least(read, before) * 4.8 ELSE 0 END) / 1e6, 6) AS usd_5m,
    round(sum(base + written * 8 - CASE WHEN idle AND rewrite THEN least(written, before) * 7.8 ELSE 0 END) / 1e6, 6) AS usd_1h,
    round(sum(base + written * 5 + coalesce(floor(least(gap, 1200) / 240) * before * 0.2, 0) + CASE WHEN last THEN 5 * total * 0.2 ELSE 0 END - CASE WHEN idle AND rewrite AND gap < 1500 THEN least(written, before) * 4.8 ELSE 0 END + CASE WHEN idle AND NOT rewrite AND gap >= 1500 THEN least(read, before) * 4.8 ELSE 0 END) / 1e6, 6) AS usd_5m_alive
FROM z GROUP BY 1""",
)
def event_gap_policy(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), e.alias("seq"), (e % 4000).cast("double").alias("fresh"), (e * 7 % 60000).cast("double").alias("read"), (e * 13 % 50000).cast("double").alias("written"), (e % 900).cast("double").alias("output")
    )
    done = usage.gap_policy_costs(rows, "user_id")
    return done.select("user_id", "requests", *[F.round(c, 6).alias(c) for c in ("usd_5m", "usd_1h", "usd_5m_alive")])


@query(
    "event_repeat_suppression",
    "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
)
def event_repeat_suppression(spark, sf_dir):
    return usage.suppress_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("event_json_field", "SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_json_field(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 <= 1800 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*)::BIGINT AS events FROM s GROUP BY 1, 2""",
)
def event_sessions(spark, sf_dir):
    return usage.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


@query(
    "event_windows",
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query(
    "event_value_outliers",
    "SELECT event_id, event_type, round(m, 6) AS median FROM (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value > 8 * abs(m) OR value < m / 8",
)
def event_value_outliers(spark, sf_dir):
    return usage.outliers(table(spark, sf_dir, "events"), "event_type", "value").select("event_id", "event_type", F.round("median", 6).alias("median"))


@query(
    "event_rolling_spikes",
    """SELECT event_id, round(mean, 6) AS mean FROM (SELECT event_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS dev, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)) WHERE n = 16 AND abs(value - mean) > 2 * dev""",
)
def event_rolling_spikes(spark, sf_dir):
    return usage.rolling_spikes(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", sigmas=2.0).select("event_id", F.round("mean", 6).alias("mean"))


@query(
    "event_top_users",
    """WITH s AS (SELECT user_id, sum(event_id % 100) AS total FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, user_id::VARCHAR) AS k FROM s)
SELECT CASE WHEN k <= 8 THEN user_id::VARCHAR ELSE 'other' END AS name, sum(total)::BIGINT AS total, round(100.0 * sum(total) / (SELECT sum(total) FROM s), 6) AS percent FROM r GROUP BY 1""",
)
def event_top_users(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 100).alias("v"))
    return usage.top_and_rest(rows, "name", "v").select("name", "total", F.round("percent", 6).alias("percent"))


@query(
    "event_quantized",
    "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo) * 255)::INTEGER AS q FROM events, b",
)
def event_quantized(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bounds = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return events.join(F.broadcast(bounds)).select("event_id", T.quantize("value", "lo", "hi").alias("q"))  # bounds: one row


@query(
    "store_eviction",
    """WITH s AS (SELECT event_id, floor(epoch_us(ts) / 1e6)::BIGINT AS seen, (event_id % 97 + 1)::BIGINT AS size FROM events)
SELECT event_id FROM (SELECT event_id, sum(size) OVER (ORDER BY seen // 86400 DESC, seen DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM s) WHERE total <= 200000""",
)
def store_eviction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seen"), (F.col("event_id") % 97 + 1).alias("size"))
    return chunks.evict(rows, "seen", "size", 200000, "event_id").select("event_id")


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*)::BIGINT AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("count_order"))


@query(
    "nation_revenue_rank",
    """WITH r AS (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, n_name, revenue, rank() OVER (PARTITION BY r_name ORDER BY revenue DESC)::INTEGER AS place FROM r""",
)
def nation_revenue_rank(spark, sf_dir):
    from pyspark.sql import Window

    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    rows = spend.join(table(spark, sf_dir, "customer"), "c_custkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum("s"), 2).alias("revenue")).withColumn("place", F.rank().over(Window.partitionBy("r_name").orderBy(F.desc("revenue"))))


@query(
    "supplier_part_sets",
    """SELECT 'both' AS kind, count(*)::BIGINT AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'returned_only', count(*)::BIGINT FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def supplier_part_sets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    returned, accepted = (items.where(F.col("l_returnflag") == x).select("l_partkey") for x in "RA")
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(returned.intersect(accepted), "both").unionByName(one(returned.subtract(accepted), "returned_only"))


@query(
    "order_priority_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
def order_priority_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
