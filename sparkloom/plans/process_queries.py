"""Registered queries of the whole treatment, pruning and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import is_protected
from sparkloom.operators import audit, pruning, views
from sparkloom.plans.process import PRESETS, process
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import table
from sparkloom.sources import sinks


def _processed(name):
    @query(f"process_{name}")
    def run(spark, sf_dir):
        return process(table(spark, sf_dir, "documents").select("doc_id", "text"), PRESETS[name]).select("doc_id", "stage", "rules", "saved")

    return run


for _name in PRESETS:
    _processed(_name)


@query("prune_half")
def prune_half(spark, sf_dir):
    done = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", pruning.pruned(F.col("text"), 0.5).alias("short"))
    return done.select("conv_id", "turn", F.length("text").cast("long").alias("before"), F.length("short").cast("long").alias("after"))


@query("prune_survival")
def prune_survival(spark, sf_dir):
    """Protected words that survive pruning to half, over all conversations."""
    done = table(spark, sf_dir, "conversations").select("text", pruning.pruned(F.col("text"), 0.5).alias("short"))
    return audit.summarize_survival(audit.survival(done, "text", "short", is_protected))


@query(
    "price_positions",
    """WITH i AS (SELECT user_id AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type, (event_id % 700)::BIGINT AS tokens FROM events),
q AS (SELECT r, sum(tokens) // 2 AS read, sum(tokens) // 4 AS written, sum(tokens) // 8 AS hour FROM i GROUP BY 1),
p AS (SELECT i.*, q.read, q.written, q.hour, sum(tokens) OVER (PARTITION BY r ORDER BY pos) AS e FROM i JOIN q USING (r)),
u AS (SELECT event_type, greatest(0, least(e, read) - greatest(e - tokens, 0)) * 0.2 + greatest(0, least(e, read + written) - greatest(e - tokens, read)) * (5.0 * (written - hour) + 8.0 * hour) / greatest(written, 1) + greatest(0, e - greatest(e - tokens, read + written)) * 4.0 AS usd FROM p)
SELECT event_type AS component, round(sum(usd) / 1e6, 8) AS usd FROM u GROUP BY 1""",
)
def price_positions(spark, sf_dir):
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    items = events.select(F.col("user_id").alias("r"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), "event_type", (F.col("event_id") % 700).alias("tokens"))
    total = items.groupBy("r").agg(F.sum("tokens").alias("s"))
    part = lambda k: F.floor(F.col("s") / k)
    priced = audit.price_by_position(items, total.select("r", part(2).alias("read"), part(4).alias("written"), part(8).alias("hour"), F.lit(0).alias("fresh")), "r")
    return priced.groupBy(F.col("event_type").alias("component")).agg(F.round(F.sum("usd"), 8).alias("usd"))


@query(
    "audit_breakdown",
    """WITH c AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'tool result' ELSE event_type END AS component, user_id::VARCHAR AS source, value / 1000 AS usd FROM events),
s AS (SELECT component, source, sum(usd) AS usd FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY usd DESC, source) AS k FROM s)
SELECT component, CASE WHEN component = 'tool result' THEN CASE WHEN k <= 8 THEN source ELSE 'other' END END AS source, round(sum(usd), 6) AS usd, round(100 * sum(usd) / (SELECT sum(usd) FROM s), 6) AS percent FROM r GROUP BY 1, 2""",
)
def audit_breakdown(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 == 0, "tool result").otherwise(F.col("event_type")).alias("component"), F.col("user_id").cast("string").alias("source"), (F.col("value") / 1000).alias("usd"))
    return audit.breakdown(rows).select("component", "source", F.round("usd", 6).alias("usd"), F.round("percent", 6).alias("percent"))


@query("event_mean_intervals")
def event_mean_intervals(spark, sf_dir):
    return audit.bootstrap(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value", samples=200)


@query(
    "conversation_line_index",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM conversations)
SELECT conv_id, turn, (n + 1)::INTEGER AS n, substr(line, 1, 400) AS body FROM l WHERE trim(line) <> ''""",
)
def conversation_line_index(spark, sf_dir):
    return sinks.line_index(table(spark, sf_dir, "conversations"), "conv_id", "text", ["turn"])


@query(
    "conversation_new_lines",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM conversations),
s AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY conv_id, n ORDER BY turn) = line, false) AS same FROM l),
v AS (SELECT *, min(n) FILTER (WHERE NOT same) OVER g AS f, max(n) FILTER (WHERE NOT same) OVER g AS t, min(n) OVER g AS lo, max(n) OVER g AS hi FROM s WINDOW g AS (PARTITION BY conv_id, turn))
SELECT conv_id, turn, n::INTEGER AS n FROM v WHERE n >= CASE WHEN coalesce(f, hi) - lo >= 3 THEN coalesce(f, hi) ELSE lo END AND n <= CASE WHEN hi - coalesce(t, hi) >= 3 THEN coalesce(t, hi) ELSE hi END""",
)
def conversation_new_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("file").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    lines = rows.select("conv_id", "turn", "path", (F.col("p") + 1).alias("n"), "line")
    return views.trim_shown(lines, "conv_id", "turn", "path").select("conv_id", "turn", "n")
