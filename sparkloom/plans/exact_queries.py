"""Registered queries of order-dependent and lexeme-exact operators (SQL checks what it can state of them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import CREDENTIALS
from sparkloom.operators import digests, exact, logs, redaction, sessions
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import table
from sparkloom.sources import readers


def _as_json(spark, sf_dir):
    """Events of each user as one JSON array of records."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", "event_type", "value", "props").alias("r"))
    return rows.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("text"))


def _checked(done, *keys):
    """Whether each encoded text decodes to the text, and is not longer."""
    return done.select(*keys, "exact", (F.col("saved") >= 0).alias("not_longer"))


@query("exact_round_trip_documents", "SELECT doc_id, true AS exact, true AS not_longer FROM documents")
def exact_round_trip_documents(spark, sf_dir):
    return _checked(exact.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", (*exact.DEFAULT, "repeats")), "doc_id")


@query("exact_round_trip_json", "SELECT DISTINCT user_id, true AS exact, true AS not_longer FROM events")
def exact_round_trip_json(spark, sf_dir):
    return _checked(exact.round_trip(_as_json(spark, sf_dir), "text"), "user_id")


@query("exact_round_trip_search_hits", "SELECT doc_id, true AS exact, true AS not_longer FROM documents WHERE text <> ''")
def exact_round_trip_search_hits(spark, sf_dir):
    """Lines of documents as search output: one hit a line, grouped by file on the way."""
    from sparkloom.plans.text_queries import numbered_lines

    rows = numbered_lines(table(spark, sf_dir, "documents"))
    hit = F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt:"), (F.col("pos") + 1).cast("string"), F.lit(":"), F.col("line"))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", hit.alias("h")))), lambda x: x["h"]), "\n").alias("text"))
    return _checked(exact.round_trip(texts, "text", ("hits",)), "doc_id")


@query("conversation_line_dedup", "SELECT conv_id, turn, true AS exact, true AS not_longer FROM conversations")
def conversation_line_dedup(spark, sf_dir):
    """Each conversation with references to its own earlier turns, and whether they expand exactly."""
    return sessions.dedup_sessions(table(spark, sf_dir, "conversations"), "conv_id", "turn").transform(_checked, "conv_id", "turn")


@query(
    "conversation_guard",
    """WITH n AS (SELECT conv_id, turn, md5(text) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
t AS (SELECT *, coalesce(n - lag(n) OVER (PARTITION BY conv_id, key ORDER BY n) <= 3, false) AS trip FROM n)
SELECT t.conv_id, t.turn, EXISTS (SELECT 1 FROM t AS b WHERE b.conv_id = t.conv_id AND b.trip AND b.n BETWEEN t.n - 10 AND t.n) AS held FROM t""",
)
def conversation_guard(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("key"))
    return sessions.guard_sessions(turns, "conv_id", "turn", "key")


@query("conversation_overlap_trim")
def conversation_overlap_trim(spark, sf_dir):
    done = sessions.overlap_trim(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return done.select("conv_id", "turn", F.length("trimmed").cast("long").alias("chars"))


@query(
    "redaction_round_trip",
    r"""SELECT doc_id, true AS exact, 0::BIGINT AS leaks, regexp_matches(text, '(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{16}([^A-Z0-9]|$)|(^|[^A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,})') AS keys FROM documents""",
)
def redaction_round_trip(spark, sf_dir):
    done = table(spark, sf_dir, "documents").select("doc_id", "text", redaction.redacted(F.col("text")).alias("r"))
    back = redaction.restored(F.col("r.text"), F.col("r.labels"))
    leaks = sum(F.regexp_count(F.col("r.text"), F.lit(p)) for _, p in CREDENTIALS)
    keys = F.exists(F.map_keys("r.labels"), lambda k: k.rlike("AWS_ACCESS_KEY|GH_TOKEN"))
    return done.select("doc_id", (back == F.col("text")).alias("exact"), leaks.cast("long").alias("leaks"), keys.alias("keys"))


@query("log_templates_compacted")
def log_templates_compacted(spark, sf_dir):
    """Events as one log per user, compacted by templates."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event_type", F.concat(F.lit("value="), F.round("value", 2).cast("string")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    done = rows.select("user_id", F.length("text").cast("long").alias("before"), F.length(logs.compacted(F.col("text"))).cast("long").alias("after"))
    return done


@query("json_digests")
def json_digests(spark, sf_dir):
    done = _as_json(spark, sf_dir).select("user_id", "text", digests.digested(F.col("text")).alias("d"))
    return done.select("user_id", "d.rules", F.length("text").cast("long").alias("before"), F.length("d.text").cast("long").alias("after"))


@query("recovery_store", "SELECT substr(sha256(text), 1, 12) AS key, sha256(text) AS sha256, length(any_value(text))::BIGINT AS chars FROM documents GROUP BY sha256(text)")
def recovery_store(spark, sf_dir):
    return digests.recovery_store(table(spark, sf_dir, "documents")).select("key", "sha256", F.length("text").cast("long").alias("chars"))


@query(
    "conversation_calls",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, pos::INTEGER AS pos, turn::VARCHAR AS call_id, 'result' AS kind, length(text)::BIGINT AS chars FROM p WHERE role <> 'user'""",
)
def conversation_calls(spark, sf_dir):
    """Conversations as chat request bodies, read back as calls and results."""
    turn = F.struct(F.when(F.col("role") == "user", "user").otherwise("tool").alias("role"), F.col("text").alias("content"), F.col("turn").cast("string").alias("tool_call_id"))
    bodies = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("m")))), lambda x: x["m"]).alias("messages"))).alias("body"))
    return readers.request_calls(bodies, "conv_id").select("conv_id", "pos", "call_id", "kind", F.length("text").cast("long").alias("chars"))


@query(
    "turn_chain_depth",
    """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS depth, conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations""",
)
def turn_chain_depth(spark, sf_dir):
    """Turns linked to the turn before; depth and root by doubling."""
    from pyspark.sql import Window

    name = F.concat_ws(":", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("uuid"))
    rows = rows.withColumn("parent", F.lag("uuid").over(Window.partitionBy("conv_id").orderBy("turn")))
    return readers.parent_chain(rows).select("conv_id", "turn", F.col("depth").cast("int").alias("depth"), "root")
