"""Registered queries of single operators on inputs that exercise them, each with its DuckDB oracle.

Inputs that the tables do not have (logs, listings, request logs, notebooks) are made from their rows
by expressions that both engines read alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import audit, chunking, chunks, exact, lines, retrieval, transcripts, usage, views
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import LINES, numbered_lines, table
from sparkloom.sources import readers, scratch, sinks

# --- exact encoders: one text a document that the rule shortens, decoded again -----------------------------------------

#: rule: (first part, line i of document k, separator, last part)
SHAPES = {
    "hits": ("''", "concat('src/app/module', k, '.py:', i, ':    value = ', i)", "chr(10)", "''"),
    "paths": ("''", "concat('src/app/components/widgets', k, '/file', i, '.tsx')", "chr(10)", "''"),
    "numbered": ("''", "concat(lpad(concat('', i), 6, ' '), chr(9), 'line of code ', i * k)", "chr(10)", "''"),
    "table": ("''", "concat(rpad(concat('pod-', i), 30, ' '), rpad('Running', 20, ' '), rpad(concat(i, 'm'), 15, ' '), 'node ', k)", "chr(10)", "''"),
    "prefix": ("''", "concat('[2024-01-01T00:00:00Z] event number ', i, ' happened at ', k)", "chr(10)", "''"),
    "snapshot": ("concat('```yaml', chr(10))", "concat('  - button \"B', i, '\" [ref=e', i, '] [cursor=pointer]')", "chr(10)", "concat(chr(10), '```')"),
    "diff": (
        "''",
        "concat('diff --git a/f', i, '.py b/f', i, '.py', chr(10), 'index 1..2', chr(10), '--- a/f', i, '.py', chr(10), '+++ b/f', i, '.py', chr(10), '@@ -1 +1 @@', chr(10), '-a', k, chr(10), '+b')",
        "chr(10)", "''",
    ),
    "rows": ("'{\"items\":['", "concat('{\"id\":', i, ',\"name\":\"n', i, '\",\"tags\":[\"a\",', k, ']}')", "','", "'],\"x\":1}'"),
    "defs": ("'['", "concat('[{\"a\": \"some long value here\", \"b\": ', k, '}, ', i, ', {\"a\": \"some long value here\", \"b\": ', k, '}]')", "', '", "']'"),
    "ascii": ("'{\"k\": \"'", "concat(chr(92), 'u017c', chr(92), 'u00f3', chr(92), 'u0142', chr(92), 'u0107 ', i)", "' '", "'\"}'"),
    "files": ("'{\"files\": ['", "concat('\"a/b/c', i, '_', k, '.py\"')", "', '", "']}'"),
    "repeats": ("''", "concat('a rather long line number ', i % 6, ' of block ', k)", "chr(10)", "''"),
    "crlf": ("''", "concat('src/app/module', k, '.py:', i, ':    value = ', i)", "concat(chr(13), chr(10))", "''"),
}


def _shape(rule: str):
    head, line, sep, tail = SHAPES[rule]
    duck = f"SELECT doc_id, {head} || array_to_string(list_transform(range(1, 19), lambda i: {line}), {sep}) || {tail} AS text FROM (SELECT doc_id, doc_id % 50 AS k FROM documents)"

    @query(f"exact_rule_{rule}", f"SELECT doc_id, true AS fired, true AS shorter, sha256(text) AS decoded_sha256 FROM ({duck})")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("k"))
        rows = rows.select("doc_id", F.expr(f"concat({head}, array_join(transform(sequence(1, 18), i -> {line}), {sep}), {tail})").alias("text"))
        done = rows.select("doc_id", "text", exact.encoded(F.col("text"), (*exact.DEFAULT, "repeats")).alias("e"))
        fired, shorter = F.array_contains("e.rules", rule), F.length("e.text") < F.length("text")
        return done.select("doc_id", fired.alias("fired"), shorter.alias("shorter"), F.sha2(exact.decoded(F.col("e.text"), F.col("e.rules")), 256).alias("decoded_sha256"))


for _rule in SHAPES:
    _shape(_rule)


# --- text functions --------------------------------------------------------------------------------------------------


@query("marker_escapes", "SELECT doc_id, sha256(chr(92) || '[sl:x]' || chr(10) || text) AS escaped_sha256, sha256('[sl:x]' || chr(10) || text) AS back_sha256 FROM documents")
def marker_escapes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[sl:x]\n"), "text").alias("t")).select("doc_id", T.escape_markers("t").alias("e"))
    return rows.select("doc_id", F.sha2("e", 256).alias("escaped_sha256"), F.sha2(T.unescape_markers("e"), 256).alias("back_sha256"))


@query("json_compacted", """SELECT event_id, concat('{"a":', event_id, ',"b":"x  y","c":[1,', user_id, ']}') AS json FROM events""")
def json_compacted(spark, sf_dir):
    wide = F.expr("""concat('{ "a" : ', event_id, ' ,', chr(10), ' "b" : "x  y",', chr(9), '"c": [ 1, ', user_id, ' ] }')""")
    return table(spark, sf_dir, "events").select("event_id", T.json_compact(wide).alias("json"))


@query("command_keys", "SELECT event_id, concat('ls -la dir', event_id) AS key FROM events")
def command_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.command_key(F.expr("concat(' ls   -la  dir', event_id, ' 2>&1 | head -n 5 | tail -3')")).alias("key"))


@query(
    "image_token_counts",
    """WITH s AS (SELECT event_id, (event_id % 3000 + 1)::DOUBLE AS w, (event_id * 7 % 2000 + 1)::DOUBLE AS h FROM events), f AS (SELECT *, least(1.0, 1568.0 / greatest(w, h)) AS f FROM s)
SELECT event_id, ceil(w * f * h * f / 750)::BIGINT AS tokens FROM f""",
)
def image_token_counts(spark, sf_dir):
    size = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3000 + 1).cast("double").alias("w"), (F.col("event_id") * 7 % 2000 + 1).cast("double").alias("h"))
    return size.select("event_id", T.image_tokens("w", "h").alias("tokens"))


#: Log lines by event, in both engines; some are alarms.
LOG_LINE = (
    "CASE event_id % 11 WHEN 0 THEN concat('ERROR: disk ', event_id) WHEN 1 THEN '' WHEN 2 THEN concat('  app.ValueError: bad value ', event_id) WHEN 3 THEN concat('GET /a status=', 400 + user_id % 200) "
    "WHEN 4 THEN 'connection timed out' WHEN 5 THEN concat('process exited with code ', user_id % 3) WHEN 6 THEN 'terror and errorless words' ELSE concat('step ', event_id, ' done') END"
)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("alarm_lines", f"SELECT event_id, regexp_matches({LOG_LINE}, {_sql(T.ALARM)}) AS alarm FROM events")
def alarm_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.is_alarm(F.expr(LOG_LINE)).alias("alarm"))


@query(
    "event_error_context",
    f"""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, {LOG_LINE} AS line FROM events),
m AS (SELECT *, regexp_matches(line, {_sql(T.ERROR_LINE)}) AS e, regexp_matches(line, {_sql(T.ERROR_LINE)}) AND regexp_matches(line, {_sql(T.RAISED)}) AS f, trim(line) = '' AS blank FROM l),
b AS (SELECT *, sum(blank::INTEGER) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM m),
n AS (SELECT *, max(e::INTEGER) OVER (PARTITION BY user_id, b ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + max(f::INTEGER) OVER (PARTITION BY user_id, b ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) > 0 AS near FROM b)
SELECT user_id, pos::INTEGER AS pos FROM n WHERE e OR (near AND NOT blank)""",
)
def event_error_context(spark, sf_dir):
    """Error lines of each user's log with the lines around them."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"), F.expr(LOG_LINE).alias("line"))
    return lines.error_lines(rows, ["user_id"]).where("keep").select("user_id", "pos")


@query(
    "local_targets",
    "SELECT event_id, event_id % 5 IN (0, 1, 2) AS is_local FROM events",
)
def local_targets(spark, sf_dir):
    url = F.expr("CASE event_id % 5 WHEN 0 THEN concat('http://localhost:', event_id, '/x') WHEN 1 THEN '127.0.0.1' WHEN 2 THEN 'https://[::1]/a' WHEN 3 THEN concat('http://localhost.example/', event_id) END")
    return table(spark, sf_dir, "events").select("event_id", T.is_local_target(url).alias("is_local"))


@query("parsed_times", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events")
def parsed_times(spark, sf_dir):
    """Times as ISO text, seconds, milli-, micro- and nanoseconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    forms = [F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX"), *((seconds * F.lit(10**k)).cast("string") for k in (0, 3, 6, 9))]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(T.parse_time(text)).cast("long").alias("t"))


@query("event_dequantized", "SELECT event_id, round(-1 + event_id % 256 / 255.0 * 3, 9) AS value FROM events")
def event_dequantized(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(T.dequantize(F.col("event_id") % 256, F.lit(-1), F.lit(2)), 9).alias("value"))


@query("event_logits", "SELECT event_id, round(greatest(0.001, least(0.999, event_id % 1001 / 1000.0)), 9) AS p FROM events")
def event_logits(spark, sf_dir):
    """Probabilities to logits and back: only the bounds change them."""
    return table(spark, sf_dir, "events").select("event_id", F.round(T.sigmoid(T.logit(F.col("event_id") % 1001 / 1000)), 9).alias("p"))


@query("atom_counts", "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS atoms, sha256(regexp_extract(text, '(?s)^(.*\\S)?', 0)) AS joined_sha256 FROM documents")
def atom_counts(spark, sf_dir):
    """Atoms of each text, which joined with their blanks are the text without its last blanks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.atoms("text").alias("a"))
    return rows.select("doc_id", F.size("a").cast("long").alias("atoms"), F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["ws"], x["text"])), ""), 256).alias("joined_sha256"))


@query(
    "text_sizes",
    """SELECT doc_id, length(text) / 4.0 AS by_4, length(text) / 2.5 AS by_2_5, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS utf16,
    list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS longest, round(greatest(octet_length(encode(text)) / (0.9 * 4096), len(string_split(text, chr(10))) / 90.0), 6) AS over_cap FROM documents""",
)
def text_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.chars_per_token("text").alias("by_4"), T.chars_per_token("text", 2.5).alias("by_2_5"), T.utf16_length("text").alias("utf16"), T.longest_line("text").cast("long").alias("longest"), F.round(views.over_cap(F.col("text"), 4096, 100), 6).alias("over_cap")
    )


@query("json_shapes", "SELECT event_id, event_id % 3 = 0 AS is_json FROM events")
def json_shapes(spark, sf_dir):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN left(props, length(props) - 1) ELSE concat('x ', props) END")
    return table(spark, sf_dir, "events").select("event_id", views.json_shaped(text).alias("is_json"))


@query("document_chunks", "SELECT doc_id, sha256(text) AS joined_sha256, true AS fit FROM documents WHERE text <> ''")
def document_chunks(spark, sf_dir):
    """Chunks of a token budget: none is over it by more than a rest, and joined they are the text."""
    rows = chunking.chunk_table(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk"))), lambda x: x["chunk"]), "")
    return rows.groupBy("doc_id").agg(F.sha2(joined, 256).alias("joined_sha256"), (F.max(T.est_tokens("chunk")) <= chunking.MOST + chunking.LEAST + 64).alias("fit"))


@query("normed_words", "SELECT DISTINCT replace(lower(w), 'ß', 'ss') AS word FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents)")
def normed_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("w"))
    return words.select(T.norm("w").alias("word")).distinct()


@query(
    "identifier_atoms",
    f"""WITH a AS (SELECT lang, unnest(regexp_extract_all(text, '\\S+')) AS a FROM documents)
SELECT lang, count(*)::BIGINT AS atoms, count(*) FILTER (WHERE regexp_matches(a, {_sql(T.STRICT_ID)}))::BIGINT AS strict, count(*) FILTER (WHERE length(a) >= 4 AND regexp_matches(a, {_sql(T.ARTIFACT_ID)}))::BIGINT AS artifacts FROM a GROUP BY 1""",
)
def identifier_atoms(spark, sf_dir):
    """Identifiers by shape among the atoms of each language."""
    found = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    count = lambda p: F.coalesce(F.sum(F.size(F.filter(found, p))), F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "documents").where(F.size(found) > 0)
    return rows.groupBy("lang").agg(count(lambda a: F.lit(True)).alias("atoms"), count(T.is_strict_id).alias("strict"), count(T.is_prose_artifact_id).alias("artifacts"))


@query(
    "atom_token_costs",
    r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\s*)(\S+)', 1)) AS ws, unnest(regexp_extract_all(text, '(\s*)(\S+)', 2)) AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN contains(ws, chr(10)) THEN 0.7 ELSE 0 END + CASE WHEN length(t) = 1 THEN CASE WHEN regexp_matches(t, '^[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]') THEN 0.9 WHEN regexp_matches(t, '^[\p{L}\p{N}]') THEN 1.0 ELSE 0.85 END
    WHEN regexp_matches(t, '^[\x00-\x7F]*$') THEN greatest(1.0, coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]'), lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN CASE WHEN length(p) <= 6 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + (length(p) - 6) / 5.0::DOUBLE END WHEN regexp_matches(p, '^[0-9]') THEN ceil(length(p) / 3.0::DOUBLE) ELSE 0.75::DOUBLE END)), 0))
    WHEN regexp_matches(t, '[^\x00-\x{036F}]') THEN greatest(1.0, length(t) / 3.2::DOUBLE) ELSE greatest(1.0, length(t) / 4.2::DOUBLE) END AS cost FROM a)
SELECT doc_id, round(sum(cost)::DOUBLE, 4) AS tokens FROM c GROUP BY 1""",
)
def atom_token_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.atoms("text").alias("a")).where(F.size("a") > 0)
    return rows.select("doc_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + T.atom_tokens(x["text"], x["ws"])), 4).alias("tokens"))


@query(
    "detokenized_documents",
    r"""WITH a AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '\S+')))) AS i, unnest(regexp_extract_all(text, '(\s*)(\S+)', 1)) AS ws, unnest(regexp_extract_all(text, '(\s*)(\S+)', 2)) AS t FROM documents),
k AS (SELECT *, i % 5 < 3 AS keep, CASE WHEN regexp_matches(ws, '\n[^\S\n]*\n') THEN 2 WHEN contains(ws, chr(10)) THEN 1 ELSE 0 END AS w FROM a),
g AS (SELECT *, CASE i % 5 WHEN 0 THEN greatest(w, lag(w, 1) OVER d, lag(w, 2) OVER d) END AS gap FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, sha256(string_agg(CASE WHEN i = 0 THEN '' WHEN i % 5 = 0 THEN [' ', chr(10), chr(10) || chr(10)][gap + 1] ELSE ws END || t, '' ORDER BY i)) AS text_sha256 FROM g WHERE keep GROUP BY 1""",
)
def detokenized_documents(spark, sf_dir):
    """Three of every five atoms, joined again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.atoms("text").alias("a")).where(F.size("a") > 0)
    keep = F.transform("a", lambda x, i: i % 5 < 3)
    return rows.select("doc_id", F.sha2(T.detok(F.col("a"), keep), 256).alias("text_sha256"))


@query(
    "atom_windows",
    r"WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents) SELECT doc_id, n::BIGINT AS atoms, ceil(n / (100 // (1 + doc_id % 7))::DOUBLE)::BIGINT AS windows, least(n, 100 // (1 + doc_id % 7))::BIGINT AS first FROM a WHERE n > 0",
)
def atom_windows(spark, sf_dir):
    """Windows of 100 tokens over atoms of 1 to 7 tokens each."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    costs = F.transform(words, lambda _: F.col("doc_id") % 7 + 1)
    rows = table(spark, sf_dir, "documents").where(F.size(words) > 0).select("doc_id", chunking.token_windows(costs, 100).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("atoms"), (F.array_max("w") + 1).cast("long").alias("windows"), F.size(F.filter("w", lambda x: x == 0)).cast("long").alias("first"))


# --- lines -----------------------------------------------------------------------------------------------------------

_HEADINGS = "CASE event_id % 7 WHEN 0 THEN concat('# A', event_id) WHEN 1 THEN concat('## B', event_id) WHEN 2 THEN concat('### C', event_id) ELSE concat('text #', event_id) END"
_LEVEL = "CASE WHEN event_id % 7 < 3 THEN event_id % 7 + 1 END"


def _last_heading(k: int) -> str:
    found = f"last_value(CASE WHEN level <= {k} THEN {{'l': level, 't': line}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN ({found}).l = {k} THEN ({found}).t END AS h{k}"


@query("heading_paths", f"WITH l AS (SELECT user_id, event_id, {_HEADINGS} AS line, {_LEVEL} AS level FROM events) SELECT user_id, event_id, {', '.join(map(_last_heading, (1, 2, 3)))} FROM l")
def heading_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.expr(_HEADINGS).alias("line"))
    return lines.heading_path(rows, ["user_id"]).select("user_id", F.col("pos").alias("event_id"), "h1", "h2", "h3")


@query(
    "line_gap_ranges",
    f"""WITH {LINES}, k AS (SELECT doc_id, pos, pos % 7 < 3 AS keep FROM lines), r AS (SELECT *, sum(keep::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k)
SELECT doc_id, (min(pos) + 1)::BIGINT AS first, (max(pos) + 1)::BIGINT AS last FROM r WHERE NOT keep GROUP BY doc_id, run""",
)
def line_gap_ranges(spark, sf_dir):
    rows = numbered_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", (F.col("pos") % 7 < 3).alias("keep"))
    return views.gap_ranges(rows, ["doc_id"]).select("doc_id", F.col("from").cast("long").alias("first"), F.col("to").cast("long").alias("last"))


_LINES_OF_TURNS = "l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM conversations)"


@query(
    "referenced_lines",
    f"WITH {_LINES_OF_TURNS} SELECT l.conv_id, l.turn AS output, r.turn AS at, l.n::INTEGER AS n, l.line FROM conversations r JOIN l ON l.conv_id = r.conv_id AND l.turn = r.turn - 1 AND l.n BETWEEN 1 AND 1 + r.turn % 2",
)
def referenced_lines(spark, sf_dir):
    """Each turn refers to the first lines of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    refs = turns.select("conv_id", (F.col("turn") - 1).alias("output"), F.lit(1).alias("first"), (1 + F.col("turn") % 2).cast("int").alias("last"), F.col("turn").alias("at"))
    rows = turns.select("conv_id", F.col("turn").alias("seq"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return views.expand_references(refs, rows, "conv_id").select("conv_id", "output", "at", F.col("n").cast("int").alias("n"), "line")


@query(
    "span_overlaps",
    """WITH t AS (SELECT user_id, event_id * 13 % 2000 AS s, event_id * 13 % 2000 + 1 + event_id % 90 AS e FROM events WHERE event_type <> 'click'), a AS (SELECT user_id, event_id * 7 % 2000 AS s, event_id * 7 % 2000 + 25 AS e FROM events WHERE event_type = 'click')
SELECT t.user_id, t.s AS token_s, t.e AS token_e, a.s AS atom_s, a.e AS atom_e FROM t JOIN a ON t.user_id = a.user_id AND t.s < a.e AND a.s < t.e""",
)
def span_overlaps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tokens = events.where("event_type != 'click'").selectExpr("user_id", "event_id * 13 % 2000 as s", "event_id * 13 % 2000 + 1 + event_id % 90 as e")
    atoms = events.where("event_type = 'click'").selectExpr("user_id", "event_id * 7 % 2000 as s", "event_id * 7 % 2000 + 25 as e")
    return views.overlap_join(tokens, atoms, "user_id")


@query("calls_joined", "SELECT r.conv_id, r.turn // 2 AS call_id, c.text AS call, r.text FROM conversations r LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn % 2 = 0 AND c.turn // 2 = r.turn // 2 AND c.conv_id % 3 > 0 WHERE r.turn % 2 = 1")
def calls_joined(spark, sf_dir):
    """Odd turns as results of the even ones; a third of the conversations has lost its calls."""
    turns = table(spark, sf_dir, "conversations").where("turn % 2 = 1 or conv_id % 3 > 0")
    rows = turns.select("conv_id", F.expr("turn div 2").alias("call_id"), F.expr("if(turn % 2 = 0, 'call', 'result')").alias("kind"), "text")
    return chunks.calls_with_results(rows, "conv_id", "call_id").select("conv_id", "call_id", "call", "text")


# --- usage and audit -------------------------------------------------------------------------------------------------


@query("usage_shares", "SELECT event_type, round(CASE WHEN sum(event_id % 90) + sum(user_id) > 0 THEN 100.0 * sum(event_id % 90) / (sum(event_id % 90) + sum(user_id)) END, 6) AS share FROM events GROUP BY 1")
def usage_shares(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.col("event_id") % 90).alias("saved"), F.sum("user_id").alias("new"))
    return sums.select("event_type", F.round(usage.share(F.col("saved"), F.col("new")), 6).alias("share"))


@query(
    "audit_costs",
    """WITH c AS (SELECT event_type AS component, (user_id % 5)::VARCHAR AS source, 'in' AS tag, event_id % 7 / 4.0 AS usd FROM events UNION ALL SELECT 'output', event_type, 'out', event_id % 3 / 2.0 FROM events)
SELECT component, source, tag, round(sum(usd), 6) AS usd FROM c GROUP BY 1, 2, 3""",
)
def audit_costs(spark, sf_dir):
    item = lambda a, b, c, d: F.struct(a.alias("component"), b.alias("source"), F.lit(c).alias("tag"), d.alias("usd"))
    one = item(F.col("event_type"), (F.col("user_id") % 5).cast("string"), "in", F.col("event_id") % 7 / 4)
    two = item(F.lit("output"), F.col("event_type"), "out", F.col("event_id") % 3 / 2)
    return audit.aggregate(table(spark, sf_dir, "events").select(F.array(one, two).alias("cost"))).select("component", "source", "tag", F.round("usd", 6).alias("usd"))


@query(
    "audit_sources",
    """WITH c AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'mcp__srv' || (user_id % 3) || '__' || event_type ELSE event_type END AS source, CASE WHEN user_id % 2 = 0 THEN 'tool result' ELSE 'input' END AS component, event_id % 9 / 8.0 AS usd, event_id % 100 AS tokens FROM events),
k AS (SELECT CASE WHEN starts_with(source, 'mcp__') THEN 'server' WHEN component = 'tool result' THEN 'tool' ELSE component END AS kind, CASE WHEN starts_with(source, 'mcp__') THEN split_part(source, '__', 2) ELSE source END AS name, usd, tokens FROM c)
SELECT kind, name, round(sum(usd), 6) AS usd, round(sum(usd) * 30 / 7.0, 6) AS usd_month, round(100 * sum(usd) / (SELECT sum(usd) FROM c), 6) AS percent, round(sum(tokens) / (SELECT count(*) FROM conversations), 6) AS tokens_per_request FROM k GROUP BY 1, 2""",
)
def audit_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.expr("if(user_id % 4 = 0, concat('mcp__srv', user_id % 3, '__', event_type), event_type)").alias("source"),
        F.expr("if(user_id % 2 = 0, 'tool result', 'input')").alias("component"), (F.col("event_id") % 9 / 8).alias("usd"), (F.col("event_id") % 100).alias("tokens"),
    )
    done = audit.sources(rows, 7.0, table(spark, sf_dir, "conversations"))
    return done.select("kind", "name", *(F.round(c, 6).alias(c) for c in ("usd", "usd_month", "percent", "tokens_per_request")))


@query(
    "audit_per_source",
    """WITH s AS (SELECT event_type AS source, count(*)::BIGINT AS calls, sum(event_id % 500 - event_id % 300) / 4.0 AS saved FROM events GROUP BY 1), u AS (SELECT event_type AS source, sum(user_id) AS new FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT source, calls, round(saved, 6) AS saved, round(CASE WHEN saved + new > 0 THEN 100 * saved / (saved + new) END, 6) AS share FROM s LEFT JOIN u USING (source)""",
)
def audit_per_source(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.select(F.col("event_type").alias("h"), (F.col("event_id") % 500).alias("b"), (F.col("event_id") % 300).alias("a"))
    new = events.where("event_type != 'click'").select(F.col("event_type").alias("source"), F.col("user_id").alias("new_input"))
    return audit.per_source(counts, new).select("source", "calls", F.round("saved", 6).alias("saved"), F.round("share", 6).alias("share"))


# --- sources and sinks: rows written as the files of a format, and read back -----------------------------------------


def _written(rows, value) -> str:
    """The folder of text files with one value a line."""
    path = scratch.folder(rows.sparkSession, f"lines-{uuid.uuid4().hex}")
    rows.select(value.alias("value")).write.text(path)
    return path


@query("counts_log_rows", "SELECT event_id::DOUBLE AS ts, event_type AS h, (user_id % 9)::BIGINT AS b, event_id::BIGINT AS a FROM events WHERE event_id % 10 > 0 AND event_id >= 100")
def counts_log_rows(spark, sf_dir):
    """A counts log with some lines that are no JSON."""
    line = F.expr("""if(event_id % 10 = 0, concat('{"ts": ', event_id), concat('{"ts": ', event_id, ', "h": "', event_type, '", "b": ', user_id % 9, ', "a": ', event_id, '}'))""")
    return readers.counts_log(spark, [_written(table(spark, sf_dir, "events"), line)], since=100).select("ts", "h", "b", "a")


@query("response_usage_rows", "SELECT 'responses' AS source, event_id::DOUBLE AS t, event_id + 2 * user_id AS new_input, event_id % 7 AS cache_read, user_id AS output FROM events")
def response_usage_rows(spark, sf_dir):
    """A response log in which every response stands twice, between lines without usage."""
    line = F.expr(
        """concat('{"type":"assistant","timestamp":"', event_id, '","message":{"id":"m', event_id, '","usage":{"input_tokens":', event_id, ',"cache_creation_input_tokens":', 2 * user_id, ',"cache_read_input_tokens":', event_id % 7, ',"output_tokens":', user_id, '}}}')"""
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(line, line, F.lit('{"type":"user","message":{}}'))).alias("line"))
    return readers.response_usage(spark, _written(rows, F.col("line"))).select("source", "t", "new_input", "cache_read", "output")


@query("otel_log_rows", "SELECT event_id::DOUBLE AS t, event_type AS name, event_id::VARCHAR AS id, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM events")
def otel_log_rows(spark, sf_dir):
    """Exported log records, one export a user."""
    record = F.expr(
        """concat('{"timeUnixNano":"', event_id, '000000000","body":{"stringValue":"', event_type, '"},"attributes":[{"key":"id","value":{"intValue":"', event_id, '"}},{"key":"even","value":{"boolValue":', user_id % 2 = 0, '}}]}')"""
    )
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(record), ",").alias("r"))
    body = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), "r", F.lit("]}]}]}"))
    done = readers.otel_records(rows.select(body.alias("body")))
    return done.select("t", "name", F.col("attributes")["id"].alias("id"), F.col("attributes")["even"].alias("even"))


@query(
    "notebook_cell_rows",
    """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS cell, CASE WHEN turn % 2 = 0 THEN 'code' ELSE 'markdown' END AS kind, 'x = ' || turn || chr(10) || 'y' AS source,
    CASE WHEN turn % 2 = 0 THEN 'out ' || turn || 'NameError: z' ELSE '' END AS outputs FROM conversations""",
)
def notebook_cell_rows(spark, sf_dir):
    """Conversations as notebooks: code cells with a stream and an error, text cells without outputs."""
    code = F.expr("""concat('{"cell_type":"code","source":["x = ', turn, chr(92), 'n","y"],"outputs":[{"output_type":"stream","text":["out ', turn, '"]},{"output_type":"error","ename":"NameError","evalue":"z"}]}')""")
    plain = F.expr("""concat('{"cell_type":"markdown","source":"x = ', turn, chr(92), 'ny"}')""")
    cells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, code).otherwise(plain).alias("c")))).alias("c"))
    books = cells.select("conv_id", F.concat(F.lit('{"cells":['), F.array_join(F.transform("c", lambda x: x["c"]), ","), F.lit("]}")).alias("text"))
    return readers.notebook_cells(books, "conv_id")


@query(
    "source_symbols",
    """SELECT 'm' || doc_id || '.py' AS path, 'f' || doc_id AS name, 'function' AS kind, 2 AS start, 4 AS stop, 'def f' || doc_id || '(x):' AS signature, 'About ' || doc_id || '.' AS doc FROM documents
UNION ALL SELECT 'm' || doc_id || '.py', 'C', 'class', 5, 6, 'class C:', '' FROM documents UNION ALL SELECT 'm' || doc_id || '.rs', 'go' || doc_id, 'fn', 1, 1, 'pub fn go' || doc_id || '() {', '' FROM documents""",
)
def source_symbols(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    python = docs.select(F.expr("concat('m', doc_id, '.py')").alias("path"), F.expr("""concat('import os', chr(10), 'def f', doc_id, '(x):', chr(10), '    "About ', doc_id, '."', chr(10), '    return x', chr(10), 'class C:', chr(10), '    y = 1')""").alias("text"))
    rust = docs.select(F.expr("concat('m', doc_id, '.rs')").alias("path"), F.expr("concat('pub fn go', doc_id, '() {', chr(10), '}')").alias("text"))
    return readers.symbol_table(python.unionByName(rust))


@query("text_blocks", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('plain ', event_id) ELSE concat('the longest text ', event_id) END AS text FROM events")
def text_blocks(spark, sf_dir):
    response = F.expr(
        """CASE event_id % 3 WHEN 0 THEN concat('plain ', event_id) WHEN 1 THEN concat('[{"type":"text","text":"short"},{"type":"image"},{"type":"text","text":"the longest text ', event_id, '"}]')
        ELSE concat('{"content":[{"type":"text","text":"the longest text ', event_id, '"},{"type":"text","text":"x"}]}') END"""
    )
    return table(spark, sf_dir, "events").select("event_id", readers.largest_text_block(response).alias("text"))


@query(
    "capped_outputs",
    """WITH a AS (SELECT event_id, list_transform(range(1, event_id % 40 + 2), lambda i: concat('line ', i)) AS a FROM events)
SELECT event_id, array_to_string(CASE WHEN len(a) > 12 THEN list_concat(list_concat(a[1:8], [concat('[… ', len(a) - 12, ' lines omitted …]')]), a[len(a) - 3:len(a)]) ELSE a END, chr(10)) AS text FROM a""",
)
def capped_outputs(spark, sf_dir):
    text = F.expr("array_join(transform(sequence(1, cast(event_id % 40 as int) + 1), i -> concat('line ', i)), chr(10))")
    return table(spark, sf_dir, "events").select("event_id", readers.cap_lines(text).alias("text"))


@query("imported_rows", "SELECT event_id AS k, event_type AS v FROM events")
def imported_rows(spark, sf_dir):
    """JSONL in which every key stands twice."""
    line = F.expr("""concat('{"k": ', event_id, ', "v": "', event_type, '"}')""")
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(line, line)).alias("line"))
    return sinks.import_lines(spark, _written(rows, F.col("line")), "k bigint, v string", "k")


@query("kept_first_writes", "SELECT user_id AS key, min(event_id) AS seq, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM events GROUP BY user_id")
def kept_first_writes(spark, sf_dir):
    """Half of the keys are stored already; the rest keep their first event."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    store = rows.where("key % 2 = 0").groupBy("key").agg(F.min("seq").alias("seq")).withColumn("state", F.lit("old"))
    return sinks.first_writes(rows.withColumn("state", F.lit("new")), store, "key", "seq").select("key", "seq", "state")


@query("unexpired_rows", "SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 >= (SELECT max(epoch_us(ts)) / 1e6 FROM events) - 604800")
def unexpired_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seen"))
    return sinks.expire(rows, "seen", rows.agg(F.max("seen")).first()[0] or 0.0).select("event_id")


@query("shared_numbers", """SELECT concat('{"user_id":', user_id, ',"n":', count(*), ',"even":', user_id % 2 = 0, '}') AS blob FROM events GROUP BY user_id""")
def shared_numbers(spark, sf_dir):
    """Reports hold numbers and no texts."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.first("event_type").alias("text"))
    return sinks.share_blob(rows.select("user_id", "n", "text", (F.col("user_id") % 2 == 0).alias("even")))


# --- transcripts and tool events ---------------------------------------------------------------------------------------


@query(
    "transcript_entries",
    """SELECT conv_id, turn, conv_id || ':' || turn AS uuid, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent, (turn % 3 + 1)::INTEGER AS blocks, event % 2 = 1 AS cleared
FROM (SELECT *, turn % 4 AS event FROM conversations)""",
)
def transcript_entries(spark, sf_dir):
    """Conversations as transcript lines; every other entry says in one of two ways that results were cleared."""
    line = F.expr(
        """concat('{"uuid":"', conv_id, ':', turn, '",', if(turn > 0, concat('"parentUuid":"', conv_id, ':', turn - 1, '",'), ''), '"type":"', if(turn % 4 = 3, 'system', 'assistant'), '",', if(turn % 4 = 3, '"subtype":"microcompact_boundary",', ''),
        '"message":{"content":[', array_join(transform(sequence(0, cast(turn % 3 as int)), i -> concat('{"text":"', i, '"}')), ','), ']', if(turn % 4 = 1, ',"context_management":{"applied_edits":[{"type":"clear_tool_uses_x","cleared_tool_uses":2}]}', ''), '}}')"""
    )
    rows = transcripts.entries(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value")))
    return rows.select("conv_id", "turn", "entry.uuid", F.col("entry.parentUuid").alias("parent"), "blocks", transcripts.cleared(F.col("entry")).alias("cleared"))


@query(
    "context_epochs",
    """WITH r AS (SELECT conv_id, turn, conv_id || ':' || turn AS uuid, CASE WHEN turn % 5 = 4 THEN conv_id || ':' || (turn - 3) WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent, turn // 2 AS t, CASE WHEN turn % 3 = 0 THEN (turn % 4) * 5000 END AS prompt, turn % 7 = 6 AS cleared FROM conversations),
p AS (SELECT *, lag(uuid) OVER w AS before, lag(t) OVER w AS turn_before, last_value(prompt IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT p.*, coalesce(p.parent <> p.before AND q.t IS DISTINCT FROM p.turn_before, false) AS rewound, coalesce(p.last - p.prompt > greatest(2000, p.last * 0.05), false) AS shrunk FROM p LEFT JOIN r q ON q.conv_id = p.conv_id AND q.uuid = p.parent)
SELECT conv_id, turn, rewound, shrunk, sum((rewound OR shrunk OR cleared)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS epoch FROM m""",
)
def context_epochs(spark, sf_dir):
    """Conversations that go back now and then, lose part of their prompt, and are cleared."""
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "concat(conv_id, ':', turn) as uuid", "case when turn % 5 = 4 then concat(conv_id, ':', turn - 3) when turn > 0 then concat(conv_id, ':', turn - 1) end as parent",
        "case when turn % 3 = 0 then (turn % 4) * 5000 end as prompt", "turn % 7 = 6 as cleared",
    )
    named = rows.withColumn("seq", F.col("turn")).withColumn("turn", F.expr("turn div 2"))
    return transcripts.resets(named, "conv_id", "seq").select("conv_id", F.col("seq").alias("turn"), "rewound", "shrunk", "epoch")


@query(
    "event_targets",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'bash' WHEN 1 THEN 'grep' WHEN 2 THEN 'mcp' WHEN 3 THEN 'bash_persisted' END AS kind, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 'out ' || event_id WHEN event_id % 7 = 3 THEN 'head' END AS text,
    CASE event_id % 7 WHEN 0 THEN 'ls ' || user_id WHEN 1 THEN 'grep x src' WHEN 2 THEN 'mcp__s__t' WHEN 3 THEN 'cat f' END AS command FROM events""",
)
def event_targets(spark, sf_dir):
    """Tool events of seven kinds, of which four may be shortened."""
    event = F.expr(
        """CASE event_id % 7 WHEN 0 THEN concat('{"tool_name":"Bash","tool_input":{"command":"ls ', user_id, '"},"tool_response":{"stdout":"out ', event_id, '"}}')
        WHEN 1 THEN concat('{"tool_name":"Grep","tool_input":{"pattern":"x","path":"src"},"tool_response":{"mode":"content","content":"out ', event_id, '"}}')
        WHEN 2 THEN concat('{"tool_name":"mcp__s__t","tool_response":[{"type":"text","text":"out ', event_id, '"}]}')
        WHEN 3 THEN '{"tool_name":"Bash","tool_input":{"command":"cat f"},"tool_response":{"stdout":"head","persistedOutputPath":"/x"}}'
        WHEN 4 THEN '{"tool_name":"Bash","tool_input":{"command":"cat f"},"tool_response":{"stdout":"x","isImage":true}}'
        WHEN 5 THEN '{"tool_name":"Grep","tool_response":{"mode":"count","content":"7"}}' ELSE '{"tool_name":"Bash","tool_response":{"stdout":""}}' END"""
    )
    return table(spark, sf_dir, "events").select("event_id", transcripts.event_target(event).alias("t")).select("event_id", "t.kind", "t.text", "t.command")


@query(
    "ranked_symbols",
    """WITH s AS (SELECT event_id, event_type || '_' || event_id % 50 AS name, 'def ' || event_type || '(' || repeat('user ', event_id % 4) || ')' AS signature, CASE WHEN event_id % 3 = 0 THEN 'Purchase of a user' ELSE '' END AS doc FROM events),
t AS (SELECT event_id, name, regexp_extract_all(lower(name || ' ' || signature || ' ' || doc), '[a-z0-9_]+') AS w, regexp_extract_all(lower(name), '[a-z0-9_]+') AS nw FROM s),
c AS (SELECT *, len(list_filter(w, lambda x: x = 'user')) AS a, len(list_filter(w, lambda x: x = 'purchase')) AS b, len(list_filter(w, lambda x: x = 'click_7')) AS c FROM t),
d AS (SELECT count(*) AS n, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM c)
SELECT event_id, round(CASE WHEN a > 0 THEN (1 + ln(a)) * ln(1 + (n - da + 0.5) / (da + 0.5)) ELSE 0 END + CASE WHEN b > 0 THEN (1 + ln(b)) * ln(1 + (n - db + 0.5) / (db + 0.5)) ELSE 0 END
    + CASE WHEN c > 0 THEN (1 + ln(c)) * ln(1 + (n - dc + 0.5) / (dc + 0.5)) ELSE 0 END + CASE WHEN list_has_any(nw, ['user', 'purchase', 'click_7']) THEN 2 ELSE 0 END, 4) AS score FROM c, d""",
)
def ranked_symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(event_type, '_', event_id % 50) as name", "concat('def ', event_type, '(', repeat('user ', cast(event_id % 4 as int)), ')') as signature", "if(event_id % 3 = 0, 'Purchase of a user', '') as doc"
    )
    return retrieval.rank_symbols(rows, "user purchase click_7").select("event_id", F.round("score", 4).alias("score"))


@query("listed_transcripts", "SELECT DISTINCT 'user_id=' || user_id AS folder FROM events WHERE user_id % 10 > 0")
def listed_transcripts(spark, sf_dir):
    """Transcript files in a folder for each user, without the excluded ones."""
    path = scratch.folder(spark, f"listed-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("value"))
    rows.repartition("user_id").write.partitionBy("user_id").text(path)
    found = transcripts.stream_files(spark, path, exclude=("%user\\_id=%0/%",), glob="*.txt")
    return found.select(F.regexp_extract("path", "(user_id=[0-9]+)/", 1).alias("folder")).distinct()
