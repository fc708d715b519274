import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.operators import chunks, retrieval
from sparkloom.sources import readers
from sparkloom.streaming import sessions as streams


def write(folder, name, rows):
    Path(folder, name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))


def test_usage_readers(spark, tmp_path):
    one = {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": "m1", "usage": {"input_tokens": 5, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 7, "output_tokens": 1}}}
    (tmp_path / "r").mkdir()
    write(tmp_path / "r", "a.jsonl", [one, one, "no json with \"usage\"", {**one, "timestamp": "2020-01-01T00:00:00Z", "message": {**one["message"], "id": "m0"}}])
    rows = readers.response_usage(spark, str(tmp_path / "r"), 1.7e9).collect()
    assert [(r.new_input, r.cache_read, r.output) for r in rows] == [(7, 7, 1)]
    event = lambda t, total: {"timestamp": t, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "cached_input_tokens": 4, "output_tokens": 2}, "total_token_usage": {"input_tokens": total}}}}
    (tmp_path / "t").mkdir()
    write(tmp_path / "t", "a.jsonl", [event("2024-01-01T00:00:00Z", 9), event("2024-01-01T00:00:01Z", 9), event("2024-01-01T00:00:02Z", 18), {"type": "x", "payload": {"type": "token_count", "info": None}}])
    both = readers.all_usage(spark, {"responses": str(tmp_path / "r"), "totals": str(tmp_path / "t")}, 1.7e9)
    assert {r.source: r.n for r in both.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"responses": 1, "totals": 2}


def test_counts_log(spark, tmp_path):
    write(tmp_path, "c.jsonl.1", [{"ts": 1.0, "h": "x", "b": 3}, "bad"])
    write(tmp_path, "c.jsonl", [{"ts": 5.0, "h": "y", "b": 4}])
    rows = readers.counts_log(spark, [str(tmp_path / "c.jsonl.1"), str(tmp_path / "c.jsonl")], 2.0).collect()
    assert [(r.h, r.b) for r in rows] == [("y", 4)]


def test_request_bodies(spark):
    bodies = [
        {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c1", "content": "out"}]},
        {"input": [{"type": "function_call", "call_id": "c2", "name": "g", "arguments": "{}"}, {"type": "function_call_output", "call_id": "c2", "output": "res"}]},
        {"messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "c3", "name": "h", "input": {"a": 1}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c3", "content": "done"}]}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "k int, body string")
    calls = readers.request_calls(df, "k")
    joined = {r.k: (r.call, r.text) for r in chunks.calls_with_results(calls, "k", "call_id").collect()}
    assert joined == {0: ("{}", "out"), 1: ("{}", "res"), 2: ('{"a":1}', "done")}
    assert [readers.request_body_kind(json.dumps(b)) for b in bodies] == ["chat", "responses", "messages"]


def test_largest_block(spark):
    rows = ["plain", json.dumps([{"type": "text", "text": "a"}, {"type": "text", "text": "long"}]), json.dumps({"content": [{"type": "text", "text": "x"}]})]
    df = spark.createDataFrame([(r,) for r in rows], "r string").select(readers.largest_text_block(F.col("r")).alias("t"))
    assert [r.t for r in df.collect()] == ["plain", "long", "x"]


def test_notebook(spark):
    nb = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "print(1)", "outputs": [{"output_type": "stream", "text": ["1\n"]}, {"output_type": "error", "ename": "E", "evalue": "v"}]}]}
    df = spark.createDataFrame([(1, json.dumps(nb))], "k int, text string")
    assert readers.notebook_text(df, "k").first().text == "# %% [markdown]\n# T\nx\n\n# %%\nprint(1)\n# out: 1\n# E: v"


def test_symbols(spark):
    df = spark.createDataFrame([("a.py", 'class A:\n    """D."""\n    def f(self):\n        pass\n'), ("b.ts", "export function g() {}\n"), ("c.py", "def (")], "path string, text string")
    assert {(r.path, r.name, r.kind, r.start) for r in readers.symbol_table(df).collect()} == {("a.py", "A", "class", 1), ("a.py", "f", "function", 3), ("b.ts", "g", "function", 1)}


def test_otel(spark):
    body = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "body": {"stringValue": "n"}, "attributes": [{"key": "k", "value": {"intValue": "3"}}]}]}]}]}
    r = readers.otel_records(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    assert (r.t, r.name, r.attributes) == (1.7e9, "n", {"k": "3"})


def test_parent_chain(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", None), ("y", "x"), ("o", "gone")]
    got = {r.uuid: (r.root, r.depth) for r in readers.parent_chain(spark.createDataFrame(rows, "uuid string, parent string")).collect()}
    assert got["e"] == ("a", 4) and got["y"] == ("x", 1) and got["a"] == ("a", 0) and got["o"] == ("gone", 1)


def run_stream(spark, df, path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_dedup_stream_equals_batch(spark, tmp_path):
    from sparkloom.operators import sessions

    block = "\n".join(f"line number {i} of the output" for i in range(5))
    turns = [("s", 1, "a first\n" + block), ("s", 2, "b second\n" + block), ("t", 1, block), ("s", 3, block)]
    source = tmp_path / "in"
    schema = "session string, seq int, text string"
    for k, part in enumerate((turns[:2], turns[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
    batch = {(r.session, r.seq): r.shown for r in sessions.dedup_sessions(spark.createDataFrame(turns, schema), "session", "seq").collect()}
    stream = spark.readStream.schema(schema).json(str(source))
    got = {(r.session, r.seq): r.shown for r in run_stream(spark, streams.dedup_stream(stream), str(tmp_path / "c1"), "dedup_stream")}
    assert got == batch
    held = run_stream(spark, streams.guard_stream(stream.withColumn("key", F.lit("k"))), str(tmp_path / "c2"), "guard_stream")
    assert sum(r.held for r in held) == 2


def test_windows_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    with tempfile.TemporaryDirectory() as folder:
        spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(f"{folder}/e")
        events = spark.readStream.schema(schema).parquet(f"{folder}/e")
        rows = run_stream(spark, streams.windowed_counts(events, "ts", "event_type", "value"), str(tmp_path / "c3"), "windows_stream")
    assert rows and all(r.n > 0 for r in rows)


def test_containment_and_allocation(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "nothing here at all"), (3, "the quick brown fox")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "the quick brown fox")], "item_id int, text string")
    assert {(r.doc_id, r.item_id) for r in retrieval.containment(docs, items, "doc_id", "item_id").collect()} == {(1, 7), (3, 7)}
    rows = spark.createDataFrame([("g", 100.0, 1.0), ("g", 10.0, 5.0), ("g", 0.0, 2.0)], "g string, n double, s double")
    rates = {r.n: r.rate for r in retrieval.allocate(rows, "g", "n", "s", 0.5).collect()}
    assert rates[10.0] == 1.0 and abs(rates[100.0] * 100 + 10 - 55) < 1e-6 and rates[0.0] == 0.0
