import json

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking, retrieval, transcripts, usage


def test_transcripts_as_a_stream(spark, tmp_path):
    """New files are read once; the checkpoint keeps what was read."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def run():
        stream = transcripts.transcript_stream(spark, source).select("entry.uuid", "blocks")
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.uuid or "", r.blocks) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"uuid": "1", "message": {"content": [{"text": "x"}, {"text": "y"}]}}) + "\nno json\n")
    assert run() == [("", 0), ("1", 2)]
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({"uuid": "2", "message": {"content": "text"}}) + "\n")
    assert run() == [("", 0), ("1", 2), ("2", 1)]


def test_odd_events_are_no_targets(spark):
    events = [None, "", "[]", "no json", "{}", '{"tool_name": "Bash"}', '{"tool_name": "Bash", "tool_response": "text"}', '{"tool_name": "mcp__s__t", "tool_response": {}}']
    rows = spark.createDataFrame([(e,) for e in events], "e string").select(transcripts.event_target(F.col("e")).alias("t"))
    assert [r.t for r in rows.collect()] == [None] * len(events)


def test_clears(spark):
    entries = [
        ({"type": "content-replacement", "replacements": [{"kind": "tool-result"}]}, True), ({"type": "content-replacement", "replacements": [{}]}, True), ({"type": "content-replacement", "replacements": [{"kind": "other"}]}, False),
        ({"type": "system", "subtype": "microcompact_boundary"}, True), ({"type": "system"}, False), ({"type": "assistant"}, False), ({"type": "assistant", "message": {"context_management": {"applied_edits": [{"type": "clear_tool_uses_1", "cleared_tool_uses": 0}]}}}, False),
    ]
    rows = transcripts.entries(spark.createDataFrame([(json.dumps(e),) for e, _ in entries], "value string"))
    assert [r.c for r in rows.select(transcripts.cleared(F.col("entry")).alias("c")).collect()] == [c for _, c in entries]


def test_text_functions_of_transcripts(spark):
    rows = spark.createDataFrame([("a  b\n\nc d\ne",), ("",), (None,)], "t string").withColumn("a", T.atoms("t"))
    kept = rows.select(T.detok(F.col("a"), F.transform("a", lambda x: x["text"].isin("a", "d", "e"))).alias("x")).collect()
    assert [r.x for r in kept] == ["a\n\nd\ne", "", None]
    costs = spark.createDataFrame([([300, 300, 600, 100, 100],), ([],), (None,)], "c array<int>")
    assert [r[0] for r in costs.select(chunking.token_windows(F.col("c"))).collect()] == [[0, 1, 2, 3, 3], [], None]
    symbols = spark.createDataFrame([("load_file", "def load_file(path)", "Load it."), ("other", "def other()", ""), (None, None, None)], "name string, signature string, doc string")
    assert [r.score > 2 for r in retrieval.rank_symbols(symbols, "load_file").collect()] == [True, False, False]
    assert {r.score for r in retrieval.rank_symbols(symbols, "").collect()} == {0.0}


def test_outliers_have_the_exact_median(spark):
    rows = [("a", float(i)) for i in range(1001)] + [("b", float(i % 2)) for i in range(10)] + [("b", None), (None, 1.0), (None, 100.0), (None, 1.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v, r.median) for r in usage.outliers(df, "g", "v").collect()}
    assert got == {("a", float(i), 500.0) for i in range(63)} | {("b", 0.0, 0.5)} | {(None, 100.0, 1.0)}
