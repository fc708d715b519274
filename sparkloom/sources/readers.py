"""Readers of agent logs, request bodies, notebooks and source code."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.text import parse_time


def json_lines(spark: SparkSession, path, schema: str, needle: str = "", modified_after: str | None = None) -> DataFrame:
    """Rows of JSONL files: files and lines are filtered before anything is parsed; a line that is no
    JSON has nulls and its text in _corrupt."""
    reader = spark.read.option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(path).select("value", F.input_file_name().alias("_file"))
    if needle:
        lines = lines.where(F.col("value").contains(needle))
    full = StructType.fromDDL(schema).add("_corrupt", "string")
    return lines.select("_file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("_file", "r.*")


COUNTS = "ts double, h string, t string, b bigint, a bigint, d bigint, s string, v string"
_RESPONSE = "type string, timestamp string, message struct<id:string,usage:struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint>,content:array<struct<type:string,name:string>>>"
_TOTALS = "timestamp string, type string, payload struct<type:string,model_provider:string,info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>,total_token_usage:struct<input_tokens:bigint>>>"
_MESSAGE = "type string, timestamp string, provider string, message struct<role:string,provider:string,usage:struct<input:bigint,cacheRead:bigint,cacheWrite:bigint,output:bigint>>"
USAGE = ("source", "file", "t", "new_input", "cache_read", "output")


def counts_log(spark: SparkSession, paths: list[str], since: float = 0.0) -> DataFrame:
    """The counts log and its rotated part, rows of `since` or later; bad lines are left out."""
    return json_lines(spark, paths, COUNTS).where(F.col("_corrupt").isNull() & (F.col("ts") >= since)).drop("_corrupt", "_file")


def response_usage(spark: SparkSession, path, since: float = 0.0) -> DataFrame:
    """One row per response id (a response is logged once for each of its parts)."""
    rows = json_lines(spark, path, _RESPONSE, '"usage"').where("message.usage is not null").withColumn("t", parse_time("timestamp")).where(F.col("t") >= since)
    once = rows.withColumn("_id", F.coalesce("message.id", F.monotonically_increasing_id().cast("string"))).dropDuplicates(["_id"])
    u = F.col("message.usage")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return once.select(F.lit("responses").alias("source"), F.col("_file").alias("file"), "t", (zero(u["input_tokens"]) + zero(u["cache_creation_input_tokens"])).alias("new_input"), zero(u["cache_read_input_tokens"]).alias("cache_read"), zero(u["output_tokens"]).alias("output"))


def total_usage(spark: SparkSession, path, since: float = 0.0) -> DataFrame:
    """Token-count events; one that repeats the total before it is no request."""
    rows = json_lines(spark, path, _TOTALS, "token_count").where("payload.info is not null").withColumn("t", parse_time("timestamp"))
    total = F.col("payload.info.total_token_usage.input_tokens")
    rows = rows.withColumn("_total", total).withColumn("_before", F.lag("_total").over(Window.partitionBy("_file").orderBy("t", "_total")))
    rows = rows.where((F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_total"))) & (F.col("t") >= since))
    u = F.col("payload.info.last_token_usage")
    cached = F.coalesce(u["cached_input_tokens"], F.lit(0).cast("long"))
    return rows.select(F.lit("totals").alias("source"), F.col("_file").alias("file"), "t", (F.coalesce(u["input_tokens"], F.lit(0).cast("long")) - cached).alias("new_input"), cached.alias("cache_read"), F.coalesce(u["output_tokens"], F.lit(0).cast("long")).alias("output"))


def message_usage(spark: SparkSession, path, since: float = 0.0) -> DataFrame:
    rows = json_lines(spark, path, _MESSAGE, '"usage"').where("message.usage is not null").withColumn("t", parse_time("timestamp")).where(F.col("t") >= since)
    u = F.col("message.usage")
    zero = lambda c: F.coalesce(u[c], F.lit(0).cast("long"))
    return rows.select(F.lit("messages").alias("source"), F.col("_file").alias("file"), "t", (zero("input") + zero("cacheWrite")).alias("new_input"), zero("cacheRead").alias("cache_read"), zero("output").alias("output"))


def all_usage(spark: SparkSession, paths: dict[str, str], since: float = 0.0) -> DataFrame:
    """The readers named in paths, as one table."""
    readers = {"responses": response_usage, "totals": total_usage, "messages": message_usage}
    parts = [readers[k](spark, p, since) for k, p in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_CHAT = "messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
_RESPONSES = "input array<struct<type:string,role:string,content:string,call_id:string,name:string,arguments:string,output:string>>"
_MESSAGES = "messages array<struct<role:string,content:array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>>>"


def request_calls(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, pos, call_id, kind, name, text): calls and results of request bodies in three formats."""
    chat = bodies.select(key, F.posexplode(F.from_json(body, _CHAT)["messages"]).alias("pos", "m"))
    calls = chat.select(key, "pos", F.explode("m.tool_calls").alias("c")).select(key, "pos", F.col("c.id").alias("call_id"), F.lit("call").alias("kind"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("text"))
    results = chat.where("m.role = 'tool'").select(key, "pos", F.col("m.tool_call_id").alias("call_id"), F.lit("result").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("m.content").alias("text"))
    items = bodies.select(key, F.posexplode(F.from_json(body, _RESPONSES)["input"]).alias("pos", "m")).where("m.type in ('function_call', 'function_call_output')")
    call = F.col("m.type") == "function_call"
    flat = items.select(key, "pos", F.col("m.call_id").alias("call_id"), F.when(call, "call").otherwise("result").alias("kind"), "m.name", F.when(call, F.col("m.arguments")).otherwise(F.col("m.output")).alias("text"))
    blocks = bodies.select(key, F.posexplode(F.from_json(body, _MESSAGES)["messages"]).alias("pos", "m")).select(key, "pos", F.explode("m.content").alias("b")).where("b.type in ('tool_use', 'tool_result')")
    use = F.col("b.type") == "tool_use"
    nested = blocks.select(key, "pos", F.when(use, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("call_id"), F.when(use, "call").otherwise("result").alias("kind"), "b.name", F.when(use, F.col("b.input")).otherwise(F.col("b.content")).alias("text"))
    return calls.unionByName(results).unionByName(flat).unionByName(nested)


def largest_text_block(response: Column) -> Column:
    """The longest text of a tool response: a string, a list of blocks, or blocks under `content`."""
    blocks = "array<struct<type:string,text:string>>"
    listed = F.when(response.rlike(r"^\s*\{"), F.from_json(response, f"content {blocks}")["content"]).otherwise(F.from_json(response, blocks))
    texts = F.transform(F.filter(listed, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: F.struct(F.length(b["text"]).alias("n"), b["text"].alias("text")))
    return F.coalesce(F.array_max(texts)["text"], F.when(~response.rlike(r"^\s*[\[{]"), response))


_CELLS = "cells array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,text:string,data:map<string,string>,ename:string,evalue:string>>>>"


def _joined(c: Column) -> Column:
    return F.coalesce(F.array_join(F.from_json(c, "array<string>"), ""), c, F.lit(""))


def cap_lines(c: Column, lines: int = 12, chars: int = 2000) -> Column:
    """Two thirds of the lines from the head and one third from the tail."""
    a = F.split(F.substring(c, 1, chars), "\n", -1)
    head = lines * 2 // 3
    gap = F.concat(F.lit("[… "), (F.size(a) - lines).cast("string"), F.lit(" lines omitted …]"))
    cut = F.concat(F.slice(a, 1, head), F.array(gap), F.slice(a, F.size(a) - (lines - head) + 1, lines - head))
    return F.when(F.size(a) > lines, F.array_join(cut, "\n")).otherwise(F.array_join(a, "\n"))


def notebook_cells(notebooks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, cell, kind, source, outputs): cells in order, their text outputs joined and capped."""
    rows = notebooks.select(key, F.posexplode(F.from_json(text, _CELLS)["cells"]).alias("cell", "c"))

    def shown(o):
        error = F.concat_ws(": ", o["ename"], o["evalue"])
        return F.when(o["output_type"] == "error", error).when(o["output_type"] == "stream", _joined(o["text"])).otherwise(_joined(o["data"]["text/plain"]))

    outputs = F.array_join(F.transform(F.coalesce(F.col("c.outputs"), F.array()), shown), "")
    return rows.select(key, "cell", F.col("c.cell_type").alias("kind"), _joined(F.col("c.source")).alias("source"), cap_lines(outputs).alias("outputs"))


def notebook_text(notebooks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): a notebook as percent-format text with its outputs as comments."""
    cells = notebook_cells(notebooks, key, text)
    head = F.when(F.col("kind") == "code", "# %%\n").otherwise(F.concat(F.lit("# %% ["), F.col("kind"), F.lit("]\n")))
    body = F.concat(head, F.col("source"), F.when(F.col("outputs") != "", F.concat(F.lit("\n# out: "), F.regexp_replace("outputs", "\n", "\n# "))).otherwise(""))
    return cells.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", body.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


_DECLARATION = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|static\s+|async\s+|pub\s+)*(function|class|interface|struct|enum|trait|impl|fn|func|def)\s+([A-Za-z_]\w*)")


def symbols(source: str, path: str) -> list[dict]:
    """Declarations of a source file: Python by its syntax tree, other languages line by line."""
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        lines = source.split("\n")
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        return [
            {"name": n.name, "kind": kinds[type(n)], "start": n.lineno, "stop": n.end_lineno, "signature": lines[n.lineno - 1].strip(), "doc": ((ast.get_docstring(n) or "").split("\n") or [""])[0]}
            for n in ast.walk(tree)
            if type(n) in kinds
        ]
    found = [(i, _DECLARATION.match(x), x) for i, x in enumerate(source.split("\n"), 1)]
    return [{"name": m[2], "kind": m[1], "start": i, "stop": i, "signature": x.strip(), "doc": ""} for i, m, x in found if m]


def symbol_table(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per declaration of each file."""

    @F.pandas_udf("array<struct<name:string,kind:string,start:int,stop:int,signature:string,doc:string>>")
    def go(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([symbols(t or "", p or "") for p, t in zip(paths, texts, strict=True)])

    return files.select(path, F.explode(go(F.col(path), F.col(text))).alias("s")).select(path, "s.*")


def otel_records(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(t, name, attributes) of log records in exported resource logs."""
    value = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
    schema = f"resourceLogs array<struct<scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,body:{value},attributes:array<struct<key:string,value:{value}>>>>>>>>"
    rows = bodies.select(F.explode(F.from_json(body, schema)["resourceLogs"]).alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("l"))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    pairs = F.map_from_entries(F.transform("l.attributes", lambda a: F.struct(a["key"], text(a["value"]))))
    return rows.select((F.col("l.timeUnixNano").cast("double") / 1e9).alias("t"), text(F.col("l.body")).alias("name"), pairs.alias("attributes"))


def parent_chain(entries: DataFrame, key: str = "uuid", parent: str = "parent", rounds: int = 40) -> DataFrame:
    """entries with root and depth: the parent links followed by doubling, so a chain of n takes log2(n) joins."""
    from sparkloom.sources.scratch import table

    # up: the ancestor `d` steps above (null once the root is passed).
    state = table(entries.select(key, F.col(parent).alias("up"), F.when(F.col(parent).isNull(), F.lit(0)).otherwise(1).alias("d"), F.coalesce(parent, key).alias("root")))
    for _ in range(rounds):
        far = state.select(F.col(key).alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"), F.col("root").alias("_root"))
        new = state.join(far, "up", "left").select(
            key, F.col("_up").alias("up"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.coalesce("_root", "root").alias("root")
        )
        state = table(new)
        if not state.where("up is not null").limit(1).count():
            break
    return entries.join(state.select(key, "root", F.col("d").alias("depth")), key)


def request_body_kind(body: str) -> str:
    """chat, responses or messages: which wire format a request body has."""
    x = json.loads(body)
    if "input" in x:
        return "responses"
    return "messages" if any(isinstance(m.get("content"), list) for m in x.get("messages", ())) else "chat"
