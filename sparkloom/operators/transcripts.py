"""Session transcripts and tool events: entries, resets of the visible context, targets of a treatment, files.

Everything is a column expression or a window by session; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Field names of the public transcript and event formats.
ENTRY = (
    "uuid string, parentUuid string, type string, subtype string, timestamp string, "
    "message struct<id:string,role:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,context_management:struct<applied_edits:array<struct<type:string,cleared_tool_uses:bigint>>>>, "
    "replacements array<struct<kind:string>>"
)
EVENT = "tool_name string, tool_input struct<command:string,pattern:string,path:string>, tool_response string"
RESPONSE = "mode string, content string, stdout string, isImage boolean, persistedOutputPath string"
SHELLS = ("Bash", "PowerShell")


def transcript_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New lines of transcript files as a stream: the file source and its checkpoint keep what has been read,
    so there are no offsets to store.  A file has to be complete when it appears, as rotated parts are."""
    return entries(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def stream_files(spark: SparkSession, root: str, modified_after: str | None = None, exclude: tuple[str, ...] = (), glob: str = "*.jsonl") -> DataFrame:
    """(path, length, modified) of the files below a folder that match a glob, are young enough and match no
    LIKE pattern of `exclude`; listed by the file source, contents unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    for pattern in exclude:
        files = files.where(~F.col("path").like(pattern))
    return files


def entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with entry (ENTRY), blocks (its content items), tokens (characters / 4 of its content); lines that
    are no JSON object have a null entry."""
    rows = lines.withColumn("entry", F.from_json(value, ENTRY))
    rows = rows.withColumn("entry", F.when(F.col(value).rlike(r"^\s*\{"), F.col("entry")))
    content = F.col("entry.message.content")
    listed = F.size(F.from_json(content, "array<string>"))
    return rows.withColumn("blocks", F.when(content.rlike(r"^\s*\["), listed).when(content.isNotNull(), 1).otherwise(0)).withColumn("tokens", F.ceil(F.coalesce(F.length(content), F.lit(0)) / 4).cast("long"))


def cleared(entry: Column) -> Column:
    """Does an entry say that tool results which the session has seen were taken out of its context?"""
    replaced = (entry["type"] == "content-replacement") & F.exists(entry["replacements"], lambda r: F.coalesce(r["kind"], F.lit("tool-result")) == "tool-result")
    compacted = (entry["type"] == "system") & (entry["subtype"] == "microcompact_boundary")
    edits = F.exists(entry["message"]["context_management"]["applied_edits"], lambda e: e["type"].startswith("clear_tool_uses") & (e["cleared_tool_uses"] > 0))
    return F.coalesce(replaced, F.lit(False)) | F.coalesce(compacted, F.lit(False)) | F.coalesce((entry["type"] == "assistant") & edits, F.lit(False))


def resets(rows: DataFrame, session: str, seq: str, shrink: int = 2000) -> DataFrame:
    """rows (uuid, parent, turn, prompt, cleared) with rewound, shrunk and epoch.

    An entry is rewound if its parent is neither the entry before nor of the same turn as that; shrunk if
    its prompt is over `shrink` tokens and 5 % smaller than the last one.  Each rewind, shrink or clear starts
    a new epoch: what a session saw in an earlier one is no longer in its context.
    """
    w = Window.partitionBy(session).orderBy(seq)
    known = rows.select(F.col(session).alias("_s"), F.col("uuid").alias("_u"), F.col("turn").alias("_of")).dropDuplicates(["_s", "_u"])
    linked = rows.join(known, (F.col(session) == F.col("_s")) & (F.col("parent") == F.col("_u")), "left").drop("_s", "_u")
    before, turn = F.lag("uuid").over(w), F.lag("turn").over(w)
    rewound = F.coalesce((F.col("parent") != before) & ~F.col("_of").eqNullSafe(turn), F.lit(False))
    last = F.last("prompt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    shrunk = F.coalesce(last - F.col("prompt") > F.greatest(F.lit(shrink), last * 0.05), F.lit(False))
    out = linked.withColumn("rewound", rewound).withColumn("shrunk", shrunk).drop("_of")
    new = (F.col("rewound") | F.col("shrunk") | F.coalesce("cleared", F.lit(False))).cast("long")
    return out.withColumn("epoch", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def event_target(event: Column, largest_text=None) -> Column:
    """struct(kind, field, text, command) of a tool event that may be shortened, null for all others: the text of a
    server tool, the content of a search, the output of a shell (persisted or not); images and empty outputs are none."""
    from sparkloom.sources.readers import largest_text_block

    e = F.from_json(event, EVENT)
    name, raw = e["tool_name"], e["tool_response"]
    r = F.from_json(raw, RESPONSE)
    whole = F.coalesce(raw.rlike(r"^\s*\{"), F.lit(False))
    made = lambda kind, field, text, command: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text.alias("text"), command.alias("command"))
    server = (largest_text or largest_text_block)(raw)
    search = F.concat_ws(" ", F.lit("grep"), e["tool_input"]["pattern"], e["tool_input"]["path"])
    shell = name.isin(*SHELLS) & whole & ~F.coalesce(r["isImage"], F.lit(False))
    command = F.coalesce(e["tool_input"]["command"], F.lit(""))
    return (
        F.when(name.startswith("mcp__") & (F.length(server) > 0), made("mcp", "text", server, name))
        .when((name == "Grep") & whole & (r["mode"] == "content") & (F.length(r["content"]) > 0), made("grep", "content", r["content"], search))
        .when(shell & r["persistedOutputPath"].isNotNull(), made("bash_persisted", "stdout", F.coalesce(r["stdout"], F.lit("")), command))
        .when(shell & (F.length(r["stdout"]) > 0), made("bash", "stdout", r["stdout"], command))
    )
