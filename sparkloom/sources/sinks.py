"""Sinks: counts, first writes, line index, shared reports, replaced fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest line of the index, and the largest text that is indexed.
LINE_CHARS, TEXT_BYTES = 400, 64 << 20


def append_counts(rows: DataFrame, path: str) -> None:
    """Counts only, never texts: (ts, h, t, b, a, d, s, v), one folder a day."""
    rows.select("ts", "h", "t", "b", "a", "d", "s", "v", F.to_date(F.timestamp_seconds("ts")).alias("day")).write.mode("append").partitionBy("day").parquet(path)


def first_writes(new: DataFrame, store: DataFrame | None, key: str, seq: str) -> DataFrame:
    """The store with the new keys: a key that is stored keeps its row, of new rows the first by seq wins."""
    best = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), seq).alias("r")).select(key, "r.*")
    return best if store is None else store.unionByName(best.join(store.select(key), key, "left_anti"), allowMissingColumns=True)


def import_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSONL with one row per key: that of the first line of the first file."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    rows = lines.select("_at", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.min_by("r", "_at").alias("r")).select("r.*")


def line_index(texts: DataFrame, handle: str, text: str, version: list[str], indexed: DataFrame | None = None) -> DataFrame:
    """(handle, version, n, body): one row per line with text; a version that is indexed is not read again."""
    fresh = texts if indexed is None else texts.join(indexed.select(handle, *version).distinct(), [handle, *version], "left_anti")
    rows = fresh.where(F.octet_length(text) <= TEXT_BYTES).select(handle, *version, F.posexplode(F.split(text, "\n", -1)).alias("_n", "_line"))
    return rows.where(F.trim("_line") != "").select(handle, *version, (F.col("_n") + 1).alias("n"), F.substring("_line", 1, LINE_CHARS).alias("body"))


def expire(rows: DataFrame, seen: str, now: float, seconds: float = 7 * 86400) -> DataFrame:
    """Rows not older than a time to live."""
    return rows.where(F.col(seen) >= now - seconds)


def replace_field(response: Column, path: str, text: Column) -> Column:
    """A struct with one (nested) field replaced, everything else as it was."""
    return response.withField(path, text)


def share_blob(numbers: DataFrame) -> DataFrame:
    """A report row as JSON that holds numbers and booleans only."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    return numbers.select(F.to_json(F.struct(*[c for c, k in numbers.dtypes if k in kinds or k.startswith("decimal")])).alias("blob"))


def rewrite_if_exact(docs: DataFrame, text: str, path: str) -> None:
    """Encoded texts at a new path, never in place; rows that do not decode keep their text."""
    from sparkloom.operators.exact import round_trip

    done = round_trip(docs, text)
    done.withColumn(text, F.when(F.col("exact") & (F.col("saved") > 0), F.col("encoded")).otherwise(F.col(text))).drop("encoded", "exact").write.parquet(path)
