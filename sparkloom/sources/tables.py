"""A Python data source for tables of SQLite files, and readers of whole session files."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    """Ranges of rowids, one partition each; the file is opened read-only."""

    def __init__(self, schema, options):
        self.names, self.options = schema.fieldNames(), options

    def _connect(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = max(1, (high - low + 1 + 7) // int(self.options.get("partitions", 8)))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        columns = ", ".join(f'"{n}"' for n in self.names)
        with self._connect() as c:
            yield from c.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', partition.value)


class SqliteSource(DataSource):
    """format("sqlite") with options path, table, partitions and a schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in c.execute(f'PRAGMA table_info("{self.options["table"]}")'))

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file that all executors can open."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).load()


def database_usage(spark: SparkSession, path: str, since: float = 0.0) -> DataFrame:
    """Usage of assistant messages kept as JSON in a table `message(id, session_id, time_created, data)`."""
    data = "struct<role:string,providerID:string,tokens:struct<input:bigint,output:bigint,cache:struct<read:bigint,write:bigint>>>"
    rows = sqlite_table(spark, path, "message").select("session_id", (F.col("time_created") / 1000.0).alias("t"), F.from_json("data", data).alias("d"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.where((F.col("d.role") == "assistant") & F.col("d.tokens").isNotNull() & (F.col("t") >= since)).select(
        F.lit("database").alias("source"), F.col("session_id").alias("file"), "t", (zero("d.tokens.input") + zero("d.tokens.cache.write")).alias("new_input"), zero("d.tokens.cache.read").alias("cache_read"), zero("d.tokens.output").alias("output")
    )


def session_estimates(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, model, requests, input, output) of session files, tokens estimated as characters / 4."""
    schema = "session_id string, model string, system_prompt string, messages array<struct<role:string,content:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    size = lambda f: F.aggregate(F.filter("messages", f), F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.length(m["content"]), F.lit(0)))
    reply = lambda m: m["role"] == "assistant"
    return rows.select(
        "session_id", "model", F.size(F.filter("messages", reply)).cast("long").alias("requests"), ((size(lambda m: ~reply(m)) + F.coalesce(F.length("system_prompt"), F.lit(0))) / 4.0).alias("input"), (size(reply) / 4.0).alias("output")
    )


def preview_files(spark: SparkSession, path: str, previews: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Whole text files whose head is the preview that a tool showed; larger or other files are left out."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("_file"), F.col("value").alias("text")).where(F.octet_length("text") <= most)
    name = F.element_at(F.split("_file", "/"), -1)
    return files.withColumn("name", name).join(previews, "name").where(F.expr("startswith(text, preview)")).select("name", "text")
