"""Shared scratch tables: every cut of lineage goes through the cluster's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/sparkloom"


#: Bytes of an Arrow batch on its way to or from Python: a worker holds a few of them at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES, if it is higher.

    Batches are cut by rows and bytes; at the default of 64 MB a task's copies on both sides of the
    socket would take most of a small executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key).removesuffix("b")  # a value with a unit was set by someone and stays
    if have.isdigit() and int(have) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete the path when it ends: results may still read it until then."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage, exact sizes for AQE."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, name)
    delete_at_end(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def row_ids(df: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, bool]:
    """(df with a unique, non-null long ``_uid``, whether a table was written for it).

    Integer ids that are unique and non-null serve as they are; otherwise the columns are written
    once with generated ids, so that every later pass sees the same ones.
    """
    from pyspark.sql import functions as F

    kind = dict(df.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        clash = df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1)
        if not clash.take(1):
            return df.select(F.col(id_col).cast("long").alias("_uid"), *columns), False
    return materialize(df.select(F.monotonically_increasing_id().alias("_uid"), *columns), "rows"), True
