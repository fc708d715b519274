"""Chunks, sessions and whole-output references by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_chunks(docs: DataFrame, order: str, text_col: str = "text", group: list[str] | None = None) -> DataFrame:
    """docs with first: the smallest `order` with the same text but for white space, and duplicate.

    One aggregation by digest; the texts themselves are not shuffled.  Blank texts are duplicates of
    nothing and count as empty.
    """
    norm = F.trim(F.regexp_replace(F.col(text_col), r"\s+", " "))
    group = group or []
    keyed = docs.withColumn("_k", F.when(norm == "", F.lit(None)).otherwise(F.sha2(norm, 256)))
    w = keyed.where("_k is not null").groupBy(*group, "_k").agg(F.min(order).alias("first"))
    out = keyed.join(w, [*group, "_k"], "left")
    return out.withColumn("first", F.coalesce("first", F.col(order))).withColumn("duplicate", F.col("first") != F.col(order)).drop("_k")


def earlier_equal(turns: DataFrame, session: str, seq: str, text_col: str = "text", age: int = 100) -> DataFrame:
    """turns with same_as: the latest earlier turn of the session with the same text, at most `age` back."""
    w = Window.partitionBy(session, F.sha2(text_col, 256)).orderBy(seq)
    found = F.lag(seq).over(w)
    return turns.withColumn("same_as", F.when(F.col(seq) - found <= age, found))


def first_rendering(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """First write wins: per key the value with the smallest seq, and how often it was written."""
    return rows.groupBy(key).agg(F.min_by(value, seq).alias(value), F.min(seq).alias("first_seq"), F.count("*").alias("writes"))


def evict(store: DataFrame, seen: str, size: str, cap: int, key: str) -> DataFrame:
    """The most recently seen rows whose sizes fit the cap.

    The running sum is over days first (one row a day), then within the day on the border, so no task
    sorts the whole store.
    """
    day = store.groupBy(F.floor(F.col(seen) / 86400).alias("_d")).agg(F.sum(size).alias("s"))
    above = day.select("_d", F.coalesce(F.sum("s").over(Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    rows = store.withColumn("_d", F.floor(F.col(seen) / 86400)).join(above, "_d")
    own = F.sum(size).over(Window.partitionBy("_d").orderBy(F.desc(seen), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", F.col("_above") + own).where(F.col("_sum") <= cap).drop("_d", "_above", "_sum")


def calls_with_results(messages: DataFrame, session: str, call_id: str) -> DataFrame:
    """Each result with its call, by session and call id; results without a call stay."""
    calls = messages.where("kind = 'call'").select(session, call_id, F.col("text").alias("call"))
    return messages.where("kind = 'result'").join(calls, [session, call_id], "left")


def unseen(texts: DataFrame, registry: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts whose digest is not in the registry."""
    return texts.withColumn("_h", F.sha2(text_col, 256)).join(registry.select(F.col("digest").alias("_h")), "_h", "left_anti").drop("_h")
