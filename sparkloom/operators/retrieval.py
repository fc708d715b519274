"""Query-aware retrieval: inverted index, BM25, search with context, shared budgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WORD = r"[A-Za-z0-9_./:-]{2,}"


def postings(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, term, tf, length): the inverted index, counted by a map-side aggregation over (key, term)."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), 0)
    rows = texts.select(*key, words.alias("w")).select(*key, "w", F.size("w").cast("long").alias("length"))
    return rows.select(*key, "length", F.explode("w").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_text: str = "text", query_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    Document terms are matched before anything is counted, so only terms that some query has are
    shuffled; frequencies and lengths still cover all documents.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(query_text)), F.lit(WORD), 0))).alias("term"))
    words = F.regexp_extract_all(F.lower(F.col(doc_text)), F.lit(WORD), 0)
    base = docs.select(doc_id, words.alias("w"))
    size = base.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = base.select(doc_id, F.explode("w").alias("term"), F.size("w").alias("length")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = terms.groupBy(doc_id, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = tf.join(df, "term").join(F.broadcast(size)).withColumn("part", part)  # size: one row
    return scored.join(asked, "term").groupBy(query_id, doc_id).agg(F.sum("part").alias("score"))


def rank_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """symbols (name, signature, doc) with score: (1 + ln tf) x idf of the query's terms over all three, and 2 more
    where the name holds a term; symbols without one have 0."""
    asked = sorted({w.lower() for w in re.findall(r"[A-Za-z0-9_]+", query)})
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), 0)
    rows = symbols.withColumn("_t", terms(F.concat_ws(" ", "name", "signature", "doc")))
    count = lambda w: F.size(F.filter("_t", lambda x: x == w))
    df = rows.agg(F.count("*").alias("_n"), *(F.count_if(count(w) > 0).alias(f"_df{k}") for k, w in enumerate(asked)))
    part = lambda k, w: F.when(count(w) > 0, (1 + F.ln(count(w))) * F.ln(1 + (F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))).otherwise(0.0)
    score = sum((part(k, w) for k, w in enumerate(asked)), F.lit(0.0)) + F.when(F.arrays_overlap(terms(F.col("name")), F.array(*map(F.lit, asked)).cast("array<string>")), 2.0).otherwise(0.0)
    return rows.join(F.broadcast(df)).withColumn("score", score).select(*symbols.columns, "score")  # df: one row


def top_k(scores: DataFrame, group: str, k: int, order: list) -> DataFrame:
    """The k best rows of each group; ranks are pruned before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def search_lines(lines: DataFrame, key: list[str], pattern: str, context: int = 3) -> DataFrame:
    """Lines that match, with `context` lines on either side; overlapping windows are one block."""
    w = Window.partitionBy(*key).orderBy("pos")
    hit = F.col("line").rlike(pattern)
    marked = lines.withColumn("hit", hit)
    near = F.max("hit").over(w.rowsBetween(-context, context))
    kept = marked.withColumn("_near", near).where("_near").drop("_near")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(True)).cast("int")
    return kept.withColumn("block", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def allocate(docs: DataFrame, group: str, length: str, score: str, budget: float, rounds: int = 4) -> DataFrame:
    """docs with rate: a shared budget (share of the group's characters) dealt by score in rounds.

    Weights run from 0.35 to 1.5 between the group's lowest and highest score; what a full document
    leaves over goes to the others in the next round; rates lie between 0.05 and 1.  Only sums by group
    are shuffled: a row's share follows from its own length and score and the group's parts of each round.
    """
    from sparkloom.sources import scratch

    def shares(rows):
        """(allotted, open) of a row after the rounds dealt so far, whose parts of a weight are in _deals."""
        weight = (0.35 + 1.15 * (F.col(score) - F.col("_low")) / F.greatest(F.lit(1e-6), F.col("_high") - F.col("_low"))) * F.col(length)

        def deal(state, part):
            want = part * weight
            full = state["a"] + want >= F.col(length)
            return F.struct(F.when(~state["o"], state["a"]).when(full, F.col(length)).otherwise(state["a"] + want).alias("a"), (state["o"] & ~full).alias("o"))

        state = F.aggregate("_deals", F.struct(F.lit(0.0).alias("a"), (F.col(length) > 0).alias("o")), deal)
        return rows.withColumn("_s", state).withColumn("_w", weight)

    def joined(deals):  # one row a group: the planner broadcasts it if its size allows
        return shares(docs.join(deals.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g"))

    ends = docs.groupBy(group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), (budget * F.sum(length)).alias("_budget"))
    deals = scratch.table(ends.withColumn("_deals", F.array().cast("array<double>")))
    for _ in range(rounds):
        sums = joined(deals).groupBy(group, "_low", "_high", "_budget", "_deals").agg(F.sum("_s.a").alias("_used"), F.sum(F.when(F.col("_s.o"), F.col("_w")).otherwise(0.0)).alias("_all"))
        part = F.when(F.col("_all") > 0, F.greatest(F.col("_budget") - F.col("_used"), F.lit(0.0)) / F.col("_all")).otherwise(0.0)
        deals = scratch.table(sums.select(group, "_low", "_high", "_budget", F.concat("_deals", F.array(part)).alias("_deals")))
    rate = F.when(F.col(length) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("_s.a") / F.col(length)))).otherwise(0.0)
    return joined(deals).withColumn("rate", rate).select(*docs.columns, "rate")


def containment(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, block: int = 200) -> DataFrame:
    """(doc_id, item_id) where the document holds the item's whole text, anywhere in it.

    Between an item's first and last white space its words are whole words of any document that holds
    it, so its first three inner words are the key of an equi-join; only ids go through that join, and
    texts meet for the hits alone.  Items of fewer inner words have no such key: they are searched
    in every document, `block` at a time.  An empty item is in every document; null items and texts match nothing.
    """
    words = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    text = items.select(item_id, F.col("text").alias("_item")).where("_item is not null")
    parts = F.split("_item", r"[ \t\n\x0B\f\r]+")
    keyed = text.withColumn("_w", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    long = keyed.where(F.size("_w") >= 3).select(item_id, "_item", F.array_join(F.slice("_w", 1, 3), " ").alias("_k"))
    short = keyed.where(F.size("_w") < 3).select(item_id, "_item")

    rows = docs.select(F.col(doc_id).alias("_doc"), "text").where("text is not null")
    w = rows.select("_doc", words(F.col("text")).alias("_w")).where(F.size("_w") >= 3)
    grams = w.select("_doc", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.array_join(F.slice("_w", i, 3), " ")))).alias("_k"))
    pairs = grams.join(long.select(item_id, "_k"), "_k").select("_doc", item_id).distinct()
    hits = pairs.join(rows, "_doc").join(long.drop("_k"), item_id).where(F.expr("contains(text, _item)")).select(F.col("_doc").alias(doc_id), item_id)

    blocks = -(-short.count() // block)
    for k in range(blocks):
        some = short.where(F.pmod(F.xxhash64(item_id, "_item"), F.lit(blocks)) == k).agg(F.collect_list(F.struct(item_id, "_item")).alias("_block"))
        every = rows.join(F.broadcast(some)).select("_doc", F.explode(F.filter("_block", lambda x: F.call_function("contains", F.col("text"), x["_item"]))).alias("_hit"))  # one row of about `block` items
        hits = hits.unionByName(every.select(F.col("_doc").alias(doc_id), F.col(f"_hit.{item_id}").alias(item_id)))
    return hits.distinct()
