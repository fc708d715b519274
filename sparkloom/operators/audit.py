"""Cost audit of request streams: breakdowns, sources, position pricing, survival of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.usage import PRICE_INPUT, PRICE_READ, PRICE_WRITE, PRICE_WRITE_HOUR


def aggregate(records: DataFrame) -> DataFrame:
    """Dollars by (component, source, tag) of records with cost array<struct<component, source, tag, usd>>."""
    return records.select(F.explode("cost").alias("c")).groupBy("c.component", "c.source", "c.tag").agg(F.sum("c.usd").alias("usd"))


def breakdown(costs: DataFrame, top: int = 8) -> DataFrame:
    """Dollars and percent by component; tool results by their `top` largest sources and the rest."""
    sums = costs.groupBy("component", "source").agg(F.sum("usd").alias("usd"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("usd"), "source"))
    named = sums.withColumn("_r", place).withColumn("source", F.when((F.col("component") == "tool result") & (F.col("_r") <= top), F.col("source")).when(F.col("component") == "tool result", "other"))
    out = named.groupBy("component", "source").agg(F.sum("usd").alias("usd"))
    whole = sums.agg(F.sum("usd").alias("_all"))
    return out.join(F.broadcast(whole)).withColumn("percent", 100 * F.col("usd") / F.col("_all")).drop("_all")  # _all: one row


def sources(costs: DataFrame, days: float, requests: DataFrame) -> DataFrame:
    """Dollars, dollars a month, percent and tokens a request by kind and name of source."""
    kind = F.when(F.col("source").startswith("mcp__"), "server").when(F.col("component") == "tool result", "tool").otherwise(F.col("component"))
    name = F.when(F.col("source").startswith("mcp__"), F.split_part("source", F.lit("__"), F.lit(2))).otherwise(F.col("source"))
    out = costs.groupBy(kind.alias("kind"), name.alias("name")).agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))
    whole = costs.agg(F.sum("usd").alias("_all")).join(requests.agg(F.count("*").alias("_n")))  # one row
    return out.join(F.broadcast(whole)).select("kind", "name", "usd", (F.col("usd") * 30 / days).alias("usd_month"), (100 * F.col("usd") / F.col("_all")).alias("percent"), (F.col("tokens") / F.col("_n")).alias("tokens_per_request"))


def price_by_position(items: DataFrame, requests: DataFrame, request: str) -> DataFrame:
    """items with usd: each item's tokens priced by where they lie in its request.

    A request reads `read` tokens from the cache, then writes `written` (of which `hour` for an hour),
    then has `fresh` ones; an item covers the tokens from the sum of those before it on.
    """
    w = Window.partitionBy(request).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = items.withColumn("_e", F.sum("tokens").over(w)).withColumn("_s", F.col("_e") - F.col("tokens")).join(requests, request)
    part = lambda lo, hi: F.greatest(F.lit(0), F.least("_e", hi) - F.greatest("_s", lo))
    end_read, end_write = F.col("read"), F.col("read") + F.col("written")
    write = (PRICE_WRITE * (F.col("written") - F.col("hour")) + PRICE_WRITE_HOUR * F.col("hour")) / F.greatest("written", F.lit(1))
    usd = part(F.lit(0), end_read) * PRICE_READ + part(end_read, end_write) * write + part(end_write, F.lit(2**62)) * PRICE_INPUT
    return placed.withColumn("usd", usd / 1e6).drop("_s", "_e", "read", "written", "hour", "fresh")


def per_source(counts: DataFrame, usage: DataFrame) -> DataFrame:
    """Calls, saved tokens (characters / 4) and share of input by source of the counts log."""
    saved = counts.groupBy(F.coalesce("h", F.lit("?")).alias("source")).agg(F.count("*").alias("calls"), (F.sum(F.col("b") - F.col("a")) / 4.0).alias("saved"))
    new = usage.groupBy("source").agg(F.sum("new_input").alias("new_input"))
    return saved.join(new, "source", "left").withColumn("share", F.when(F.col("saved") + F.col("new_input") > 0, 100 * F.col("saved") / (F.col("saved") + F.col("new_input"))))


def survival(pairs: DataFrame, before: str, after: str, keep) -> DataFrame:
    """pairs with want and lost (protected words) and json_ok: JSON before is JSON after."""
    found = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), 0), keep))
    want, have = found(F.col(before)), found(F.col(after))
    is_json = lambda c: F.coalesce(F.col(c).rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull(), F.lit(False))
    return pairs.withColumn("want", F.size(want).cast("long")).withColumn("lost", F.size(F.array_except(want, have)).cast("long")).withColumn("json_ok", ~is_json(before) | is_json(after))


def summarize_survival(rows: DataFrame) -> DataFrame:
    """Texts, texts without a loss, share of protected words kept, and of JSON that is still valid."""
    return rows.agg(
        F.count("*").alias("texts"), F.sum((F.col("lost") == 0).cast("long")).alias("whole"), (1 - F.sum("lost") / F.greatest(F.sum("want"), F.lit(1))).alias("kept"), F.avg(F.col("json_ok").cast("double")).alias("json_ok")
    )


def server_of(names: DataFrame, servers: DataFrame, name: str = "name", server: str = "server") -> DataFrame:
    """names with the server that equals one but for case and signs, else the shortest that ends in _name, else the name itself."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    known = servers.select(F.col(server).alias("_server"), norm(F.col(server)).alias("_k"))
    same = names.join(known.groupBy("_k").agg(F.min("_server").alias("_same")), norm(F.col(name)) == F.col("_k"), "left").drop("_k")
    tails = servers.select(F.col(server).alias("_long"), F.explode(F.transform(F.sequence(F.lit(1), F.length(server)), lambda i: F.substr(server, i))).alias("_tail")).where(F.col("_tail").startswith("_"))
    best = tails.groupBy("_tail").agg(F.min_by("_long", F.struct(F.length("_long"), F.col("_long"))).alias("_long"))
    out = same.join(best, F.concat(F.lit("_"), F.col(name)) == F.col("_tail"), "left")
    return out.withColumn("matched", F.coalesce("_same", "_long", name)).drop("_same", "_long", "_tail")


def bootstrap(rows: DataFrame, group: str, value: str, samples: int = 500, seed: int = 0) -> DataFrame:
    """(group, mean, low, high): percentile bootstrap of the mean with Poisson weights.

    Every row draws its own weight in each sample from a hash of (row, sample), so one pass with
    partial sums does all samples; nothing is drawn on the driver.
    """
    u = F.pmod(F.xxhash64(F.struct(*rows.columns), F.col("_k"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    weight = sum((u >= s).cast("int") for s in steps)
    drawn = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_w", weight)
    means = drawn.groupBy(group, "_k").agg((F.sum(F.col(value) * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1))).alias("_m"))
    bounds = means.groupBy(group).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return rows.groupBy(group).agg(F.avg(value).alias("mean")).join(bounds, group)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, 100.0 * part / whole)
