"""Usage and cost analytics over call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices per million tokens (input, 5-minute write, 1-hour write, read, output), seconds between pings.
PRICE_INPUT, PRICE_WRITE, PRICE_WRITE_HOUR, PRICE_READ, PRICE_OUTPUT, PING = 4.0, 5.0, 8.0, 0.2, 20.0, 240


def summarize(rows: DataFrame) -> DataFrame:
    """Counts log (h source, t tool, b before, a after, d deduplicated, s state) in all, by source and by tool.

    One aggregation with grouping sets.  Rows of state `context` add savings only.
    """
    b, a, d = (F.coalesce(F.col(c), F.lit(0)) for c in "bad")
    call = F.coalesce(F.col("s") != "context", F.lit(True))
    base = rows.select(
        F.coalesce("h", F.lit("?")).alias("h"), F.coalesce("t", F.lit("?")).alias("t"), call.alias("call"), F.coalesce(F.col("s") == "off", F.lit(False)).alias("off"), b.alias("b"), a.alias("a"), d.alias("d")
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    x = F.col("call")
    return base.groupingSets([["h"], ["t"], []], "h", "t").agg(
        count(x).alias("calls"), count(x & (F.col("a") < F.col("b"))).alias("changed"), count(x & F.col("off")).alias("off"),
        total(x, F.col("b")).alias("before"), total(x, F.col("a")).alias("after"), total(x, F.col("d")).alias("dedup"), total(~x, F.col("d")).alias("request_dedup"),
    )


def share(saved: Column, new: Column) -> Column:
    """Saved tokens in percent of what would have been new input."""
    return F.when(saved + new > 0, 100.0 * saved / (saved + new))


def gap_policy_costs(requests: DataFrame, stream: str, keep_alive: float = 20.0) -> DataFrame:
    """Per stream the cost under a 5-minute cache, a 1-hour cache and a 5-minute cache kept alive.

    requests: stream, t (seconds), fresh, read, written, output (tokens).  A gap of 5 to 60 minutes
    turns reads into writes under the short cache, and large rewrites into reads under the long one.
    """
    w = Window.partitionBy(stream).orderBy("t", "seq")
    rows = requests.withColumn("total", F.col("fresh") + F.col("read") + F.col("written"))
    rows = rows.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("before", F.lag("total").over(w)).withColumn("last", F.lead("t").over(w).isNull())
    cap = keep_alive * 60
    base = F.col("fresh") * PRICE_INPUT + F.col("read") * PRICE_READ + F.col("output") * PRICE_OUTPUT
    rewrite = (F.col("total") >= 20000) & (F.col("written") > 0.5 * F.col("total"))
    idle = F.coalesce((F.col("gap") >= 300) & (F.col("gap") < 3600), F.lit(False))
    reread = F.least("read", "before") * (PRICE_WRITE - PRICE_READ)
    saved = F.least("written", "before")
    pings = F.coalesce(F.floor(F.least(F.col("gap"), F.lit(cap)) / PING) * F.col("before") * PRICE_READ, F.lit(0.0)) + F.when(F.col("last"), F.floor(F.lit(cap) / PING) * F.col("total") * PRICE_READ).otherwise(0.0)
    short = base + F.col("written") * PRICE_WRITE + F.when(idle & ~rewrite, reread).otherwise(0.0)
    long_ = base + F.col("written") * PRICE_WRITE_HOUR - F.when(idle & rewrite, saved * (PRICE_WRITE_HOUR - PRICE_READ)).otherwise(0.0)
    alive = (
        base + F.col("written") * PRICE_WRITE + pings
        - F.when(idle & rewrite & (F.col("gap") < cap + 300), saved * (PRICE_WRITE - PRICE_READ)).otherwise(0.0)
        + F.when(idle & ~rewrite & (F.col("gap") >= cap + 300), reread).otherwise(0.0)
    )
    return rows.groupBy(stream).agg(F.count("*").alias("requests"), *[(F.sum(c) / 1e6).alias(n) for c, n in ((short, "usd_5m"), (long_, "usd_1h"), (alive, "usd_5m_alive"))])


def suppress_repeats(events: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the stream's row before."""
    w = Window.partitionBy(stream).orderBy(*order)
    return events.withColumn("_p", F.lag(value).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")


def outliers(rows: DataFrame, group: str, value: str, factor: float = 8.0) -> DataFrame:
    """Rows beyond `factor` times the group's median, or below its part.

    The median is exact, however few groups there are: a sketch gives two values around it, everything
    outside is only counted, and the few values between them are ranked by their counts.
    """
    from sparkloom.sources import scratch

    sketch = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), F.percentile_approx(value, [0.4995, 0.5005], 10_000).alias("_ends"))  # off by 0.0001 at most
    ends = scratch.table(sketch.select(F.col(group).alias("_g"), "_n", F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high")))
    counted = rows.groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).where("_v is not null")
    placed = counted.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    below = placed.where("_v < _low").groupBy(F.col("_g").alias("_b")).agg(F.sum("_c").alias("_below"))
    near = placed.where("_v between _low and _high").join(below, F.col("_g").eqNullSafe(F.col("_b")), "left")
    rank = F.coalesce("_below", F.lit(0)) + F.sum("_c").over(Window.partitionBy("_g").orderBy("_v"))
    first = lambda k: F.min(F.when(F.col("_rank") > F.floor((F.col("_n") + k) / 2), F.col("_v")))
    median = near.withColumn("_rank", rank).groupBy("_g").agg(((first(-1) + first(0)) / 2).alias("_m"))
    rows = rows.join(median, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return rows.where((F.col(value) > factor * F.abs("_m")) | (F.col(value) < F.col("_m") / factor)).withColumnRenamed("_m", "median")


def rolling_spikes(rows: DataFrame, group: str, order: list[str], value: str, width: int = 16, sigmas: float = 3.0) -> DataFrame:
    """Rows that lie over `sigmas` deviations from the mean of the `width` rows before them."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-width, -1)
    out = rows.withColumn("mean", F.avg(value).over(w)).withColumn("dev", F.stddev_pop(value).over(w)).withColumn("_n", F.count(value).over(w))
    return out.where((F.col("_n") == width) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("dev"))).drop("_n")


def sessions(events: DataFrame, user: str, t: str, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of a user: a gap of over gap_seconds starts a new one."""
    w = Window.partitionBy(user).orderBy(t)
    seconds = F.unix_micros(F.col(t).cast("timestamp")) / 1e6
    new = F.coalesce(seconds - F.lag(seconds).over(w) > gap_seconds, F.lit(True)).cast("int")
    return events.withColumn("session", F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy(user, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("events"))


def top_and_rest(rows: DataFrame, name: str, value: str, k: int = 8) -> DataFrame:
    """The k largest names, and the rest as one row; share in percent of all."""
    sums = rows.groupBy(name).agg(F.sum(value).alias("total"))
    ranked = sums.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("total"), name)))
    label = F.when(F.col("_r") <= k, F.col(name)).otherwise("other")
    out = ranked.groupBy(label.alias(name)).agg(F.sum("total").alias("total"))
    return out.join(F.broadcast(sums.agg(F.sum("total").alias("_all")))).withColumn("percent", 100 * F.col("total") / F.col("_all")).drop("_all")  # _all: one row
