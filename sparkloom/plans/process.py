"""The whole treatment of tool outputs: presets, and their composition as one projection chain."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import digests, exact, logs, pruning, redaction, views
from sparkloom.operators.lines import collapse_dups


@dataclass(frozen=True)
class Settings:
    """prune: lossy selection of texts of `least` characters down to `keep`; digest: structured digests."""

    prune: bool = False
    digest: bool = False
    keep: float = 0.5
    least: int = 2000
    rules: tuple[str, ...] = exact.DEFAULT


# What the presets mean.
PRESETS = {
    "safe": Settings(),
    "balanced": Settings(prune=True),
    "aggressive": Settings(prune=True, keep=0.33, least=1500),
    "digest": Settings(digest=True),
}


def settings_of(spark: SparkSession, preset: str | None = None) -> Settings:
    """A preset, with what the session sets as spark.sparkloom.keep and spark.sparkloom.least."""
    base = PRESETS[preset or spark.conf.get("spark.sparkloom.preset", "safe")]
    return replace(base, keep=float(spark.conf.get("spark.sparkloom.keep", str(base.keep))), least=int(spark.conf.get("spark.sparkloom.least", str(base.least))))


def process(outputs: DataFrame, settings: Settings = PRESETS["safe"], text: str = "text", command: str | None = None) -> DataFrame:
    """outputs with shown, stage (the last that changed it), rules and saved.

    Order: noise (colours, redraws, runs of equal lines), exact encoding, then a digest or a selection of
    lines.  File views are never selected from.  A stage's result counts only if it is shorter; nothing
    is ever longer than its input, and a null text stays null.
    """
    source = F.col(text)
    view = views.view_kinds(F.col(command))["first"] if command else F.lit(False)
    quiet = T.let(T.let(T.strip_sgr(source), T.collapse_cr), lambda t: collapse_dups(t)["text"])
    noise = T.let(quiet, lambda t: F.when(F.length(t) < F.length(source), t).otherwise(source))
    out = outputs.withColumn("_view", view).withColumn("_noise", F.when(F.col("_view"), source).otherwise(noise))
    out = out.withColumn("_exact", exact.encoded(F.col("_noise"), settings.rules))
    out = out.withColumn("shown", F.col("_exact.text")).withColumn("rules", F.col("_exact.rules"))
    stage = F.when(F.size("rules") > 0, "exact").when(F.length("_noise") < F.length(source), "noise").otherwise("none")
    out = out.withColumn("stage", stage)
    large = (F.length("shown") >= settings.least) & ~F.col("_view")
    if settings.digest:
        out = out.withColumn("_d", F.when(large, digests.digested(F.col("shown"))))
        better = F.col("_d").isNotNull() & (F.size("_d.rules") > 0)
        out = out.withColumn("stage", F.when(better, "digest").otherwise(F.col("stage"))).withColumn("shown", F.when(better, F.col("_d.text")).otherwise(F.col("shown"))).drop("_d")
    if settings.prune:
        out = out.withColumn("_p", F.when(large, pruning.selected(F.col("shown"), settings.keep)))
        better = F.col("_p").isNotNull() & (F.length("_p") < F.length("shown"))
        out = out.withColumn("stage", F.when(better, "select").otherwise(F.col("stage"))).withColumn("shown", F.when(better, F.col("_p")).otherwise(F.col("shown"))).drop("_p")
    return out.withColumn("saved", (F.length(source) - F.length("shown")).cast("long")).drop("_view", "_noise", "_exact")


def register(spark: SparkSession) -> list[str]:
    """The engine's functions under SQL names."""
    from pyspark.sql.types import StringType

    functions = {
        "sl_prune": lambda t, keep: None if t is None else pruning.prune(t, keep),
        "sl_prune_query": lambda t, keep, q: None if t is None else pruning.prune(t, keep, q),
        "sl_encode": lambda t: None if t is None else exact.encode(t)[0],
        "sl_digest": lambda t: None if t is None else digests.digest(t)[0],
        "sl_compact_log": lambda t: None if t is None else logs.compact(t),
        "sl_redact": lambda t: None if t is None else redaction.redact(t)[0],
        "sl_unwrap": lambda t: None if t is None else views.unwrap(t),
    }
    for name, f in functions.items():
        spark.udf.register(name, F.udf(f, StringType(), useArrow=True))
    return sorted(functions)
