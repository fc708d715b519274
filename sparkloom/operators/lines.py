"""Line operators: runs, repeats, heuristic scores, budgets, gaps, references.

Where a result depends on one text only it is an expression over the text's line array, so nothing is
shuffled.  Where it needs ranks or running sums over lines, the lines are exploded with an explicit
position and windows are partitioned by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import ERROR_LINE, RAISED, let

TAG = r"  \[× \d+\]\r?$"
#: Characters that a decoder may make of one text.
LIMIT = 64 << 20
#: Gap marker: how many lines are left out.
GAP = "[… {} omitted …]"


def line_array(c: Column) -> Column:
    """Lines of a text; a break at the end makes no further line."""
    lines = F.split(c, "\n", -1)
    return F.when(c == "", F.array().cast("array<string>")).when(c.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def explode_lines(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line: the kept columns, pos (from 0), line.  Null texts have no lines."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(line_array(F.col(text_col))).alias("pos", "line"))


def run_array(lines: Column) -> Column:
    """array<struct<line, n>>: maximal runs of equal lines, in order."""

    def runs(a):
        indexed = F.transform(a, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
        heads = F.filter(indexed, lambda r: (r["i"] == 0) | (F.get(a, r["i"] - 1) != r["line"]))
        return let(heads, lambda h: F.transform(h, lambda r, k: F.struct(r["line"].alias("line"), (F.coalesce(F.get(h, k + 1)["i"], F.size(a)) - r["i"]).alias("n"))))

    return let(lines, runs)


def _tagged(line: Column, n: Column) -> Column:
    tag = F.concat(F.lit("  [× "), n.cast("string"), F.lit("]"))
    crlf = line.endswith("\r")
    return F.when(crlf, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), tag, F.lit("\r"))).otherwise(F.concat(line, tag))


def run_pays(line: Column, n: Column) -> Column:
    """A run is collapsed if it has 3 lines of 8 letters and saves 16 characters more than its tag."""
    cost = F.length(_tagged(line, n)) - F.length(line)
    return (n >= 3) & (F.length(F.trim(line)) >= 8) & ((F.length(line) + 1) * (n - 1) >= cost + 16)


def collapse_dups(c: Column) -> Column:
    """struct(text, runs): runs of equal lines as one line with a count; a text that already holds such
    counts stays as it is."""
    block = lambda r: F.when(run_pays(r["line"], r["n"]), F.array(_tagged(r["line"], r["n"]))).otherwise(F.array_repeat(r["line"], r["n"]))

    def build(text):
        def whole(runs):
            end = F.when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
            joined = F.concat(F.array_join(F.flatten(F.transform(runs, block)), "\n"), end)
            count = F.size(F.filter(runs, lambda r: run_pays(r["line"], r["n"])))
            return F.struct(joined.alias("text"), count.cast("long").alias("runs"))

        tagged = F.exists(line_array(text), lambda x: x.rlike(TAG))
        return F.when(tagged | text.isNull(), F.struct(text.alias("text"), F.lit(0).cast("long").alias("runs"))).otherwise(let(run_array(line_array(text)), whole))

    return let(c, build)


def expand_dups(c: Column) -> Column:
    """The inverse of collapse_dups for texts it changed; null where the result would have over LIMIT
    characters, as no count that collapse_dups writes does for a text of that length: a forged one."""
    times = lambda x: F.coalesce(F.regexp_extract(x, r"  \[× (\d+)\]\r?$", 1).try_cast("long"), F.lit(1))

    def expand(lines):
        size = F.aggregate(lines, F.lit(0.0), lambda s, x: s + (F.length(x) + 1) * F.when(x.rlike(TAG), times(x)).otherwise(F.lit(1)))
        parts = F.transform(lines, lambda x: F.when(x.rlike(TAG), F.array_repeat(F.regexp_replace(x, r"  \[× \d+\](\r?)$", "$1"), times(x).cast("int"))).otherwise(F.array(x)))
        return F.when(size <= LIMIT, F.concat(F.array_join(F.flatten(parts), "\n"), F.when(c.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))))

    return let(line_array(c), expand)


def repeat_index(lines: DataFrame, key: list[str]) -> DataFrame:
    """lines with occ: how many earlier lines of the document are equal but for their digits."""
    norm = F.regexp_replace(F.trim("line"), r"\d+", "0")
    return lines.withColumn("occ", (F.row_number().over(Window.partitionBy(*key, norm).orderBy("pos")) - 1).cast("long"))


#: Heuristics of a line's score, in the common subset of Java's, Python's and RE2's expressions.  Names:
#: joined by signs, with a digit, with an underscore, or with an inner capital.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:[./:-][A-Za-z0-9_]+)+|[A-Za-z_]*[0-9][A-Za-z0-9_]*|[A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*"
#: Lines that define or import something, or that tell of trouble.
STRONG = r"(?:^|[^A-Za-z0-9_])(?:class|def|function|import|include|interface|package|procedure|raise|return|struct|throw|trait|type)(?:[^A-Za-z0-9_]|$)|(?i:crash|error|exception|fail|panic|warning)"
#: Lines that begin with the comment sign of a common language.
COMMENT = r"^[ \t]*(?:#|//|/\*|--|;|%)"


def heuristic_scores(lines: DataFrame, key: list[str], n: str = "n_lines") -> DataFrame:
    """lines with score: 1 for each name, 3 for a strong word, -2 for a comment, -3 for each repeat (3 at
    most), 1 in the first and last three lines, -5 if blank.  `n` names the document's line count."""
    ranked = repeat_index(lines, key)
    blank = F.trim("line") == ""
    score = (
        F.regexp_count("line", F.lit(IDENT))
        + F.when(F.col("line").rlike(STRONG), 3.0).otherwise(0.0)
        - F.when(F.col("line").rlike(COMMENT), 2.0).otherwise(0.0)
        - 3.0 * F.least("occ", F.lit(3))
        + F.when((F.col("pos") < 3) | (F.col("pos") >= F.col(n) - 3), 1.0).otherwise(0.0)
    )
    return ranked.withColumn("score", F.when(blank, F.lit(-5.0)).otherwise(score))


def headtail(lines: DataFrame, key: list[str], rate: float, budget: str, n: str = "n_lines") -> DataFrame:
    """lines with keep: two lines of the head, then one of the tail, until the budget (rate x characters)
    is used.  The visiting order is a number, so the budget is a running sum."""
    step = F.least(F.floor(F.col("pos") / 2) * 3 + F.col("pos") % 2, (F.col(n) - 1 - F.col("pos")) * 3 + 2)
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(*key).orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("visit", step).withColumn("keep", before < F.lit(rate) * F.col(budget)).drop("visit")


def greedy_select(lines: DataFrame, key: list[str], rate: float, budget: str, score: str = "score") -> DataFrame:
    """lines with keep: by score, then position, each line that still fits is kept.

    A line that does not fit is skipped and smaller ones may follow, so this is no running sum but a
    loop over the document's sorted line sizes; only numbers go through Python, not the lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "pos", (F.length("line") + 1).alias("size"))))
    ranked = lines.groupBy(*key).agg(ordered.alias("_all"), (F.first(budget) * rate).cast("double").alias("_b"))
    pick = _greedy()
    part = lambda c: F.transform("_all", lambda x: x[c])
    chosen = ranked.select(*key, F.explode(pick(part("pos"), part("size"), F.col("_b"))).alias("pos")).withColumn("keep", F.lit(True))
    return lines.join(chosen, [*key, "pos"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def _greedy():
    @F.pandas_udf("array<int>")
    def pick(positions: pd.Series, sizes: pd.Series, budgets: pd.Series) -> pd.Series:
        out = []
        for pos, size, budget in zip(positions, sizes, budgets, strict=True):
            used, kept = 0, []
            for p, n in zip(pos.tolist(), size.tolist(), strict=True):
                if used + n <= budget or not used:
                    used += n
                    kept.append(p)
            out.append(kept)
        return pd.Series(out)

    return pick


def error_lines(lines: DataFrame, key: list[str], after: int = 3, before: int = 2) -> DataFrame:
    """lines with keep: error lines, up to `after` lines that follow and, for a final exception line, up to
    `before` lines ahead of it; a blank line ends either side."""
    w = Window.partitionBy(*key).orderBy("pos")
    error, last = F.col("line").rlike(ERROR_LINE), F.col("line").rlike(RAISED)
    block = F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w)
    marked = lines.withColumn("_e", error).withColumn("_l", error & last).withColumn("_b", block).withColumn("_blank", F.trim("line") == "")
    # Blocks are numbered so that a blank line opens one; only lines of the same block see each other.
    own = Window.partitionBy(*key, "_b").orderBy("pos")
    near = F.max("_e").over(own.rowsBetween(-after, 0)) | F.coalesce(F.max("_l").over(own.rowsBetween(0, before)), F.lit(False))
    return marked.withColumn("keep", F.col("_e") | (near & ~F.col("_blank"))).drop("_e", "_l", "_b", "_blank")


def render_kept(lines: DataFrame, key: list[str]) -> DataFrame:
    """Documents from lines with keep: each run of dropped lines is one gap marker."""
    w = Window.partitionBy(*key).orderBy("pos")
    runs = lines.withColumn("_new", F.col("keep") | F.coalesce(F.lag("keep").over(w), F.lit(True))).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    parts = runs.groupBy(*key, "_run").agg(F.max("keep").alias("keep"), F.count("*").alias("n"), F.first("line").alias("line"))
    text = F.when(F.col("keep"), F.col("line")).otherwise(F.concat(F.lit("[… "), F.col("n").cast("string"), F.when(F.col("n") == 1, " line").otherwise(" lines"), F.lit(" omitted …]")))
    ordered = F.array_sort(F.collect_list(F.struct("_run", text.alias("t"))))
    return parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


def neighbour_smooth(scores: DataFrame, key: list[str], c: str = "score") -> DataFrame:
    """scores with smooth: the largest of a line's own score and its neighbours' at 0.55 and 0.25."""
    w = Window.partitionBy(*key).orderBy("pos")
    at = lambda k, f: f * F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.lit(0.0))
    return scores.withColumn("smooth", F.greatest(F.col(c), at(1, 0.55), at(-1, 0.55), at(2, 0.25), at(-2, 0.25)))


def heading_path(lines: DataFrame, key: list[str], levels: int = 3) -> DataFrame:
    """lines with h1, h2, ...: the Markdown headings above each line; a higher heading closes lower ones."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    w = Window.partitionBy(*key).orderBy("pos")
    out = lines.withColumn("_l", level)
    for k in range(1, levels + 1):
        seen = F.last(F.when((F.col("_l") > 0) & (F.col("_l") <= k), F.struct("_l", "line")), ignorenulls=True).over(w)
        out = out.withColumn(f"h{k}", F.when(seen["_l"] == k, seen["line"]))
    return out.drop("_l")


def template_counts(lines: DataFrame, key: list[str]) -> DataFrame:
    """Templates of lines (words with a digit masked): n, first and last position, lines kept apart if rare."""
    mask = F.regexp_replace("line", r"\S*\d\S*", "<*>")
    return lines.where(F.trim("line") != "").groupBy(*key, mask.alias("template")).agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))
