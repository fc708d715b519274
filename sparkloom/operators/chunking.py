"""Packing texts into chunks of a token budget, alignment of shortened texts, and layout changes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.exact import estimate

#: Tokens of a chunk at most; smaller rests than LEAST join the chunk before.
MOST, LEAST = 500, 48


def chunks(text: str, count=estimate, most: int = MOST, least: int = LEAST) -> list[str]:
    """Consecutive parts of a text (their concatenation is the text) of at most `most` tokens: whole lines
    where they fit, words of longer lines."""
    pieces = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        pieces += [line] if count(line) <= most else re.findall(r"\s*\S+\s*", line) or [line]
    out, used = [], 0
    for piece in pieces:
        n = count(piece)
        if out and used + n <= most:
            out[-1] += piece
            used += n
        else:
            out.append(piece)
            used = n
    if len(out) > 1 and used < least:
        out[-2:] = [out[-2] + out[-1]]
    return out


def chunk_table(docs: DataFrame, key: list[str], text: str = "text", most: int = MOST) -> DataFrame:
    """(key, chunk number, chunk) of every text; null and empty texts have none."""

    @F.pandas_udf("array<string>")
    def go(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks(t or "", most=most) for t in texts])

    return docs.select(*key, F.posexplode(go(F.col(text))).alias("n", "chunk"))


def token_windows(costs: Column, most: int = 512) -> Column:
    """array<int>: the window of each atom of an array of token costs; a window ends before the atom that would
    take it over `most`, and an atom of more has its own."""

    def step(state: Column, n: Column) -> Column:
        new = (state["used"] > 0) & (state["used"] + n > most)
        at = state["at"] + new.cast("int")
        return F.struct(F.when(new, n).otherwise(state["used"] + n).alias("used"), at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(costs, lambda x: x.cast("double")), start, step, lambda s: s["out"])


def align(source: list[str], kept: list[str]) -> list[bool] | None:
    """Which source lines the kept lines are, in order; None if they are no subsequence."""
    keep, at = [False] * len(source), 0
    for line in kept:
        while at < len(source) and source[at] != line:
            at += 1
        if at == len(source):
            return None
        keep[at] = True
        at += 1
    return keep


def annotate(text: str, short: str) -> str | None:
    """A shortened text with the line ranges that it leaves out, and a footer that names the original; None
    if the original could not be recovered from the ranges."""
    import hashlib

    source = text.split("\n")
    keep = align(source, [x for x in short.split("\n") if not x.startswith("[…")])
    if keep is None:
        return None
    out, start = [], None
    for i, (line, k) in enumerate(zip([*source, ""], [*keep, True], strict=True), 1):
        if not k:
            start = start or i
            continue
        if start:
            out.append(f"[… lines {start}-{i - 1} omitted …]")
            start = None
        if i <= len(source):
            out.append(line)
    return "\n".join([*out, f"[sl: kept {sum(keep)} of {len(source)} lines of {hashlib.sha256(text.encode()).hexdigest()[:12]}]"])


def annotated(text: Column, short: Column) -> Column:
    @F.pandas_udf("string")
    def go(texts: pd.Series, shorts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else annotate(t, s) for t, s in zip(texts, shorts, strict=True)], dtype=object)

    return go(text, short)


def reindent(text: str, indent: str = "  ") -> str:
    """Valid JSON with one token run per line; every token stays as it is written."""
    out, depth = [], 0
    for token in re.findall(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', text):
        if token in "[{":
            depth += 1
            out.append(token + "\n" + indent * depth)
        elif token in "]}":
            depth -= 1
            out.append(("\n" + indent * depth if not out or not out[-1].endswith("\n" + indent * (depth + 1)) else "") + token)
            if len(out) > 1 and out[-2].endswith("\n" + indent * (depth + 1)):
                out[-2] = out[-2].rstrip("\n " + indent)
        else:
            out.append({",": ",\n" + indent * depth, ":": ": "}.get(token, token))
    return "".join(out)


def notebook_diff(diff: str) -> str:
    """A notebook's diff with its JSON string lines decoded, large blobs as stubs and counter changes folded."""
    out, counters = [], 0
    for line in diff.split("\n"):
        m = re.match(r'^([-+ ])\s*("(?:[^"\\]|\\.)*"),?$', line)
        if re.match(r'^[-+]\s*"execution_count": (?:\d+|null),?$', line):
            counters += 1
            continue
        if counters and not line.startswith(("+", "-")):
            out.append(f"[{counters} execution counts changed]")
            counters = 0
        blob = re.match(r'^([-+ ])\s*"(image/\w+|application/\S+)": "([A-Za-z0-9+/=\\n]{200,})"?', line)
        if blob:
            out.append(f"{blob[1]}<{blob[2]}, {len(blob[3])} characters>")
        elif m:
            out.append(m[1] + json.loads(m[2]).rstrip("\n"))
        else:
            out.append(line)
    return "\n".join([*out, f"[{counters} execution counts changed]"] if counters else out)


def local_ranks(scores: DataFrame, key: list[str], block: str, c: str = "score", blend: float = 0.35) -> DataFrame:
    """scores with blended: the score and its rank within its block, ties by position."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key, block)
    rank = F.row_number().over(w.orderBy(F.col(c), F.desc("pos"))) - 1
    n = F.count("*").over(w)
    share = F.when(n > 1, rank / (n - 1)).otherwise(0.5)
    return scores.withColumn("blended", (1 - blend) * F.col(c) + blend * share)


def repetition_penalty(words: DataFrame, key: list[str], word: str = "word", rate: float = 0.16, least: int = 4) -> DataFrame:
    """words with penalty: from the third time on, word triples seen `least` times cost rate x log2(times - 1)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("pos")
    grams = words.withColumn("_g", F.concat_ws("\x01", word, F.lead(word, 1).over(w), F.lead(word, 2).over(w))).withColumn("_full", F.lead(word, 2).over(w).isNotNull())
    g = Window.partitionBy(*key, "_g")
    seen, total = F.row_number().over(g.orderBy("pos")), F.count("*").over(g)
    own = F.when(F.col("_full") & (total >= least) & (seen >= 3), rate * F.log2(seen - 1)).otherwise(0.0)
    marked = grams.withColumn("_p", own)
    return marked.withColumn("penalty", F.max("_p").over(w.rowsBetween(-2, 0))).drop("_g", "_full", "_p")
