"""Lossy digests of structured tool output; the original is kept by its digest key.

Every rule returns its input where the shape does not fit.  The rules are chained, and the result is
used only if it saves ``GAIN`` of a text of ``LEAST`` characters.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least length and least gain of a digest.
LEAST, GAIN = 1500, 0.40
#: Arrays of this many records are sampled, of this many numbers summed up.
RECORDS, NUMBERS = 100, 32


def _json(text: str):
    try:
        return json.loads(text) if text[:1] in "[{" else None
    except (ValueError, RecursionError):
        return None


def _walk(x, change):
    """x with change() applied to every container, outermost first; None keeps a container."""
    new = change(x)
    if new is not None:
        return new
    if isinstance(x, list):
        return [_walk(y, change) for y in x]
    return {k: _walk(v, change) for k, v in x.items()} if isinstance(x, dict) else x


def _rewrite(text: str, change) -> str:
    value = _json(text)
    if value is None:
        return text
    new = json.dumps(_walk(value, change), ensure_ascii=False, separators=(",", ":"))
    return new if len(new) < len(text) else text


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def numeric_arrays(text: str) -> str:
    """Arrays of 32 numbers or more as their count, bounds and first four."""

    def change(x):
        if isinstance(x, list) and len(x) >= NUMBERS and all(map(_is_number, x)):
            return {"numbers": len(x), "min": min(x), "max": max(x), "first": x[:4]}

    return _rewrite(text, change)


def column_stats(rows: list[dict]) -> dict[str, dict[str, float]]:
    """mean, variance, min and max of the numeric fields that 90 % of the records have, with 3 values."""
    out = {}
    for key in dict.fromkeys(k for r in rows for k in r):
        v = [r[key] for r in rows if _is_number(r.get(key))]
        if len(v) >= 0.9 * len(rows) and len(set(v)) >= 3:
            mean = sum(v) / len(v)
            out[key] = {"mean": mean, "var": sum((x - mean) ** 2 for x in v) / len(v), "min": min(v), "max": max(v)}
    return out


def sample_arrays(text: str) -> str:
    """Arrays of 100 records or more: the first and last three, records of other keys, errors, and
    values three deviations off; the rest is counted."""

    def change(x):
        if not (isinstance(x, list) and len(x) >= RECORDS and all(isinstance(r, dict) for r in x)):
            return None
        shape = Counter(tuple(sorted(r)) for r in x).most_common(1)[0][0]
        stats = column_stats(x)

        def odd(r):
            far = any(_is_number(r.get(k)) and s["var"] > 0 and abs(r[k] - s["mean"]) > 3 * math.sqrt(s["var"]) for k, s in stats.items())
            return far or tuple(sorted(r)) != shape or any(re.search(r"(?i)error|fail", str(v)) for v in r.values())

        kept = [r for i, r in enumerate(x) if i < 3 or i >= len(x) - 3 or odd(r)]
        return {"records": len(x), "shown": kept, "stats": stats}

    return _rewrite(text, change)


_VERSION = re.compile(r'^([-+ ])\s*"?((?:node_modules/)?[@\w][\w./@-]*)"?(?:==|: *\{? *"?(?:version"?: *"?)?| = "?)v?(\d[\w.+-]*)"?')


def lockfile_changes(text: str) -> str:
    """The diff of a lock file as versions added, removed and changed."""
    if not re.search(r"(?m)^(?:diff --git|\+\+\+) .*(?:lock|requirements)", text):
        return text
    sides: dict[str, dict[str, str]] = {"+": {}, "-": {}}
    for line in text.split("\n"):
        m = _VERSION.match(line)
        if m and m[1] in sides:
            sides[m[1]][m[2]] = m[3]
    old, new = sides["-"], sides["+"]
    rows = [f"~ {k} {old[k]} -> {new[k]}" for k in sorted(old.keys() & new.keys()) if old[k] != new[k]]
    rows += [f"+ {k} {new[k]}" for k in sorted(new.keys() - old.keys())] + [f"- {k} {old[k]}" for k in sorted(old.keys() - new.keys())]
    return "\n".join(["[lock file changes]", *rows]) if rows else text


def html_traceback(text: str) -> str:
    """The plain traceback of an HTML error page."""
    if "<" not in text or "Traceback" not in text:
        return text
    m = re.search(r"(?s)<(textarea|pre)[^>]*>([^<]*Traceback \(most recent call last\).*?)</\1>", text)
    return html.unescape(m[2]).strip() if m else text


def registry_summary(text: str) -> str:
    """Package metadata of a registry: name, latest versions, dependencies."""
    x = _json(text)
    if isinstance(x, dict) and isinstance(x.get("versions"), dict) and "dist-tags" in x:
        latest = x["dist-tags"].get("latest")
        meta = x["versions"].get(latest, {})
        return json.dumps({"name": x.get("name"), "latest": latest, "versions": len(x["versions"]), "last": list(x["versions"])[-5:], "dependencies": meta.get("dependencies", {})}, ensure_ascii=False)
    if isinstance(x, dict) and isinstance(x.get("info"), dict) and isinstance(x.get("releases"), dict):
        info = x["info"]
        return json.dumps({"name": info.get("name"), "latest": info.get("version"), "releases": len(x["releases"]), "last": list(x["releases"])[-5:], "requires": info.get("requires_dist")}, ensure_ascii=False)
    return text


def stub_last_applied(text: str) -> str:
    """The copy of a resource that its own annotation holds, as a stub."""

    def change(x):
        key = next((k for k in x if k.endswith("/last-applied-configuration")), None) if isinstance(x, dict) else None
        if key and isinstance(x[key], str) and len(x[key]) > 100:
            return {**{k: _walk(v, change) for k, v in x.items() if k != key}, key: f"<{len(x[key])} characters>"}

    if "last-applied-configuration" not in text:
        return text
    if _json(text) is not None:
        return _rewrite(text, change)
    pattern = r"(?m)^( *)([\w./-]*last-applied-configuration): *(?:\|-?\n(?:\1 +.*\n?)+|.{100,}$)"
    return re.sub(pattern, lambda m: f"{m[1]}{m[2]}: <{len(m[0])} characters>" + "\n" * m[0].endswith("\n"), text)


def plan_changes(text: str) -> str:
    """An infrastructure plan: resources that change, with the attributes that do."""
    x = _json(text)
    if not isinstance(x, dict) or not isinstance(x.get("resource_changes"), list):
        return text
    out = []
    for r in x["resource_changes"]:
        c = r.get("change") or {}
        if c.get("actions") in (["no-op"], ["read"], None):
            continue
        before, after = c.get("before") or {}, c.get("after") or {}
        out.append({"address": r.get("address"), "actions": c["actions"], "changed": {k: [before.get(k), after.get(k)] for k in sorted({*before, *after}) if before.get(k) != after.get(k)}})
    return json.dumps({"resource_changes": out}, ensure_ascii=False, separators=(",", ":"))


_SYSTEM = re.compile(r'^# \d+ "(/usr/|/opt/|<)[^"]*"')


def drop_system_regions(text: str) -> str:
    """Preprocessed source without what stands between system line marks."""
    lines, out, dropped = text.split("\n"), [], 0
    if sum(bool(re.match(r'^# \d+ "', x)) for x in lines) < 3:
        return text
    inside = False
    for line in [*lines, '# 0 ""']:
        if re.match(r'^# \d+ "', line):
            inside = bool(_SYSTEM.match(line))
            if not inside and dropped:
                out.append(f"[… {dropped} system lines …]")
                dropped = 0
        if inside:
            dropped += 1
        else:
            out.append(line)
    return "\n".join(out[:-1])


def cap_candidates(text: str, most: int = 3) -> str:
    """The first notes of each run of compiler candidates."""
    out, run, cut = [], 0, 0
    for line in text.split("\n"):
        if re.search(r"\bnote: (?:candidate|  candidate)", line):
            run += 1
            if run > most:
                cut += 1
                continue
        elif not line.startswith((" ", "\t")):
            if cut:
                out.append(f"[… {cut} more candidates …]")
            run = cut = 0
        elif run > most:
            continue
        out.append(line)
    return "\n".join([*out, f"[… {cut} more candidates …]"] if cut else out)


def strip_echo(text: str) -> str:
    """Compiler output without the source lines and carets below each message."""
    out = [line for line in text.split("\n") if not re.match(r"^\s*\d*\s*\|(?:\s|$)|^\s*[~^]+\s*$", line)]
    return "\n".join(out) if len(out) < text.count("\n") + 1 else text


_STEP = re.compile(r"\b(?:step|iter(?:ation)?|epoch)\b\D{0,3}(\d+).*?\bloss\b\D{0,3}(\d+(?:\.\d+)?)", re.I)


def decimate_steps(text: str, width: int = 16) -> str:
    """Training logs: first and last steps, the three best and worst, and those three deviations off
    the 16 before."""
    lines = text.split("\n")
    steps = [(i, float(m[2])) for i, x in enumerate(lines) if (m := _STEP.search(x))]
    if len(steps) < 3 * width:
        return text
    by_loss = sorted(range(len(steps)), key=lambda k: (steps[k][1], k))
    keep = {*range(3), *range(len(steps) - 3, len(steps)), *by_loss[:3], *by_loss[-3:]}
    for k in range(width, len(steps)):
        v = [x for _, x in steps[k - width : k]]
        mean = sum(v) / width
        if abs(steps[k][1] - mean) > 3 * math.sqrt(sum((x - mean) ** 2 for x in v) / width):
            keep.add(k)
    gone = {i for k, (i, _) in enumerate(steps) if k not in keep}
    out, n = [], 0
    for i, line in enumerate([*lines, None]):
        if i in gone:
            n += 1
            continue
        if n:
            out.append(f"[… {n} steps …]")
            n = 0
        if line is not None:
            out.append(line)
    return "\n".join(out)


RULES = (lockfile_changes, cap_candidates, drop_system_regions, strip_echo, html_traceback, registry_summary, sample_arrays, numeric_arrays, stub_last_applied, plan_changes, decimate_steps)


def digest(text: str) -> tuple[str, list[str]]:
    """(digest, rules that changed it), or the text itself where the gain is too small."""
    if len(text) < LEAST:
        return text, []
    out, fired = text, []
    for rule in RULES:
        try:
            new = rule(out)
        except (ValueError, TypeError, KeyError, AttributeError, IndexError):
            continue
        if len(new) < len(out):
            out, fired = new, [*fired, rule.__name__]
    return (out, fired) if len(out) <= (1 - GAIN) * len(text) else (text, [])


def digested(c: Column) -> Column:
    """struct(text, rules)."""

    @F.pandas_udf("text string, rules array<string>")
    def go(texts: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else digest(t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "rules": [d[1] for d in done]})

    return go.asNondeterministic()(c)


def recovery_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text): one row per distinct text under the first 12 digits of its digest."""
    return docs.select(F.substring(F.sha2(text_col, 256), 1, 12).alias("key"), F.sha2(text_col, 256).alias("sha256"), F.col(text_col).alias("text")).where("text is not null").dropDuplicates(["sha256"])
