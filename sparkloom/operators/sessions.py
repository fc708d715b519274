"""Cross-turn deduplication inside a session, and the state of a refetch guard.

A later output may refer to lines of an earlier one as it was shown.  What is shown depends on what was
replaced before, so a session is worked through in order; sessions are independent, and a session
keeps the lines of its last ``MAX_AGE`` outputs only.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least lines and non-blank characters of a reference, candidates, age, shortest text.
MIN_RUN, MIN_CHARS, MAX_CANDIDATES, MAX_AGE, MIN_LEN = 2, 40, 256, 100, 48
_LINES = re.compile(r"^\[sl: lines (\d+)-(\d+) as in #(\d+)\]$")
_WHOLE = re.compile(r"^\[sl: same as #(\d+)\]$")


class Session:
    """Shown outputs by number, and where each of their lines stands."""

    def __init__(self, age: int = MAX_AGE):
        self.age, self.n = age, 0
        self.shown: dict[int, list[str]] = {}
        self.where: dict[str, deque[tuple[int, int]]] = defaultdict(deque)
        self.whole: dict[str, int] = {}

    def add(self, shown: str) -> int:
        """Number an output and make its lines referable; outputs that are too old leave."""
        self.n += 1
        lines = shown.split("\n")
        self.shown[self.n] = lines
        self.whole[shown] = self.n
        if lines[0].strip():  # readers may trim the ends of an output, which would shift its numbers
            for j, line in enumerate(lines):
                if len(line.strip()) >= 4 and any(c.isalnum() for c in line) and not _LINES.match(line) and not (j == 0 and line[:1].isspace()):
                    self.where[line].append((self.n, j))
        old = self.shown.pop(self.n - self.age, None)
        for line in set(old or ()):
            places = self.where.get(line)
            while places and places[0][0] <= self.n - self.age:
                places.popleft()
            if places is not None and not places:
                del self.where[line]
        return self.n

    def reset(self) -> None:
        """Nothing earlier may be referred to any more; the numbering goes on."""
        self.shown.clear()
        self.where.clear()
        self.whole.clear()

    def _longest(self, lines: list[str], i: int) -> tuple[int, int, int]:
        """(length, output, first line) of the longest equal run; the newest output wins ties."""
        best = (0, 0, 0)
        places = self.where.get(lines[i], ())
        for k, j in list(places)[-MAX_CANDIDATES:]:
            source, n = self.shown[k], 0
            while i + n < len(lines) and j + n < len(source) and lines[i + n] == source[j + n] and not source[j + n].startswith("[sl: "):
                n += 1
            if (n, k, -j) > (best[0], best[1], -best[2]):
                best = (n, k, j)
        return best

    def process(self, text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
        """(shown text, references as (output, first line, last line, position)); the text is registered."""
        shown, refs = text, []
        lines = text.split("\n")
        if len(text) >= MIN_LEN and not any(x.startswith("[sl: ") for x in lines):
            k = self.whole.get(text)
            if k in self.shown:
                shown, refs = f"[sl: same as #{k}]", [(k, 1, len(lines), 0)]
            else:
                out, i = [], 0
                while i < len(lines):
                    n, k, j = self._longest(lines, i)
                    mark = f"[sl: lines {j + 1}-{j + n} as in #{k}]"
                    run = lines[i : i + n]
                    if n >= MIN_RUN and sum(len(x.strip()) for x in run) >= MIN_CHARS and len("\n".join(run)) > len(mark) + 16:
                        refs.append((k, j + 1, j + n, i))
                        out.append(mark)
                        i += n
                    else:
                        out.append(lines[i])
                        i += 1
                shown = "\n".join(out)
        self.add(shown)
        return shown, refs


def expand(shown: Iterable[str]) -> list[str]:
    """The original texts of a session's shown outputs, in order."""
    kept: dict[int, list[str]] = {}
    out = []
    for n, text in enumerate(shown, 1):
        kept[n] = text.split("\n")
        m = _WHOLE.match(text)
        source = kept[int(m[1])] if m and int(m[1]) < n else kept[n]
        lines: list[str] = []
        for x in source:
            r = _LINES.match(x)
            lines += kept[int(r[3])][int(r[1]) - 1 : int(r[2])] if r and int(r[3]) < n else [x]
        out.append("\n".join(lines))
    return out


def dedup_sessions(turns: DataFrame, session: str, seq: str, text: str = "text") -> DataFrame:
    """(session, seq, shown, saved, refs, exact) of every turn; null texts are shown as they are.

    One task works through a whole session, which is sequential by nature; its memory is bounded by
    MAX_AGE outputs and by the session's own rows.
    """
    types = dict(turns.dtypes)
    schema = f"{session} {types[session]}, {seq} {types[seq]}, shown string, saved long, refs array<struct<output:int, first:int, last:int, at:int>>, exact boolean"

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq, kind="stable")
        state = Session()
        done = [(None, []) if t is None else state.process(t) for t in rows[text]]
        back = iter(expand([s for s, _ in done if s is not None]))
        return pd.DataFrame(
            {
                session: rows[session], seq: rows[seq], "shown": [s for s, _ in done],
                "saved": [0 if s is None else len(t) - len(s) for t, (s, _) in zip(rows[text], done, strict=True)],
                "refs": [[{"output": k, "first": a, "last": b, "at": i} for k, a, b, i in r] for _, r in done],
                "exact": [s is None or next(back) == t for t, (s, _) in zip(rows[text], done, strict=True)],
            }
        )

    return turns.select(session, seq, text).groupBy(session).applyInPandas(go, schema)


class Guard:
    """A command asked for again within `window` calls trips a hold of `hold` calls."""

    def __init__(self, window: int = 3, hold: int = 10):
        self.window, self.hold, self.calls, self.until = window, hold, 0, 0
        self.last: dict[str, int] = {}

    def observe(self, key: str) -> bool:
        """Is the session on hold at this call?"""
        self.calls += 1
        before = self.last.get(key)
        if before is not None and self.calls - before <= self.window:
            self.until = self.calls + self.hold
        self.last[key] = self.calls
        self.last = {k: n for k, n in self.last.items() if self.calls - n <= self.window}
        return self.calls <= self.until


def guard_sessions(calls: DataFrame, session: str, seq: str, key: str, window: int = 3, hold: int = 10) -> DataFrame:
    """(session, seq, held) of every call: Guard over whole sessions, as windows."""
    number = F.row_number().over(Window.partitionBy(session).orderBy(seq))
    rows = calls.select(session, seq, key).withColumn("_n", number)
    again = F.col("_n") - F.lag("_n").over(Window.partitionBy(session, key).orderBy("_n")) <= window
    rows = rows.withColumn("_trip", F.coalesce(again, F.lit(False)))
    held = F.max("_trip").over(Window.partitionBy(session).orderBy("_n").rowsBetween(-hold, 0))
    return rows.select(session, seq, held.alias("held"))


def overlap_trim(docs: DataFrame, group: str, order: str, text: str = "text", least: int = 60, look: int = 600) -> DataFrame:
    """(group, order, trimmed): a chunk that begins with the end of an earlier chunk of its group loses
    that part; chunks equal but for white space are empty from the second on."""
    types = dict(docs.dtypes)

    def cut(chunk: str, tails: dict[str, list[str]]) -> str:
        best = 0
        for tail in tails.get(chunk[:40], ()) if len(chunk) >= 20 else ():
            at = tail.find(chunk[:40])
            n = len(tail) - at
            if n >= least and n > best and chunk.startswith(tail[at:]):
                best = n
        return chunk[best:].lstrip() if best else chunk

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        seen, out = set(), []
        heads = {(t or "")[:40] for t in rows[text]}
        tails: dict[str, list[str]] = defaultdict(list)
        for t in rows[text]:
            norm = " ".join((t or "").split())
            if not norm or norm in seen:
                out.append("")
                continue
            seen.add(norm)
            out.append(cut(t, tails))
            tail = t[-look:]
            for i in range(len(tail) - 39):  # only the heads that some chunk has are indexed
                if tail[i : i + 40] in heads:
                    tails[tail[i : i + 40]].append(tail)
        return pd.DataFrame({group: rows[group], order: rows[order], "trimmed": out})

    return docs.select(group, order, text).groupBy(group).applyInPandas(go, f"{group} {types[group]}, {order} {types[order]}, trimmed string")
