"""Structured Streaming: sessions with state, first writes, windows with late data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.sessions import Guard, Session


def dedup_stream(turns: DataFrame, session: str = "session", seq: str = "seq", text: str = "text") -> DataFrame:
    """(session, seq, shown, saved): each turn deduplicated against the session's earlier ones.

    The state is the session's last outputs, bounded by the age limit.  A row whose text is null is a
    control row: it resets what may be referred to.
    """
    types = dict(turns.dtypes)

    def go(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else Session()
        rows = pd.concat(list(parts)).sort_values(seq, kind="stable")
        shown, saved = [], []
        for t in rows[text]:
            if t is None:
                held.reset()
            s = None if t is None else held.process(t)[0]
            shown.append(s)
            saved.append(0 if t is None else len(t) - len(s))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame({session: key[0], seq: rows[seq], "shown": shown, "saved": saved})

    return turns.groupBy(session).applyInPandasWithState(go, f"{session} {types[session]}, {seq} {types[seq]}, shown string, saved long", "held binary", "append", GroupStateTimeout.NoTimeout)


def guard_stream(calls: DataFrame, session: str = "session", seq: str = "seq", key: str = "key") -> DataFrame:
    """(session, seq, held): the refetch guard over a stream of calls."""
    types = dict(calls.dtypes)

    def go(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = pickle.loads(state.get[0]) if state.exists else Guard()
        rows = pd.concat(list(parts)).sort_values(seq, kind="stable")
        held = [guard.observe(k) for k in rows[key]]
        state.update((pickle.dumps(guard),))
        yield pd.DataFrame({session: group[0], seq: rows[seq], "held": held})

    return calls.groupBy(session).applyInPandasWithState(go, f"{session} {types[session]}, {seq} {types[seq]}, held boolean", "guard binary", "append", GroupStateTimeout.NoTimeout)


def first_writes(rows: DataFrame, key: str, t: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped when the watermark has passed."""
    return rows.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, t: str, group: str, value: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Count and sum per window and group; rows later than `delay` are left out."""
    timed = events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, delay)
    out = timed.groupBy(F.window(t, size), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), group, "n", "total")


def session_windows(events: DataFrame, t: str, user: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    timed = events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, delay)
    out = timed.groupBy(F.session_window(t, gap), user).agg(F.count("*").alias("events"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
