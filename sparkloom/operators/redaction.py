"""Numbered, reversible redaction of credentials."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import CREDENTIALS, GENERIC_SECRET

_PATTERNS = [(k, re.compile(p)) for k, p in CREDENTIALS] + [("GENERIC_SECRET", re.compile(GENERIC_SECRET))]


def redact(text: str) -> tuple[str, dict[str, str]]:
    """(text with labels, label to value); labels are numbered per kind by first appearance."""
    labels: dict[tuple[str, str], str] = {}

    def label(kind: str, value: str) -> str:
        n = sum(k == kind for k, _ in labels) + 1
        return labels.setdefault((kind, value), f"[REDACTED:{kind}_{n}]")

    for kind, pattern in _PATTERNS:
        if kind == "GENERIC_SECRET":
            text = pattern.sub(lambda m, k=kind: m[1] + label(k, m[3]) + m[2], text)
        else:
            text = pattern.sub(lambda m, k=kind: label(k, m[0]), text)
    return text, {v: value for (_, value), v in labels.items()}


def restore(text: str, labels: dict[str, str]) -> str:
    return re.sub(r"\[REDACTED:[A-Z_]+_\d+\]", lambda m: labels.get(m[0], m[0]), text)


def redacted(c: Column) -> Column:
    """struct(text, labels map): the map stays with the row, so each text can be restored on its own."""

    @F.pandas_udf("text string, labels map<string,string>")
    def go(texts: pd.Series) -> pd.DataFrame:
        done = [(None, {}) if t is None else redact(t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "labels": [d[1] for d in done]})

    return go(c)


def restored(c: Column, labels: Column) -> Column:
    @F.pandas_udf("string")
    def go(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else restore(t, dict(m or {})) for t, m in zip(texts, maps, strict=True)], dtype=object)

    return go(c, labels)
