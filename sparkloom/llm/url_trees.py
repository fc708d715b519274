"""URL filter: longest-match rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import with_text_columns
from sparkloom.llm.store import materialize, release

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees learn from, at most; trees, their depth, rate and histogram bins.
SAMPLE, TREES, DEPTH, RATE, BINS = 20_000, 40, 3, 0.2, 32
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a url without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[cut:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:cut].translate(_LOWER), tail[:stop]


class Rules:
    """Rules by host; a url asks for its host and each parent domain."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for host, path, verdict in rules:
            self.by_host[host].append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        best = (-1, "", None)
        labels = host.split(".")
        for k in range(len(labels)):
            domain = ".".join(labels[k:])
            for prefix, verdict in self.by_host.get(domain, ()):
                if path.startswith(prefix) and (n := len(domain) + len(prefix)) > best[0]:
                    best = (n, domain + prefix, verdict)
        return (best[1], best[2]) if best[0] >= 0 else (None, None)


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


class SuffixRates:
    """Smoothed share of blocked urls for the last label and the last two labels of a host."""

    def __init__(self, hosts: list[str], labels: np.ndarray, weight: float = 10.0):
        self.prior = float(labels.mean()) if len(labels) else 0.0
        total: Counter = Counter()
        bad: Counter = Counter()
        for host, y in zip(hosts, labels, strict=True):
            for s in self.suffixes(host):
                total[s] += 1
                bad[s] += int(y)
        self.rate = {s: (bad[s] + weight * self.prior) / (n + weight) for s, n in total.items()}

    @staticmethod
    def suffixes(host: str) -> tuple[str, str]:
        labels = host.split(".")
        return labels[-1], "." + ".".join(labels[-2:])

    def of(self, host: str) -> list[float]:
        return [self.rate.get(s, self.prior) for s in self.suffixes(host)]


def features(url: str | None, host: str, path: str, rates: SuffixRates) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    first = path.split("/")[1] if path.count("/") > 1 else ""
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), digits / max(1, len(url)), entropy(host), entropy(path),
        query.count("&") + bool(query), url.count("-"), float("#" in url), float(url.startswith("https:")), len(first), float(sum(map(ord, first)) % 97), *rates.of(host),
    ]


def matrix(urls: list[str | None], parts: list[tuple[str, str]], rates: SuffixRates) -> np.ndarray:
    """(urls, features), also for no urls."""
    rows = [features(u, h, p, rates) for u, (h, p) in zip(urls, parts, strict=True)]
    return np.array(rows, float) if rows else np.zeros((0, len(features("", "", "", rates))))


class Trees:
    """Boosted regression trees for the logistic loss, on histograms of each feature."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.shape, self.rate, self.bins = (trees, depth), rate, bins
        self.start, self.edges, self.nodes = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cells = self._bin(x)
        score = np.full(len(y), self.start)
        trees, depth = self.shape
        for _ in range(trees):
            g, h = 1 / (1 + np.exp(-score)) - y, None
            p = g + y
            h = np.maximum(p * (1 - p), 1e-6)
            node, value, split = np.zeros(len(y), int), np.zeros(2 ** (depth + 1) - 1), np.full((2**depth - 1, 2), -1)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    inside = np.flatnonzero(node == k)
                    if len(inside) < 10:
                        continue
                    gain, f, cut = self._best(cells[inside], g[inside], h[inside])
                    if gain > 1e-6:
                        split[k] = f, cut
                        node[inside] = 2 * k + 1 + (cells[inside, f] > cut)
            for k in np.unique(node):
                inside = node == k
                value[k] = -self.rate * g[inside].sum() / (h[inside].sum() + 1.0)
            self.nodes.append((split, value))
            score += value[node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _best(self, cells, g, h):
        best = (0.0, -1, -1)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(cells.shape[1]):
            gs, hs = np.bincount(cells[:, f], g, self.bins).cumsum(), np.bincount(cells[:, f], h, self.bins).cumsum()
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - whole
            k = int(gain[:-1].argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of block for each row."""
        score = np.full(len(x), self.start)
        if self.nodes and len(x):
            cells = self._bin(x)
            for split, value in self.nodes:
                node = np.zeros(len(x), int)
                for _ in range(self.shape[1]):
                    inner = node < len(split)
                    f, cut = split[np.where(inner, node, 0)].T
                    go = inner & (f >= 0)
                    node = np.where(go, 2 * node + 1 + (cells[np.arange(len(x)), np.maximum(f, 0)] > cut), node)
                score += value[node]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    def __init__(self, urls: list[str | None], labels: list[int]):
        y = np.array(labels, float)
        parts = [split_url(u) for u in urls]
        self.rates = SuffixRates([h for h, _ in parts], y)
        self.trees = Trees().fit(matrix(urls, parts, self.rates), y)

    def block(self, urls: list[str | None], parts: list[tuple[str, str]]) -> np.ndarray:
        return self.trees.predict(matrix(urls, parts, self.rates))


def labelled_sample(pages: DataFrame, url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """About `sample` distinct urls at most that a rule decides (1: block), chosen by a hash of the url
    among all such urls, so neither frequent urls nor those without a rule change the bound."""
    held = Rules(rules)

    def label(batches):
        for batch in batches:
            urls = batch.column(0).to_pylist()
            verdicts = [held.match(*split_url(u))[1] for u in urls]
            keep = [k for k, v in enumerate(verdicts) if v]
            yield pa.record_batch([pa.array([urls[k] for k in keep], pa.string()), pa.array([int(verdicts[k] == "block") for k in keep], pa.int32())], names=["url", "label"])

    rows = pages.select(F.col(f"`{url_col}`").alias("url")).where("url is not null").distinct()
    labelled = materialize(rows.mapInArrow(label, "url string, label int"), "labelled")
    n = max(1, labelled.count())
    place = (F.xxhash64("url") / F.lit(2.0**64)) + 0.5  # evenly in 0 to 1
    chosen = labelled.where(place <= min(1.0, sample / n)).toArrow().sort_by("url")
    release(labelled)
    return chosen.column("url").to_pylist(), chosen.column("label").to_pylist()


def judge(pages: DataFrame, model: UrlModel, *, url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (the trees' probability of block).

    A null url or one without :// has an empty host and path and, as no rule fits it, the trees'
    verdict.  Equal urls get equal verdicts, urls of any length are judged whole; an empty table gives an empty one; other columns pass
    through, those named like a result are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model, Rules(rules)))  # fixed size: trees, and suffixes of the sample

    def make():
        model, held = shared.value

        def go(column: pa.Array) -> list[pa.Array]:
            urls = column.to_pylist()
            parts = [split_url(u) for u in urls]
            score = model.block(urls, parts)
            found = [held.match(*p) for p in parts]
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, score, strict=True)]
            return [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]

        return go

    return with_text_columns(pages, url_col, "host string, path string, rule string, verdict string, score double", make)
