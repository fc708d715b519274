"""Licence scan by a positional index of rare tokens.

Each template is a run of words with mandatory key phrases.  The index holds, for every template,
its words of highest inverse document frequency over all templates, with their positions.  A file
looks up only the words that are in the index; a posting (template, position) found at word p votes
for the template to start at ``p - position``.  A start is a match if enough of the template's rare
words agree on it within `SLACK` words and every key phrase stands there word for word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.batches import ALNUM, LOWER, slices, with_text_columns, words
from sparkloom.llm.hashing import word_keys

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base labels: (label, phrase); a place counts where all words stand consecutively.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: The method's own texts, (label, template, key phrases), beside the identifiers below.
DATA = Path(__file__).with_name("licenses.txt")
#: Short identifiers that stand after "SPDX-License-Identifier:", by label.
IDENTIFIERS = (
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("zlib", "Zlib"), ("boost", "BSL-1.0"), ("unlicense", "Unlicense"), ("wtfpl", "WTFPL"),
    ("gpl-2", "GPL-2.0-only"), ("gpl-2", "GPL-2.0-or-later"), ("gpl-3", "GPL-3.0-only"), ("gpl-3", "GPL-3.0-or-later"), ("lgpl-2.1", "LGPL-2.1-only"), ("lgpl-2.1", "LGPL-2.1-or-later"), ("lgpl-3", "LGPL-3.0-only"),
    ("lgpl-3", "LGPL-3.0-or-later"), ("agpl-3", "AGPL-3.0-only"), ("agpl-3", "AGPL-3.0-or-later"), ("mpl-2", "MPL-2.0"), ("epl-2", "EPL-2.0"), ("cc0", "CC0-1.0"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"),
)


def templates() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """(label, template, key phrases) of the data file and of the identifiers."""
    out: list[tuple[str, str, tuple[str, ...]]] = []
    lines = [x for x in DATA.read_text(encoding="utf-8").splitlines() if x and not x.startswith("#")]
    for head, text in zip(lines[::2], lines[1::2], strict=True):
        label, keys = head[1:].split("]", 1)
        out.append((label, text, tuple(k.strip() for k in keys.split(";"))))
    return (*out, *((label, f"SPDX-License-Identifier: {x}", (f"SPDX-License-Identifier: {x}",)) for label, x in IDENTIFIERS))


#: Index words for each template, the share of them that must agree, and how far words may shift.
RARE, AGREE, SLACK = 6, 0.5, 3


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def word_list(text: str) -> list[str]:
    return _WORD.findall(lower_ascii(text))


def _hashes(items: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(items).encode(), np.uint8)
    start, end, _ = words(raw, np.array([0, len(raw)]), ALNUM)
    return word_keys(raw, start, end)


class Index:
    """Postings of the rarest words of each template, looked up by word hash."""

    def __init__(self, base=BASE, own=None, rare: int = RARE):
        self.entries = [(label, word_list(phrase), [word_list(phrase)], True) for label, phrase in base]
        self.entries += [(label, word_list(text), [word_list(k) for k in keys], False) for label, text, keys in (templates() if own is None else own)]
        df = Counter(w for _, text, _, _ in self.entries for w in set(text))
        self.idf = {w: math.log(1 + len(self.entries) / n) for w, n in df.items()}
        postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.votes: list[float] = []
        for t, (_, text, keys, exact) in enumerate(self.entries):
            choice = sorted({w: k for k, w in reversed(list(enumerate(text)))}.items(), key=lambda x: (-self.idf[x[0]], x[1]))
            choice = [x for x in choice if len(x[0]) > 2] or choice  # numbers and particles are everywhere
            chosen = {w for w, _ in choice[: 1 if exact else rare]}
            self.votes.append(sum(self.idf[w] for w in chosen))
            for k, w in enumerate(text):
                if w in chosen:
                    postings[w].append((t, k))
        names = sorted(postings)
        h = _hashes(names) if names else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.names = h[order], [names[k] for k in order]
        self.postings = [postings[n] for n in self.names]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index word) of the words that are in the index."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        where = np.flatnonzero(self.hashes[at] == h)
        return where, at[where]

    def scan(self, tokens, hits: list[tuple[int, int]]):
        """(base places as (label, start), labels of the method, score) of one text; tokens(i, j) gives
        its words i to j, hits are (position, index word)."""
        places, labels, score = set(), set(), 0.0
        starts: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for p, w in hits:
            for t, k in self.postings[w]:
                starts[t][p - k].add(self.names[w])
        for t, found in starts.items():
            label, text, keys, exact = self.entries[t]
            if exact:
                for s in found:
                    if s >= 0 and tokens(s, s + len(text)) == text:
                        places.add((label, s))
                continue
            for s in sorted(found):
                near = set().union(*(found.get(x, ()) for x in range(s - SLACK, s + SLACK + 1)))
                weight = sum(self.idf[w] for w in near) / self.votes[t]
                if weight >= AGREE and weight > score or weight >= AGREE and label not in labels:
                    around = tokens(max(0, s - SLACK), s + len(text) + SLACK)
                    if all(any(around[k : k + len(key)] == key for k in range(len(around))) for key in keys):
                        labels.add(label)
                        score = max(score, weight)
        return places, labels, score


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True, index: Index | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (long), base_labels, labels, score.

    A null text is empty: no words, no places, empty label strings, null first_word and last_word,
    score 0.  A base place scores 1.  Rows are independent, so repeated rows get equal results; an
    empty table gives an empty one; columns named like a result are replaced.
    """
    built = index or Index()

    def make():
        def go(column: pa.Array) -> list[pa.Array]:
            out: list[list] = [[] for _ in range(7)]
            for i, j, data, offsets in slices(column):
                low = LOWER[data]
                start, end, row = words(low, offsets, ALNUM)
                where, which = built.hits(word_keys(low, start, end))
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                raw = low.tobytes()
                by_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for p, w in zip(where.tolist(), which.tolist(), strict=True):
                    by_row[int(row[p])].append((p - int(bounds[row[p]]), w))
                for r in range(j - i):
                    n = int(bounds[r + 1] - bounds[r])
                    first = int(bounds[r])

                    def tokens(a, b, first=first, n=n):
                        return [raw[start[first + x] : end[first + x]].decode() for x in range(a, min(b, n))]

                    places, labels, score = built.scan(tokens, by_row[r]) if r in by_row else ((), (), 0.0)
                    at = [s for _, s in places]
                    base = {x for x, _ in places}
                    for x, v in zip(out, (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(labels))), 1.0 if base else min(1.0, score)), strict=True):
                        x.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return [pa.array(x, t) for x, t in zip(out, types, strict=True)]

        return go

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return with_text_columns(docs, text_col, schema, make, keep_text)
