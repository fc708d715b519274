"""Language identification by n-gram filters that hold a bit for each language.

A Bloom filter whose cells are bit masks over languages is all languages' filters in bit-sliced
form: one probe of an n-gram reads `hashes` cells and their conjunction is the set of languages
that contain it.  A document's n-grams are counted per language and each count is corrected for the
share of n-grams that the language's filter lets through by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import SLICE, flat, slices, with_text_columns
from sparkloom.llm.hashing import U64, mix
from sparkloom.llm.store import bounded_batches

#: Cells of a filter (a power of two), probes per n-gram, bytes of an n-gram.
CELLS, HASHES, GRAM = 1 << 20, 3, 4
#: Training rows per language at most (the bound of the fitting sample) and the times that an n-gram
#: must be seen in a language.
SAMPLE, LEAST = 1500, 3
UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: Upper-case ASCII letters are lower-cased; digits, ASCII punctuation and spaces are all one byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram value, row) of every n-gram within a row, with a blank before and after it; those that
    begin with two blanks are left out.  A row of two bytes has one n-gram, an empty row none."""
    sizes = np.diff(offsets)
    first = offsets[:-1] + 2 * np.arange(len(sizes))
    low = np.full(len(data) + 2 * len(sizes), 32, np.uint32)
    low[np.arange(len(data)) + np.repeat(first + 1 - offsets[:-1], sizes)] = _FOLD[data]
    offsets = np.r_[first, len(low)]
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = low[:n].copy()
    for k in range(1, GRAM):
        g = (g << np.uint32(8)) | low[k : k + n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    keep = (np.arange(n) + GRAM <= ends) & ((g >> np.uint32(16)) != 0x2020)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    return g[keep], row[keep]


def cells_of(g: np.ndarray, cells: int, hashes: int) -> list[np.ndarray]:
    """The cells of each n-gram, from disjoint bits of one hash."""
    h = mix(g.astype(U64) * U64(0x9E3779B97F4A7C15))
    bits = cells.bit_length() - 1
    return [((h >> U64(bits * k)) & U64(cells - 1)).astype(np.int64) for k in range(hashes)]


class LanguageFilter:
    """masks: one word of 64 language bits for each cell and slice; learned from n-grams by language."""

    def __init__(self, languages: list[str], found: list[np.ndarray], cells: int = CELLS, hashes: int = HASHES):
        self.languages, self.cells, self.hashes = languages, cells, hashes
        self.masks = np.zeros(((len(languages) + 63) // 64, cells), U64)
        for lang, g in enumerate(found):
            for at in cells_of(g, cells, hashes):
                self.masks[lang // 64, at] |= U64(1 << lang % 64)
        fill = np.array([((self.masks[k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))])
        self.chance = fill**hashes

    def counts(self, g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): n-grams that each language's filter contains."""
        at = cells_of(g, self.cells, self.hashes)
        out = np.zeros((rows, len(self.languages)), np.int64)
        for s, masks in enumerate(self.masks):
            hit = masks[at[0]]
            for a in at[1:]:
                hit &= masks[a]
            for k in range(64 * s, min(len(self.languages), 64 * s + 64)):
                out[:, k] = np.bincount(row[((hit >> U64(k % 64)) & U64(1)).astype(bool)], minlength=rows)
        return out

    def decide(self, g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score 0 to 1) by counts corrected for false positives."""
        total = np.bincount(row, minlength=rows)[:, None]
        true = np.clip((self.counts(g, row, rows) - total * self.chance) / np.maximum(1 - self.chance, 1e-9), 0, None)
        share = true / np.maximum(total, 1)
        best = share.argmax(axis=1) if len(self.languages) else np.zeros(rows, int)
        return best, np.minimum(share[np.arange(rows), best], 1.0) if len(self.languages) else np.zeros(rows)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, least: int = LEAST, held_out: bool = True) -> LanguageFilter:
    """Learn from labelled rows: about `sample` documents of each language, chosen by a hash of the id.

    With held_out, rows whose crc32(id as text) mod 3 is 1 are never learned from.  The sample bounds
    what reaches the driver: the n-grams seen `least` times in it.
    """
    known = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id is not null and lang is not null")
    if held_out:
        known = known.where("crc32(id) % 3 != 1")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return LanguageFilter([], [])
    bounded_batches(docs.sparkSession)
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = known.where(F.xxhash64("id") / F.lit(2.0**64) + 0.5 <= rate[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = flat(batch.column(1))
            sizes = np.diff(offsets)
            for lang in sorted(set(langs)):
                rows = [k for k, x in enumerate(langs) if x == lang]
                while rows:
                    n = max(1, int(np.searchsorted(np.cumsum(sizes[rows]), SLICE)))
                    parts = [data[offsets[k] : offsets[k + 1]] for k in rows[:n]]
                    rows = rows[n:]
                    g, _ = grams(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
                    values, times = np.unique(g, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    seen = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "gram")
    table = seen.toArrow()
    langs = sorted(sizes)
    where = np.array(table.column("lang").to_pylist(), dtype=object)
    values = table.column("gram").to_numpy().astype(np.uint32)
    return LanguageFilter(langs, [values[where == lang] for lang in langs])


def identify(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred string and score double.

    Texts that are null or have no letter are `und` with score 0, as are all texts where nothing was
    learned.  Where languages tie, also where no n-gram is known (score 0), the first of them by name
    is taken.  Only the text is looked at, the whole of it; equal texts get equal results; an empty
    table gives an empty one; columns named like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x 8 bytes for each 64 languages

    def make():
        model = shared.value

        def go(column: pa.Array) -> list[pa.Array]:
            langs, scores = [], []
            for i, j, data, offsets in slices(column):
                g, row = grams(data, offsets)
                best, score = model.decide(g, row, j - i)
                raw = data.tobytes()
                for k in range(j - i):
                    text = raw[offsets[k] : offsets[k + 1]]
                    known = model.languages and _LETTER.search(text.decode())
                    langs.append(model.languages[best[k]] if known else UND)
                    scores.append(float(score[k]) if known else 0.0)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return go

    return with_text_columns(docs, text_col, "lang_pred string, score double", make, keep_text)
