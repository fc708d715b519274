"""Quality rules: counts of repetition and noise, and bands of zstandard compression ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sparkloom.llm.batches import SPACED, slices, with_text_columns, words
from sparkloom.llm.hashing import U64, mix, word_keys
from sparkloom.llm.shingles import combine

#: (least bytes, lowest ratio, highest ratio) of whole documents and of the last part of one: the least and
#: the largest ratio measured on clean documents of each length (those of the 0.1 test table that pass the
#: base rules with at most 0.1 symbols a word), less about 10 % and plus about 5 %.
BANDS = (
    (0, 0.0, 4.0), (128, 1.0, 4.0), (192, 1.1, 4.0), (256, 1.2, 1.8), (384, 1.28, 1.8), (512, 1.32, 2.0), (768, 1.42, 2.12),
    (1024, 1.52, 2.32), (2048, 1.7, 2.35), (4096, 1.85, 2.55), (16384, 1.95, 2.62), (65536, 1.95, 3.0),
)
#: Ratios of fixed chunks, measured 1.66 to 2.02; the last, shorter one has the band of its length.  A document
#: fails if more than CHUNK_SHARE of its chunks lie outside.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 1024, (1.5, 2.12), 0.25
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_window_words(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Per row, the words that lie in a k-word window found twice or more in it."""
    if len(h) < k:
        return np.zeros(rows, np.int64)
    with np.errstate(over="ignore"):
        key = mix(combine(h, k) + row[: len(h) - k + 1].astype(U64) * U64(0x9E3779B97F4A7C15))
    inside = np.flatnonzero(row[k - 1 :] == row[: len(h) - k + 1])
    _, inverse, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    start = inside[count[inverse] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + k, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=rows)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def _band(n: int, bands) -> tuple[float, float]:
    return next((b[1], b[2]) for b in reversed(bands) if n >= b[0])


def compression_verdict(raw: bytes, compressor, bands=BANDS) -> tuple[bool, float, float]:
    """(inside the bands, ratio of the whole, share of chunks outside)."""
    if not raw:
        return False, 0.0, 0.0
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = _band(len(raw), bands)
    odd = chunks = 0
    for i in range(0, len(raw), CHUNK_BYTES):
        piece = raw[i : i + CHUNK_BYTES]
        least, most = CHUNK_BAND if len(piece) == CHUNK_BYTES else _band(len(piece), bands)
        part = ratio if len(piece) == len(raw) else len(piece) / len(compressor.compress(piece))
        odd += not least <= part <= most
        chunks += 1
    share = odd / chunks
    return low <= ratio <= high and share <= CHUNK_SHARE, ratio, share


def quality(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True, bands=BANDS, level: int = 3) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), ratio and odd_chunks (double).

    A null text counts as empty: it has no words, so it fails the base rules.  Every row is judged on
    its own whole text, so ties and repeated rows get equal results; an empty table gives an empty
    one; columns named like a result are replaced.
    """

    def make():
        compressor = zstandard.ZstdCompressor(level=level)

        def go(column: pa.Array) -> list[pa.Array]:
            out: list[list] = [[] for _ in range(9)]
            for i, j, data, offsets in slices(column):
                rows = j - i
                start, end, row = words(data, offsets, SPACED)
                h = word_keys(data, start, end)
                n = np.bincount(row, minlength=rows)
                repeat = repeated_window_words(h, row, rows, 5)
                chars = _sums(SPACED[data] & ((data & 0xC0) != 0x80), offsets)
                failed = (n < 10) | (100 * repeat > 20 * n)
                buffer = data.tobytes()
                raws = [buffer[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                verdicts = [compression_verdict(raw, compressor, bands) for raw in raws]
                for x, values in zip(
                    out,
                    (n, chars, _sums(_SYMBOL[data], offsets), [duplicate_lines(r) for r in raws], repeat, failed, [v[0] and not f for v, f in zip(verdicts, failed, strict=True)], [v[1] for v in verdicts], [v[2] for v in verdicts]),
                    strict=True,
                ):
                    x.extend(values)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            return [pa.array(x, t) for x, t in zip(out, types, strict=True)]

        return go

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunks double"
    return with_text_columns(docs, text_col, schema, make, keep_text)
