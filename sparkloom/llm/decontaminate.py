"""Benchmark decontamination: a BM25 inverted index of test items, searched with every passage.

Every training text is cut into overlapping passages that are long enough to hold any item, and each
passage is a query.  An item's score is divided by the score it gives itself, so one threshold fits
all.  Retrieval is block-max WAND in columns: items lie in blocks of ``BLOCK``, and a term's postings in
runs of a block each with their largest impact.  The runs' maxima, plus all that the common terms
could add, bound a (passage, block) pair; only where that reaches the threshold are the runs opened,
the postings of all others are never read.  Nothing above the threshold is left out.  What is
retrieved is verified word by word.

Document frequencies and the mean length are those of all items, however many indexes hold them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import ALNUM, slices, words
from sparkloom.llm.hashing import U64, word_keys
from sparkloom.llm.shingles import combine
from sparkloom.llm.store import bounded_batches, materialize

K1, B = 1.2, 0.75
#: Least normalised BM25 score, least overlap of shingles and of question and answer words.
SCORE, OVERLAP, SHINGLE = 0.5, 0.8, 5
#: An answer of fewer distinct words decides nothing: one edit would take more than its share.
ANSWER = 5
#: Items per index block, items per broadcast index, and the share of items that makes a term common.
BLOCK, ITEMS, COMMON = 8, 20_000, 0.05
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence answers; a single sentence is cut at three quarters."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    tokens = text.split()
    cut = max(1, len(tokens) * 3 // 4)
    return " ".join(tokens[:cut]), " ".join(tokens[cut:])


def _words(column: pa.Array):
    """Slices of lower-cased words: (first row, last row, hash, row)."""
    lowered = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    for i, j, data, offsets in slices(lowered):
        start, end, row = words(data, offsets, ALNUM)
        yield i, j, word_keys(data, start, end), row


def hashed(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, h, row in _words(pa.array(texts, pa.string())):
        b = np.searchsorted(row, np.arange(j - i + 1))
        out += [h[b[k] : b[k + 1]] for k in range(j - i)]
    return out


class Statistics:
    """Number of items, their mean and largest length, and how many hold each term."""

    def __init__(self, items: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.items, self.mean, self.longest, self.terms, self.df = items, mean, longest, terms[order], df[order]

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


class ItemIndex:
    """Postings with normalised impacts, block maxima, and what verification needs."""

    def __init__(self, ids: list, texts: list[str], statistics: Statistics | None = None):
        split = [split_item(t) for t in texts]
        self.words = hashed(texts)
        self.question = [np.unique(h) for h in hashed([q for q, _ in split])]
        self.answer = [np.unique(h) for h in hashed([a for _, a in split])]
        self.ids, n = ids, len(ids)
        self.shingles = [np.unique(combine(h, SHINGLE)) if len(h) >= SHINGLE else np.unique(combine(h, max(1, len(h)))) for h in self.words]
        item = np.repeat(np.arange(n), [len(h) for h in self.words])
        pairs, tf = np.unique(np.stack([np.concatenate([*self.words, np.zeros(0, U64)]), item.astype(U64)]), axis=1, return_counts=True)
        self.terms, term, df = np.unique(pairs[0], return_inverse=True, return_counts=True)
        item = pairs[1].astype(np.int64)
        length = np.array([len(h) for h in self.words], float)
        if statistics is None:
            statistics = Statistics(n, float(length.mean()) if n else 1.0, int(length.max(initial=0)), self.terms, df)
        self.span = max(SHINGLE, statistics.longest)
        df, every = statistics.of(self.terms), statistics.items
        idf = np.log(1 + (every - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1.0, statistics.mean)))
        own = np.bincount(item, impact, n)
        impact /= np.maximum(own[item], 1e-12)
        # Terms in more than COMMON of the items, but never an item's majority, only bound what they could add.
        self.common = df > max(3, COMMON * every)
        self.extra = np.bincount(item[self.common[term]], impact[self.common[term]], n)
        self.term, self.item, self.impact = term, item, impact
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # Postings lie by term and item, so each run of a term and block is one range of them.
        block, blocks = item // BLOCK, n // BLOCK + 1
        key, self.run = np.unique(term * blocks + block, return_index=True)
        self.run = np.r_[self.run, len(term)]
        self.b_term, self.b_block = key // blocks, key % blocks
        self.b_top = np.maximum.reduceat(impact, self.run[:-1]) if len(key) else np.zeros(0)
        self.b_first = np.searchsorted(self.b_term, np.arange(len(self.terms) + 1))
        self.b_extra = np.zeros(n // BLOCK + 1)
        np.maximum.at(self.b_extra, np.arange(n) // BLOCK, self.extra)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 if no item has it."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    @staticmethod
    def _expand(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, index into the postings) of all postings of the terms."""
        n = first[term + 1] - first[term]
        own = np.repeat(np.arange(len(term)), n)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[term][own]

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) above SCORE, for distinct (passage, term) pairs."""
        rare = ~self.common[term]
        p, t = passage[rare], term[rare]
        own, run = self._expand(self.b_first, t)
        blocks = len(self.b_extra)
        key, inverse = np.unique(p[own] * blocks + self.b_block[run], return_inverse=True)
        bound = np.bincount(inverse, self.b_top[run], len(key)) + self.b_extra[key % blocks] if len(key) else np.zeros(0)
        opened = np.flatnonzero((bound >= SCORE - 1e-9)[inverse]) if len(key) else np.zeros(0, np.int64)
        which, at = self._expand(self.run, run[opened])
        p = p[own[opened]][which]
        n = len(self.ids)
        key, inverse = np.unique(p * n + self.item[at], return_inverse=True)
        score = np.bincount(inverse, self.impact[at], len(key)) if len(key) else np.zeros(0)
        close = score + self.extra[key % max(1, n)] >= SCORE - 1e-9
        out = []
        for k, s in zip(key[close].tolist(), score[close].tolist(), strict=True):
            q, item = divmod(k, n)
            a, b = np.searchsorted(passage, [q, q + 1])
            own_, at_ = self._expand(self.first, term[a:b][self.common[term[a:b]]])
            s += float(self.impact[at_[self.item[at_] == item]].sum())
            if s >= SCORE:
                out.append((q, item, s))
        # Items made of common terms only never meet a rare one: they are scored against every passage.
        bare = np.flatnonzero(self.extra >= SCORE)
        if len(bare):
            own, at = self._expand(self.first, term)
            keep = np.isin(self.item[at], bare)
            key, inverse = np.unique(passage[own[keep]] * n + self.item[at[keep]], return_inverse=True)
            score = np.bincount(inverse, self.impact[at[keep]], len(key)) if len(key) else np.zeros(0)
            known = {(q, i) for q, i, _ in out}
            out += [(*divmod(k, n), s) for k, s in zip(key.tolist(), score.tolist(), strict=True) if s >= SCORE and divmod(k, n) not in known]
        return out

    def verify(self, item: int, h: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words found in a passage."""
        k = min(SHINGLE, max(1, len(self.words[item])))
        share = lambda mine, theirs: float(np.isin(mine, theirs).mean()) if len(mine) else 1.0
        return share(self.shingles[item], combine(h, k)), share(self.question[item], h), share(self.answer[item], h)


def _terms(batches):
    """(part, term, items that hold it, 0, 0), and one row a batch and part with the number of items and of words."""
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        for i, j, h, row in _words(batch.column("text")):
            pairs = np.unique(np.stack([h, row.astype(U64)]), axis=1)
            owner = part[i + pairs[1].astype(np.int64)]
            held, n = np.unique(np.stack([owner, pairs[0].view(np.int64)]), axis=1, return_counts=True)
            zero = np.zeros(len(n), np.int64)
            columns = [np.r_[held[0], part[i : i + 1]], np.r_[held[1], 0], np.r_[n, 0], np.r_[zero, j - i], np.r_[zero, len(h)], np.r_[zero, np.bincount(row, minlength=1).max()]]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["part", "term", "n", "items", "words", "longest"])


def _search(index: ItemIndex, id_type: pa.DataType):
    span = index.span

    def go_slice(i, h, row):
        """(row, item, first word, score, overlaps) for one slice of rows."""
        begin = np.searchsorted(row, row)  # first word of each word's row
        chunk = (np.arange(len(h)) - begin) // span
        counts = np.bincount(row) if len(row) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum((counts + span - 1) // span + 1)])[row] if len(row) else row
        term = index.lookup(h)
        hit = np.flatnonzero(term >= 0)
        # Chunk c lies in the passages that begin at chunk c - 1 and at chunk c.
        p = np.concatenate([base[hit] + chunk[hit], base[hit] + chunk[hit] + 1])
        if not len(p):
            return
        pairs = np.unique(p * len(index.terms) + np.concatenate([term[hit], term[hit]]))
        starts = np.concatenate([[0], np.cumsum(counts)])
        bases = np.concatenate([[0], np.cumsum((counts + span - 1) // span + 1)])
        best: dict[tuple[int, int], tuple] = {}
        for q, item, score in index.retrieve(pairs // len(index.terms), pairs % len(index.terms)):
            r = int(np.searchsorted(bases, q, side="right")) - 1
            a = max(0, (q - int(bases[r]) - 1) * span)
            part = h[starts[r] + a : min(starts[r + 1], starts[r] + a + (2 if q > bases[r] else 1) * span)]
            found = index.verify(item, part)
            score = round(score, 9)  # the order of a sum decides nothing
            if min(found if len(index.answer[item]) >= ANSWER else found[:2]) >= OVERLAP:
                key = (i + r, item)
                if key not in best or (score, -a) > (best[key][3], -best[key][2]):
                    best[key] = (i + r, item, a, score, *found)
        yield from best.values()

    def go(batches):
        for batch in batches:
            rows = []
            for i, _, h, row in _words(batch.column(1)):
                rows += go_slice(i, h, row)
            yield pa.record_batch(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.ids[r[1]] for r in rows], id_type)]
                + [pa.array([r[2] for r in rows], pa.int64())]
                + [pa.array([float(r[k]) for r in rows], pa.float64()) for k in (3, 4, 5, 6)],
                names=["_id", "item_id", "first_word", "score", "overlap", "question_overlap", "answer_overlap"],
            )

    return go


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item that it holds: id, item_id, first_word of the best
    passage (ties: the earliest), score, overlap, question_overlap, answer_overlap.

    Items of null, empty or wordless text match nothing; null and empty texts hold nothing.  Rows that
    repeat give rows that repeat; items that repeat are found each; item ids may be of any type.  Items
    are taken ITEMS at a time, so an index is bounded; the texts are read once for each such part,
    never shuffled, and scores do not depend on the parts.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    wanted = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null and text rlike '[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]'")
    parts = max(1, math.ceil(wanted.count() / ITEMS))
    numbered = wanted.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    terms = numbered.mapInArrow(_terms, "part long, term long, n long, items long, words long, longest long")
    whole = terms.agg(F.sum("items"), F.sum("words"), F.max("longest")).first() if parts > 1 else None
    df = materialize(terms.where("n > 0").groupBy("term").agg(F.sum("n").alias("n")), "frequencies") if parts > 1 else None
    schema = f"_id {kind}, item_id {item_kind}, first_word long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for part in range(parts):
        some = numbered.where(F.col("part") == part).orderBy("item_id", "text").toArrow()
        statistics = None
        if parts > 1:  # of the part's own terms, so bounded as the part is
            held = df.join(terms.where((F.col("part") == part) & (F.col("n") > 0)).select("term").distinct(), "term", "left_semi").toArrow()
            statistics = Statistics(whole[0], whole[1] / max(1, whole[0]), whole[2], held.column("term").to_numpy().astype(np.int64).view(U64), held.column("n").to_numpy())
        index = ItemIndex(some.column("item_id").to_pylist(), some.column("text").to_pylist(), statistics)
        shared = spark.sparkContext.broadcast((index, some.schema.field("item_id").type))
        found = rows.mapInArrow(lambda batches, shared=shared: _search(*shared.value)(batches), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_id", id_col)


def clean_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no test item, columns as they are; rows of a null id are judged by their own text."""
    from sparkloom.llm.store import row_ids

    names = docs.columns
    text_col = options.get("text_col", "text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    ids, _ = row_ids(packed, "_id", ["text", "_row"])
    bad = materialize(contaminated(ids, items, id_col="_uid", **{**options, "text_col": "text"}).select("_uid").distinct(), "contaminated")
    return ids.join(bad, "_uid", "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
