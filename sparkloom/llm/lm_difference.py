"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good) and a background model (all documents) are interpolated
bigram models with one vocabulary, one order and one smoothing, so their losses differ only by what
they were counted on.  A document's score is its mean loss per token under the target model less
that under the background model: negative means closer to the target.

Counts are exact, of every word and every bigram of the whole corpus.  A document is scored by the
counts of all other documents: what it holds itself is taken off, so no document lowers its own loss
while a copy of it elsewhere does.  A loss is a sum over a document's words and bigrams of what each
adds to the loss of an unseen word, and a word or bigram of one document alone adds nothing.

* Words get whole counts first; the ``1 << BITS`` most frequent ones and the frequent bigrams are sent to
  the tasks (a fixed size), which add up what these contribute.  A bigram is frequent if it has half
  of ``SHARE`` of all tokens counting only batches where it has that share (and ``LEAST`` occurrences),
  so there are at most ``2 / SHARE`` and no other has more than SHARE of all tokens and LEAST a batch.
* Every other word and bigram goes, once per document, to the bucket of its key, packed in columns.  A
  bucket adds the whole counts, and what its keys contribute to each document, if another one also
  holds them, goes to the document's bucket, packed as well.  Buckets are as many as ``ROWS`` tokens
  each take; no key in them is frequent, and what is dealt grows with the corpus.
* A bigram with a word that is not frequent goes to that word's bucket, which knows its count.  If both
  words are so, the first one's count is joined: few of them are in two documents.

What is sent to the tasks decides where a sum is made, never its result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import slices
from sparkloom.llm.deal import bucket_of, cut, gather, pack, unpack
from sparkloom.llm.hashing import U64, mix
from sparkloom.llm.shingles import word_hashes
from sparkloom.llm.store import bounded_batches, materialize, row_ids

WEIGHT, ADD = 0.7, 0.5
#: Bits of a frequent word's number; the share of all tokens that makes a bigram frequent, and its least count in a batch.
BITS, SHARE, LEAST = 18, 2.0**-17, 8
#: Ids of target documents that are broadcast at most (8 bytes each); more are joined by a shuffle.
MARKS = 1 << 20
#: Losses are added as integers of this scale, so sums don't depend on the order.
SCALE = 1 << 24
#: Rows that a task gathers before it deals them, and tokens that a bucket is made for.
BLOCK, ROWS = 1 << 19, 1 << 19
#: Spreads the codes of bigrams over 64 bits; the inverse brings them back.
_SPREAD = 0x9E3779B97F4A7C15
_BACK = pow(_SPREAD, -1, 1 << 64)
GOOD, COUNTED, SCORED = 1, 2, 4


@dataclass
class Part:
    """A slice of texts: tokens of each row; each word of a row with its count, whether the row ends with
    it, and its number among the frequent ones (or -1); each bigram of a row as two of these words."""

    first: int
    size: np.ndarray
    row: np.ndarray
    word: np.ndarray
    n: np.ndarray
    last: np.ndarray
    number: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray


def _number(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def parts(column: pa.Array, known: np.ndarray):
    for i, j, data, offsets in slices(column):
        h, row, _, _ = word_hashes(data, offsets)
        order = np.lexsort((h, row))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(h)]
        own = np.empty(len(h), np.int64)
        own[order] = np.cumsum(new) - 1
        words = order[new]
        same = row[1:] == row[:-1]
        inside = np.flatnonzero(same)
        ends = np.r_[np.flatnonzero(~same), len(h) - 1] if len(h) else inside
        key, pairs = np.unique(own[inside] * len(words) + own[inside + 1], return_counts=True)
        left, right = np.divmod(key, max(1, len(words)))
        yield Part(
            i, np.bincount(row, minlength=j - i), row[words] + i, h[words], np.bincount(own, minlength=len(words)), np.bincount(own[ends], minlength=len(words)),
            _number(h[words], known), left, right, pairs,
        )


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first place of each key, sums of the values)."""
    if not len(key):
        return (np.zeros(0, np.int64), *values)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    return (order[start], *(np.add.reduceat(v[order], start) for v in values))


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([*arrays, np.zeros(0, kind)])


def _flags(batch) -> np.ndarray:
    return batch.column("flags").to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(share: float, least: int):
    """(kind, x, y, n, t): whole counts of the words of a batch (kind 0), and its frequent bigrams (1)."""
    none = np.zeros(0, U64)

    def go(batches):
        for batch in batches:
            good = _flags(batch) & GOOD
            words, pairs = [], []
            for p in parts(batch.column("text"), none):
                words.append((p.word, p.n, p.n * good[p.row]))
                pairs.append((p.word[p.left], p.word[p.right], p.pairs))
            h, n, t = (_joined([w[k] for w in words], kind) for k, kind in enumerate((U64, np.int64, np.int64)))
            least_here = max(least, math.ceil(int(n.sum()) * share / 2))
            at, n, t = _grouped(h, n, t)
            x, y, m = (_joined([w[k] for w in pairs], kind) for k, kind in enumerate((U64, U64, np.int64)))
            with np.errstate(over="ignore"):
                one, m = _grouped(mix(x) * U64(0x9E3779B97F4A7C15) + y, m)
            one, m = one[m >= least_here], m[m >= least_here]
            columns = [np.r_[np.zeros(len(at), np.int64), np.ones(len(one), np.int64)], np.r_[h[at], x[one]].view(np.int64), np.r_[np.zeros(len(at), U64), y[one]].view(np.int64), np.r_[n, m], np.r_[t, np.zeros(len(one), np.int64)]]
            yield pa.record_batch([pa.array(columns[0].astype(np.int32)), *(pa.array(c.astype(np.int64, copy=False)) for c in columns[1:])], names=["kind", "x", "y", "n", "t"])

    return go


@dataclass
class Frequent:
    """What the tasks hold: counts of the most frequent words by number, of frequent bigrams by code, and totals."""

    words: np.ndarray
    n: np.ndarray
    t: np.ndarray
    codes: np.ndarray
    codes_n: np.ndarray
    codes_t: np.ndarray
    totals: tuple[int, int]
    distinct: int

    def code(self, p: Part) -> np.ndarray:
        """The code of each bigram; -1 if one of its words is not frequent."""
        a, b = p.number[p.left], p.number[p.right]
        return np.where((a >= 0) & (b >= 0), a << BITS | b, -1)

    def lookup(self, code: np.ndarray) -> np.ndarray:
        return np.where(code >= 0, _number(code, self.codes), -1)

    def sums(self, p: Part, flags: np.ndarray) -> np.ndarray:
        """(2, rows of the part): losses under both models, of unseen words and of what frequent words and bigrams add."""
        out, flags, row = np.zeros((2, len(p.size))), flags[p.first : p.first + len(p.size)], p.row - p.first
        counted = (flags & COUNTED) > 0
        at = self.lookup(self.code(p))
        hot, w = np.flatnonzero(at >= 0), np.flatnonzero(p.number >= 0)
        a, b = p.left[hot], p.right[hot]
        for k, (words, codes) in enumerate(((self.t, self.codes_t), (self.n, self.codes_n))):
            own = (counted & ((flags & GOOD) > 0) if k == 0 else counted).astype(np.int64)
            size = self.totals[k] - own * p.size + ADD * (self.distinct + 1)
            rest = words[p.number[w]] - own[row[w]] * p.n[w]
            r = row[a]
            pair = codes[at[hot]] - own[r] * p.pairs[hot]
            before, single = words[p.number[a]] - own[r] * p.n[a], words[p.number[b]] - own[r] * p.n[b]
            odds = WEIGHT / (1 - WEIGHT) * pair / np.maximum(before, 1) * size[r] / (single + ADD)
            out[k] = p.size * np.log(size / ADD) + np.bincount(row[w], -p.n[w] * np.log1p(rest / ADD) - (rest > 0) * (p.n[w] - p.last[w]) * math.log(1 - WEIGHT), len(p.size))
            out[k] += np.bincount(r, -p.pairs[hot] * np.log1p(odds), len(p.size))
        return out


def _hot(shared):
    """(at, n, t): whole counts of the frequent bigrams of a batch, by place."""

    def go(batches):
        model = shared.value
        for batch in batches:
            good, found = _flags(batch) & GOOD, []
            for p in parts(batch.column("text"), model.words):
                at = model.lookup(model.code(p))
                here = np.flatnonzero(at >= 0)
                found.append((at[here], p.pairs[here], p.pairs[here] * good[p.row[p.left[here]]]))
            at, n, t = (_joined([f[k] for f in found], np.int64) for k in range(3))
            one, n, t = _grouped(at, n, t)
            yield pa.record_batch([pa.array(at[one].astype(np.int64)), pa.array(n), pa.array(t)], names=["at", "n", "t"])

    return go


NEAR, FAR, RARE = range(3)
#: Kinds of rare keys: a word; a bigram whose second, first or both words are not frequent.
WORD, SECOND, FIRST, BOTH = range(4)


def _deal(shared, buckets: int):
    """(bucket, section, blob): sums of what is known at once, and rows of bigrams of frequent words and of rare keys."""

    def block(held):
        uid, flags, n, loss = (np.concatenate([h[k] for h in held], axis=-1) for k in range(4))
        own = (flags & SCORED) > 0
        yield int(bucket_of(uid[:1].astype(np.int64).view(U64) * U64(_SPREAD), buckets)[0]), NEAR, pack([uid[own], n[own], *(x[own] for x in loss)])
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        for section, k in ((FAR, 4), (RARE, 5)):
            rows = [[*h[k][:1], h[k][1] + first, *h[k][2:]] for h, first in zip(held, base.tolist(), strict=False)]
            key, owner, *columns = (np.concatenate(c) for c in zip(*rows, strict=True))
            for bucket, blob in cut(key, owner, [uid, flags, n], columns, buckets):
                yield bucket, section, blob

    def go(batches):
        model, held, size = shared.value, [], 0

        def flush():
            rows = list(block(held))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "section", "blob"])

        for batch in batches:
            every, uids = _flags(batch), batch.column("_uid").to_numpy(zero_copy_only=False).astype(np.int64)
            for p in parts(batch.column("text"), model.words):
                rows = slice(p.first, p.first + len(p.size))
                loss = np.rint(model.sums(p, every) * SCALE).astype(np.int64)
                code, row = model.code(p), p.row - p.first
                k = np.flatnonzero((code >= 0) & (model.lookup(code) < 0))
                with np.errstate(over="ignore"):
                    far = [code[k].astype(U64) * U64(_SPREAD), row[p.left[k]], p.pairs[k], p.n[p.left[k]], p.n[p.right[k]]]
                w, k = np.flatnonzero(p.number < 0), np.flatnonzero(code < 0)
                a, b = p.left[k], p.right[k]
                second = p.number[b] < 0
                kind = np.where(second, np.where(p.number[a] < 0, BOTH, SECOND), FIRST)
                other = np.where(kind == BOTH, p.word[a], np.where(second, p.number[a], p.number[b]).astype(U64))
                none = np.zeros(len(w), np.int64)
                rare = [np.r_[p.word[w], np.where(second, p.word[b], p.word[a])], np.r_[row[w], row[a]], np.r_[none, kind], np.r_[none.astype(U64), other].view(np.int64), np.r_[p.n[w], p.pairs[k]], np.r_[p.last[w], p.n[a]], np.r_[none, p.n[b]]]
                held.append((uids[rows], every[rows], p.size, loss, far, rare))
                size += len(far[0]) + len(rare[0])
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return go


@dataclass
class Own:
    """Rows of a bucket: owner, own count of the key and of both words (a, b), and for each model whether it counts them."""

    owner: np.ndarray
    n: np.ndarray
    a: np.ndarray
    b: np.ndarray
    size: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]
    scored: np.ndarray

    def take(self, k: np.ndarray) -> Own:
        return Own(self.owner[k], self.n[k], self.a[k], self.b[k], self.size[k], tuple(c[k] for c in self.counts), self.scored[k])

    def rest(self, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the other documents hold of each row's key, by model, and the number of the key; rows are sorted by key."""
        new = np.zeros(len(self.n), bool)
        new[:1] = True
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        mine = [self.n * c for c in self.counts]
        return *(np.add.reduceat(m, np.flatnonzero(new))[group] - m if len(m) else m for m in mine), group


def _own(flags, size, owner, n, a, b) -> Own:
    f = flags[owner]
    counted = ((f & COUNTED) > 0).astype(np.int64)
    return Own(owner, n, a, b, size[owner], (counted * (f & GOOD), counted), (f & SCORED) > 0)


def _pair_losses(own: Own, rest, before, single, model: Frequent) -> list[np.ndarray]:
    """What bigrams add under both models, from whole counts of their words."""
    out = []
    for k in range(2):
        size = model.totals[k] + ADD * (model.distinct + 1) - own.counts[k] * own.size
        odds = WEIGHT / (1 - WEIGHT) * rest[k] / np.maximum(before[k] - own.counts[k] * own.a, 1) * size / (single[k] - own.counts[k] * own.b + ADD)
        out.append(-own.n * np.log1p(odds))
    return out


def _far(blobs: list[bytes], model: Frequent):
    """(ids, owner, losses) of bigrams of frequent words."""
    (uid, flags, size), key, owner, (n, a, b) = gather(blobs, 3)
    order = np.argsort(key, kind="stable")  # merges the sorted blobs
    key, own = key[order], _own(flags, size, owner[order], n[order], a[order], b[order])
    t, m, _ = own.rest(key)
    live = np.flatnonzero((m > 0) & own.scored)
    with np.errstate(over="ignore"):
        code = (key[live] * U64(_BACK)).astype(np.int64)
    x, y = code >> BITS, code & (1 << BITS) - 1
    return uid, own.owner[live], _pair_losses(own.take(live), (t[live], m[live]), (model.t[x], model.n[x]), (model.t[y], model.n[y]), model)


def _rare(blobs: list[bytes], model: Frequent):
    """(ids, owner, losses) of rare words and bigrams, and the bigrams of two rare words that still lack the first one's count."""
    (uid, flags, size), key, owner, (kind, other, n, a, b) = gather(blobs, 3)
    order = np.lexsort((other, kind, key))
    key, kind, other, own = key[order], kind[order], other[order], _own(flags, size, owner[order], n[order], a[order], b[order])
    t, m, _ = own.rest(key, kind, other)
    whole = [x + own.n * c for x, c in zip((t, m), own.counts, strict=True)]
    heads = np.flatnonzero((kind == WORD) & np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])][: len(key)])
    at = heads[np.searchsorted(key[heads], key)] if len(heads) else np.zeros(0, np.int64)  # every pair's main word is there
    main = [w[at] for w in whole]
    live = (m > 0) & own.scored
    w = np.flatnonzero(live & (kind == WORD))
    losses = [[-own.n[w] * np.log1p(r[w] / ADD) - (r[w] > 0) * (own.n[w] - own.a[w]) * math.log(1 - WEIGHT) for r in (t, m)]]
    where = [w]
    for k in (SECOND, FIRST):
        p = np.flatnonzero(live & (kind == k))
        known, here = (model.t[other[p]], model.n[other[p]]), [x[p] for x in main]
        losses.append(_pair_losses(own.take(p), (t[p], m[p]), *((known, here) if k == SECOND else (here, known)), model))
        where.append(p)
    p = np.flatnonzero(live & (kind == BOTH))
    lacking = own.take(p)
    single = [x[p] - c * lacking.b for x, c in zip(main, lacking.counts, strict=True)]
    pending = [other[p], uid[lacking.owner], lacking.n, t[p], m[p], *(c * lacking.a for c in lacking.counts), *single, *(c * lacking.size for c in lacking.counts)]
    return uid, own.owner[np.concatenate(where)], [np.concatenate(x) for x in zip(*losses, strict=True)], pending


_PENDING = ("x", "_uid", "n", "rest_t", "rest_n", "a_t", "a_n", "w_t", "w_n", "c_t", "c_n")


def _batch(columns, names) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in columns], names=list(names))


def _signless(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 63)


def _signed(x: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return (x >> 1) ^ -(x & 1)


def _summed(uid, *values) -> list[np.ndarray]:
    at, *values = _grouped(uid, *values)
    return [uid[at], *values]


def _blobs(batches):
    """(bucket, section) to packed blobs of a partition."""
    held = {}
    for b in batches:
        for bucket, section, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            held.setdefault((bucket, section), []).append(blob.as_py())
    return held


def _bucket(shared, homes: int):
    """What the keys of a bucket contribute to each document: (bucket of the document, NEAR, blob)."""

    def go(batches):
        model, rows = shared.value, []
        for (_, section), blobs in sorted(_blobs(batches).items()):
            if section == NEAR:
                rows += [[c.view(np.int64) for c in unpack(blob)] for blob in blobs]
                continue
            uid, owner, losses, *_ = (_rare if section == RARE else _far)(blobs, model)
            t, b = (np.rint(np.bincount(owner, x, len(uid)) * SCALE).astype(np.int64) for x in losses)
            some = np.flatnonzero((t != 0) | (b != 0))
            rows.append(_summed(uid[some], np.zeros(len(some), np.int64), t[some], b[some]))
        if not rows:
            return
        uid, n, *losses = _summed(*(np.concatenate(c) for c in zip(*rows, strict=True)))
        with np.errstate(over="ignore"):
            key = uid.view(U64) * U64(_SPREAD)
        dealt = list(cut(key, np.zeros(len(uid), np.int64), [np.zeros(1, U64)], [n, *map(_signless, losses)], homes))
        yield pa.record_batch([pa.array([d[0] for d in dealt], pa.int32()), pa.array([NEAR] * len(dealt), pa.int32()), pa.array([d[1] for d in dealt], pa.binary())], names=["bucket", "section", "blob"])

    return go


def _lacking(shared):
    """The rows of _PENDING of a bucket."""

    def go(batches):
        for (_, section), blobs in sorted(_blobs(batches).items()):
            if section == RARE:
                yield _batch(_rare(blobs, shared.value)[3], _PENDING)

    return go


def _home(batches):
    """(_uid, n, t, b): all that comes back to a document, one row each."""
    for blobs in _blobs(batches).values():
        _, key, _, (n, t, b) = gather(blobs, 1)
        with np.errstate(over="ignore"):
            uid = (key * U64(_BACK)).view(np.int64)
        yield _batch(_summed(uid, n, _signed(t), _signed(b)), ("_uid", "n", "t", "b"))


def _pending_losses(rows: DataFrame, words: DataFrame, model: Frequent) -> DataFrame:
    """(_uid, n, t, b) of bigrams of two rare words, with the first one's count."""
    known = words.select(F.col("word").alias("x"), F.col("n").alias("p_n"), F.col("t").alias("p_t"))
    rows = rows.join(known.hint("merge"), "x")
    out = []
    for k, c in enumerate("tn"):
        size = F.lit(model.totals[k] + ADD * (model.distinct + 1)) - F.col(f"c_{c}")
        odds = WEIGHT / (1 - WEIGHT) * F.col(f"rest_{c}") / F.greatest(F.col(f"p_{c}") - F.col(f"a_{c}"), F.lit(1)) * size / (F.col(f"w_{c}") + ADD)
        out.append(F.round(-F.col("n") * F.log1p(odds) * SCALE).cast("long"))
    return rows.select("_uid", F.lit(0).cast("long").alias("n"), out[0].alias("t"), out[1].alias("b"))


def _flag(bit: int):
    return F.col("flags").bitwiseAND(bit) > 0


def _marked(rows: DataFrame, good: DataFrame, id_col: str) -> DataFrame:
    """(_uid, text, flags) with GOOD for the ids of `good`."""
    marks = materialize(good.select(F.col(f"`{id_col}`").alias("_id")).where("_id is not null").distinct().withColumn("_good", F.lit(GOOD)), "marks")
    few = marks.count() <= MARKS
    out = rows.join(F.broadcast(marks) if few else marks.hint("merge"), "_id", "left")
    out = out.select("_uid", "text", F.col("flags").bitwiseOR(F.coalesce("_good", F.lit(0))).alias("flags"))
    return out if few else materialize(out, "marked")


def _frequent(texts: DataFrame, bits: int, share: float, least: int) -> tuple[Frequent, DataFrame]:
    """(what the tasks hold, whole counts (word, n, t) of all words)."""
    spark, schema = texts.sparkSession, "kind int, x long, y long, n long, t long"
    counts = materialize(texts.mapInArrow(_counts(share, least), schema).groupBy("kind", "x", "y").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "counts")
    words = counts.where("kind = 0").select(F.col("x").alias("word"), "n", "t")
    distinct, n, t = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    floor, room = 1 << 62, 1 << bits  # words of at least `floor` occurrences fit in the room
    step = F.floor(F.log2("n") * 32)
    for _, many, low in sorted(words.groupBy(step.alias("step")).agg(F.count("*"), F.min("n")).collect(), reverse=True):
        room -= many
        if room < 0:
            break
        floor = low
    top = words.where(F.col("n") >= floor).toArrow()
    known = top.column("word").to_numpy().astype(np.int64).view(U64)
    order = np.argsort(known)
    often = counts.where("kind = 1").where(F.col("n") >= n * share / 2).select("x", "y").toArrow()  # 2 / share rows at most
    x, y = (_number(often.column(c).to_numpy().astype(np.int64).view(U64), known[order]) for c in "xy")
    codes = np.unique((x << BITS | y)[(x >= 0) & (y >= 0)])
    none = np.zeros(len(codes), np.int64)
    model = Frequent(known[order], *(top.column(c).to_numpy().astype(np.int64)[order] for c in "nt"), codes, none, none.copy(), (t, n), distinct)
    shared = spark.sparkContext.broadcast(model)
    for at, a, b in texts.mapInArrow(_hot(shared), "at long, n long, t long").groupBy("at").agg(F.sum("n"), F.sum("t")).toArrow().to_pandas().itertuples(index=False):
        model.codes_n[at], model.codes_t[at] = a, b
    shared.destroy()
    return model, words


def score(
    docs: DataFrame, good: DataFrame, *, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, bits: int = BITS, share: float = SHARE, least: int = LEAST
) -> DataFrame:
    """docs with n_tokens long, target_loss, background_loss and difference (double).

    Words are split at ASCII white space, A-Z lower-cased.  `good` has the ids of the target documents in
    a column named like id_col.  Each document is scored by the counts of all others; with a `corpus`
    (id_col and text_col), by those of the whole corpus, and docs are not counted.  Texts without words
    (null, empty, blank) have 0 tokens and null losses.  A null id is never a target.  Rows that repeat
    an id are separate documents (all targets, if the id is one), and each sees the others; an empty
    table gives an empty one; columns named like a result are replaced.  `bits`, `share` and `least`
    decide what is sent to the tasks and change no result.
    """
    if bits > BITS:
        raise ValueError(f"bits is {BITS} at most")
    spark = docs.sparkSession
    bounded_batches(spark)
    results = ("n_tokens", "target_loss", "background_loss", "difference")
    names = [c for c in docs.columns if c not in results]
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    rows, _ = row_ids(packed, "_id", ["_id", "_row", "text"])
    texts = rows.select("_id", "_uid", "text", F.lit(SCORED if corpus is not None else SCORED | COUNTED).alias("flags"))
    if corpus is not None:
        texts = texts.unionByName(corpus.select(F.col(f"`{id_col}`").alias("_id"), F.lit(0).cast("long").alias("_uid"), F.col(f"`{text_col}`").alias("text"), F.lit(COUNTED).alias("flags")))
    texts = _marked(texts, good, id_col)
    model, words = _frequent(texts.where(_flag(COUNTED)), bits, share, least)
    shared = spark.sparkContext.broadcast(model)  # 24 bytes a word and a bigram: 2**BITS words and 2 / SHARE bigrams
    buckets = max(1, math.ceil(sum(model.totals[1:]) / ROWS))
    homes = max(1, buckets // 4)
    schema = "bucket int, section int, blob binary"
    dealt = texts.mapInArrow(_deal(shared, buckets), schema).repartitionById(buckets, "bucket")
    home = dealt.mapInArrow(_bucket(shared, homes), schema).repartitionById(homes, "bucket").mapInArrow(_home, "_uid long, n long, t long, b long")
    lacking = dealt.mapInArrow(_lacking(shared), ", ".join(f"{c} long" for c in _PENDING))
    every = home.unionByName(_pending_losses(lacking, words, model))
    sums = every.groupBy("_uid").agg(*(F.sum(c).alias(c) for c in "ntb"))
    out = rows.select("_uid", "_row", *(["text"] if keep_text else [])).join(sums.hint("merge"), "_uid")
    losses = [F.when(F.col("n") > 0, F.col(c) / SCALE / F.col("n")) for c in "tb"]
    front = [F.col("text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names if c != text_col or keep_text]
    return out.select(*front, F.col("n").alias("n_tokens"), losses[0].alias("target_loss"), losses[1].alias("background_loss"), (losses[0] - losses[1]).alias("difference"))
