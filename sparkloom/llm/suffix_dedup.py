"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes that agree on their first ``length`` bytes are a repeated window.  Suffixes are
ordered only that deep, in passes from coarse digits to fine ones, and a suffix leaves as soon as
its group has one member or its whole group is known to be equal:

1. The first digit of a suffix is the smallest ``anchor``-byte gram of its window (a function of
   the window alone).  Consecutive suffixes with the same gram form one *run*, so a pass moves
   about ``2 / (length - anchor + 2)`` rows for each byte.  Grams that occur once are done.
2. The second digit is the run's whole context, all bytes that its windows cover.  A context that
   occurs twice makes every window of the run a repeated one.
3. One run for each remaining distinct context goes on with its bytes.  Within a gram's group the
   windows are radix-sorted by blocks of ``anchor`` bytes (rounded down to a power of two) until
   `length` bytes are compared.  The passes run within a task for a gram of up to ``group_cap``
   contexts and over the cluster for others, so no group has to fit in one task; they compare the
   same digits, so the cap changes no result.

All digits are hashes; no bytes are compared after them.  A gram has 64 bits, and contexts and windows
are held equal by two independent hashes of 64 bits of all their bytes: two that differ would be taken
for equal with a chance of 2**-128.  Skewed joins read written tables on both sides, so adaptive
execution can split a hot gram.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import slices
from sparkloom.llm.hashing import U64, BlockHash, sliding_min
from sparkloom.llm.store import materialize, release, row_ids

PIECE = 1 << 20
_POS = U64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(row, gram hash, two context hashes, first start, last start, n) of each run; starts count within the row.

    Runs that follow each other with the same gram and context (periodic text) are one with their number n.
    """
    one, two = BlockHash(data, anchor, 0), BlockHash(data, anchor, 1)
    gram = one.windows(anchor)
    least = sliding_min((gram & ~_POS) | np.arange(len(gram), dtype=U64), length - anchor + 1)
    at = (least & _POS).astype(np.int64)
    start = np.arange(len(at))
    row = np.searchsorted(offsets, start, side="right") - 1
    keep = start + length <= offsets[row + 1]
    start, at, row = start[keep], at[keep], row[keep]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(U64), z.astype(U64), z, z, z
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    a, b = start[first], start[np.r_[first[1:] - 1, len(start) - 1]]
    r, g, c, d = row[first], gram[at[first]], one.spans(a, b + length), two.spans(a, b + length)
    head = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    n = np.diff(np.r_[head, len(r)])
    r, start = r[head], offsets[r[head]]
    return r, g[head], c[head], d[head], a[head] - start, b[head + n - 1] - start, n


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """A slice as it is, or a very long single row in overlapping pieces: (bytes, offsets, base)."""
    if len(data) <= PIECE or len(offsets) > 2:
        yield data, offsets, 0
        return
    for base in range(0, len(data), PIECE):
        part = data[base : base + PIECE + length - 1]
        yield part, np.array([0, len(part)], np.int64), base


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False) if x.dtype != U64 else x.view(np.int64))


def _grams(length: int, anchor: int):
    def go(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                for part, off, _ in pieces(data, offsets, length):
                    _, grams, _, _, _, _, n = runs(part, off, length, anchor)
                    if len(grams):
                        keys, which = np.unique(grams, return_inverse=True)
                        yield pa.record_batch([_long(keys), _long(np.bincount(which, n).astype(np.int64))], names=["gram", "n"])

    return go


def _rows(length: int, anchor: int):
    def go(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in slices(batch.column(1)):
                for part, off, base in pieces(data, offsets, length):
                    r, g, c, d, a, b, n = runs(part, off, length, anchor)
                    if len(r):
                        yield pa.record_batch(
                            [_long(g), _long(c), _long(d), _long(uid[i + r]), pa.array((a + base).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(n.astype(np.int32))],
                            names=["gram", "c1", "c2", "_uid", "a", "more", "n"],
                        )

    return go


def _contexts(length: int):
    """(text, runs of that text) to (gram, uid, a, alone, bytes)."""

    def go(batches):
        for batch in batches:
            out = {k: [] for k in ("gram", "size", "_uid", "a", "alone", "bytes")}
            texts, lists = batch.column("text"), batch.column("runs")
            for k, uid in enumerate(batch.column("_uid").to_pylist()):
                text = (texts[k].as_py() or "").encode()
                for run in lists[k].as_py():
                    out["gram"].append(run["gram"])
                    out["size"].append(run["size"])
                    out["_uid"].append(uid)
                    out["a"].append(run["a"])
                    out["alone"].append(run["alone"])
                    out["bytes"].append(text[run["a"] : run["a"] + run["more"] + length])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return go


def digits(data: np.ndarray, starts: np.ndarray, length: int, anchor: int):
    """The digits of the windows data[s:s+length], most significant first: blocks of the first hash,
    then the second hash of the whole window.  The window of each index in `live` is asked for."""
    one = BlockHash(data, anchor, 0)
    places = [*range(0, length - one.block + 1, one.block), length - one.block]
    for place in places if length % one.block else places[:-1]:
        yield lambda live, place=place: one.at[starts[live] + place]
    yield lambda live: BlockHash(data, anchor, 1).spans(starts[live], starts[live] + length)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray | None = None, anchor: int = 64) -> np.ndarray:
    """Which windows data[s:s+length] occur at more than one of `starts` (of the same group): radix
    passes of a block each, most significant first; a window leaves with its last companion."""
    live = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64) if group is None else group
    for digit_of in digits(data, starts, length, min(anchor, length)):
        if not len(live):
            break
        digit = digit_of(live)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) - 1
        many = np.bincount(group)[group] > 1
        live, group = live[many], group[many]
    found = np.zeros(len(starts), bool)
    found[live] = True
    return found


def _windows_of(table: pa.Table, length: int):
    """(bytes, start of each window, row of each window, window's start within its text)."""
    raw = [x.as_py() for x in table.column("bytes")]
    sizes = np.array([len(x) - length + 1 for x in raw], np.int64)
    bases = np.cumsum([0, *map(len, raw)])[:-1]
    row = np.repeat(np.arange(len(raw)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a = table.column("a").to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), bases[row] + within, row, a[row] + within


def _stretches(uid: np.ndarray, start: np.ndarray, length: int):
    """Windows to covered (uid, from, to), joined where consecutive."""
    if not len(uid):
        return uid, start, start
    first = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)])
    return uid[first], start[first], start[np.r_[first[1:] - 1, len(start) - 1]] + length


_SPAN = "_uid long, s int, e int"


def _span_batch(uid, s, e) -> pa.Table:
    return pa.table([_long(uid), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["_uid", "s", "e"])


def _refine(length: int, anchor: int):
    """Rows sorted by gram; whole groups are compared together, about a slice of windows at a time."""

    def solve(table: pa.Table) -> pa.Table:
        data, starts, row, at = _windows_of(table, length)
        gram = np.unique(table.column("gram").to_numpy(), return_inverse=True)[1]
        hit = repeated_starts(data, starts, length, gram[row], anchor)
        hit &= table.column("alone").to_numpy()[row]
        return _span_batch(*_stretches(table.column("_uid").to_numpy()[row[hit]], at[hit], length))

    def go(batches):
        held, n = [], 0
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else grams
            if held and len(grams) and held[-1].column("gram")[-1].as_py() != grams[0] and n >= 2048:
                yield from solve(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
            done = 0
            for cut in cuts[1:]:
                if n + cut - done >= 2048:
                    held.append(batch.slice(done, cut - done))
                    yield from solve(pa.Table.from_batches(held)).to_batches()
                    held, n, done = [], 0, int(cut)
            if done < len(grams):
                held.append(batch.slice(done))
                n += len(grams) - done
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return go


def _window_keys(length: int, anchor: int):
    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(i, 2048)])
                data, starts, row, at = _windows_of(part, length)
                uid, alone = part.column("_uid").to_numpy()[row], part.column("alone").to_numpy()[row]
                w1, w2 = (BlockHash(data, anchor, kind).spans(starts, starts + length) for kind in (0, 1))
                yield pa.record_batch(
                    [_long(w1), _long(w2), _long(uid), pa.array(at.astype(np.int32)), pa.array(alone)],
                    names=["w1", "w2", "_uid", "s", "alone"],
                )

    return go


def _join_windows(length: int):
    def go(batches):
        for batch in batches:
            uid, s = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            order = np.lexsort((s, uid))
            yield from _span_batch(*_stretches(uid[order], s[order], length)).to_batches()

    return go


def repeated_spans(rows: DataFrame, length: int = 200, anchor: int = 64, group_cap: int = 1024) -> DataFrame:
    """(_uid, spans) of rows (_uid, text): bytes covered by a repeated `length`-byte string, as
    ``start << 32 | end`` each, unmerged and in no order.  Rows without one are left out."""
    if not 1 <= anchor <= length:
        raise ValueError("anchor must lie between 1 and length")
    grams = materialize(
        rows.mapInArrow(_grams(length, anchor), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams"
    )
    found = materialize(
        rows.mapInArrow(_rows(length, anchor), "gram long, c1 long, c2 long, _uid long, a int, more int, n int").join(grams.hint("merge"), "gram"), "runs"
    )
    release(grams)
    contexts = materialize(
        found.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("_uid", "a", "more")).alias("one")), "contexts"
    )
    equal = found.join(contexts.where("n > 1").select("gram", "c1", "c2").hint("merge"), ["gram", "c1", "c2"]).select(
        "_uid", F.col("a").alias("s"), (F.col("a") + F.col("more") + length).alias("e")
    )
    mixed = materialize(
        contexts.groupBy("gram").agg(F.count("*").alias("size"), F.max(F.col("n") == 1).alias("open")).where("size > 1 and open").select("gram", "size"), "mixed"
    )
    lists = (
        contexts.join(mixed.hint("merge"), "gram")
        .select("one.*", "gram", "size", (F.col("n") == 1).alias("alone"))
        .groupBy("_uid")
        .agg(F.collect_list(F.struct("gram", "size", "a", "more", "alone")).alias("runs"))
    )
    opened = materialize(
        rows.join(lists.hint("merge"), "_uid").mapInArrow(_contexts(length), "gram long, size long, _uid long, a int, alone boolean, bytes binary"), "opened"
    )
    release(mixed)
    small = opened.where(F.col("size") <= group_cap).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refine(length, anchor), _SPAN)
    windows = opened.where(F.col("size") > group_cap).mapInArrow(_window_keys(length, anchor), "w1 long, w2 long, _uid long, s int, alone boolean")
    twice = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "windows")
    large = windows.where("alone").join(twice.hint("merge"), ["w1", "w2"]).select("_uid", "s").mapInArrow(_join_windows(length), _SPAN)
    packed = F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("e").cast("long"))
    return equal.unionByName(small).unionByName(large).groupBy("_uid").agg(F.collect_list(packed).alias("spans"))


def merge_spans(packed: np.ndarray) -> list[tuple[int, int]]:
    """Sorted maximal runs of packed half-open spans."""
    if not len(packed):
        return []
    v = np.sort(packed)
    start, end = v >> 32, np.maximum.accumulate(v & 0xFFFFFFFF)
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[first].tolist(), end[np.r_[first[1:] - 1, len(v) - 1]].tolist(), strict=True))


def _character_inside(raw: bytes, s: int, e: int) -> tuple[int, int]:
    """The span without characters that it covers only in part."""
    while s < e and s < len(raw) and raw[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def _apply(whole_characters: bool):
    def go(batches):
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("spans")
            removed, count, digest, kept = [], [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                raw, spans = (text or "").encode(), lists[k]
                runs_ = merge_spans(spans.values.to_numpy()) if spans.is_valid else []
                if whole_characters and runs_:
                    runs_ = [x for x in (_character_inside(raw, *r) for r in runs_) if x[0] < x[1]]
                at, left = 0, []
                for s, e in runs_:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                rest = b"".join(left) if runs_ else raw
                removed.append(len(raw) - len(rest))
                count.append(len(runs_))
                digest.append(hashlib.sha256(rest).hexdigest())
                if whole_characters:
                    kept.append(text if not runs_ else rest.decode())
            columns = [batch.column("_row"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["_row", "n_removed", "n_spans", "kept_sha256"]
            if whole_characters:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names=names)

    return go


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, anchor: int = 64, group_cap: int = 1024, whole_characters: bool = False
) -> DataFrame:
    """All rows of `docs`, with n_removed, n_spans (long) and kept_sha256 of what is left.

    With ``whole_characters`` the text column is replaced by what is left; a character that a span
    covers only in part then stays.  Null texts are empty and stay null; texts shorter than
    ``length`` lose nothing; equal texts of ``length`` bytes or more in two rows (also rows with one
    id) lose everything; an empty table gives an empty result.  Rows with repeated or null ids are
    separate documents.  Other columns pass through; columns named like the three results are
    replaced.
    """
    results = ("n_removed", "n_spans", "kept_sha256")
    names = [c for c in docs.columns if c not in results]
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_row"))
    ids, _ = row_ids(packed, "_id", ["text", "_row"])
    spans = repeated_spans(ids.select("_uid", "text"), length, anchor, group_cap)
    schema = packed.select("_row").schema
    out = schema.add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if whole_characters:
        out = out.add("kept_text", "string")
    done = ids.join(spans.hint("merge"), "_uid", "left").select("_row", "text", "spans").mapInArrow(_apply(whole_characters), out)
    columns = [F.col(f"_row.`{c}`").alias(c) if c != text_col else F.col("kept_text").alias(c) for c in names if c != text_col or whole_characters]
    return done.select(*columns, *results)
