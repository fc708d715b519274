"""Near-duplicates by min-max hashing, with every link confirmed on full shingle sets.

* A permutation gives two signature values, its minimum and its maximum over the set, so half the
  hash evaluations fill the same bands.  Minima and maxima go to separate bands of ``rows`` values.
* Documents with equal sets form a class; only classes take part in what follows.
* In each band bucket every class is compared with the bucket's smallest class (a star, linear in
  the bucket).  Classes that are still in different components of a bucket are then compared with
  each other in blocks of ``block`` by ``block`` classes (fewer if their sets are large), so nothing a band
  proposes stays untested, no bucket is capped and no bucket has to fit in one task.  Of buckets that
  have the same classes one is compared.
* A comparison looks at the sizes and at a parity sketch of 1,024 bits first (both exclude links
  with certainty), then at the sets.

A link is missed only if all bands miss it: at the threshold with probability `miss`, less above.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.hashing import U64, mix
from sparkloom.llm.shingles import _FACTORS, shingle_sets
from sparkloom.llm.store import materialize, release, row_ids


#: Members of a set that a block plans for.
MEMBERS = 1000


def band_count(percent: int, rows: int, miss: float) -> int:
    """Bands (an even number) so that a pair at the threshold meets in none with probability `miss`."""
    n = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
    return n + n % 2


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Band keys of one set: those of minima first, then those of maxima."""
    low, high = None, None
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            v = x[None, i : i + 4096] * a[:, None]
            v += b[:, None]
            lo, hi = v.min(axis=1), v.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        parts = np.concatenate([low, high]).reshape(-1, rows)
        return mix((parts * _FACTORS[:rows]).sum(axis=1, dtype=U64) + np.arange(len(parts), dtype=U64) * _FACTORS[40])


def sketch(x: np.ndarray) -> np.ndarray:
    """Parity of the members in each of 1,024 cells: two sketches differ in no more bits than the sets in members."""
    return np.packbits((np.bincount((x >> U64(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(U64)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(k: int, bands: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(20240229))
    n = bands * rows // 2
    a = rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n, dtype=U64) * U64(2)

    def go(batches):
        for batch in batches:
            size, c1, c2, keys = [], [], [], []
            for x in shingle_sets(batch.column(2), k):
                size.append(len(x))
                with np.errstate(over="ignore"):
                    c1.append(int(_i64(mix(x).sum(dtype=U64, keepdims=True))[0]) if len(x) else None)
                    c2.append(int(_i64(mix(x * _FACTORS[41]).sum(dtype=U64, keepdims=True))[0]) if len(x) else None)
                keys.append(_i64(signature(x, a, b, rows)) if len(x) else None)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["_uid", "_id", "n", "c1", "c2", "bands"],
            )

    return go


def _sets(k: int):
    def go(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_i64(x) for x in sets], pa.list_(pa.int64())), pa.array([_i64(sketch(x)) for x in sets], pa.list_(pa.int64()))],
                names=["cid", "n", "members", "sketch"],
            )

    return go


def _blocks(percent: int):
    """Rows sorted by (key, i, j): links between different components within each block pair."""

    def pairs(ids, chunk, comp, n, sets, sketches, i, j):
        left, right = (np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        parent = {c: c for c in np.unique(comp).tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for p in left:
            others = right[right > p] if i == j else right
            others = others[comp[others] != comp[p]]
            if not len(others):
                continue
            total = n[others] + n[p]
            apart = np.bitwise_count(sketches[others] ^ sketches[p]).sum(axis=1, dtype=np.int64)
            small = np.minimum(n[others], n[p])
            fits = ((100 + percent) * apart <= (100 - percent) * total) & ((100 + percent) * small >= percent * total)
            for q in others[fits]:
                a, b = root(int(comp[p])), root(int(comp[q]))
                if a == b:
                    continue
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * common >= percent * (n[p] + n[q] - common):
                    parent[a] = b
                    yield int(ids[p]), int(ids[q])

    def solve(rows: pa.Table):
        keys = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [*np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]).tolist(), rows.num_rows]
        ids, chunk, comp, n = (rows.column(c).to_numpy() for c in ("cid", "chunk", "component", "n"))
        members, sketches = rows.column("members").combine_chunks(), rows.column("sketch").combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if len(np.unique(comp[a:b])) < 2:
                continue
            sets = [members[x].values.to_numpy().view(U64) for x in range(a, b)]
            marks = np.stack([sketches[x].values.to_numpy().view(U64) for x in range(a, b)])
            yield from pairs(ids[a:b], chunk[a:b], comp[a:b], n[a:b], sets, marks, keys[1, a], keys[2, a])

    def go(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            found = list(solve(pa.Table.from_batches(held)))
            return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = np.stack([part.column(c).to_numpy() for c in ("key", "i", "j")])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                before = [held[-1].column(c)[-1].as_py() for c in ("key", "i", "j")] if held else None
                cut = 0 if held and before != keys[:, 0].tolist() else (int(cuts[0]) if len(cuts) else None)
                if cut is not None and held:
                    if cut:
                        held.append(part.slice(0, cut))
                    yield flush()
                    held, part = [], part.slice(cut)
                    cuts = cuts - cut
                if len(cuts) and cuts[-1] > 0:
                    held.append(part.slice(0, int(cuts[-1])))
                    yield flush()
                    held, part = [], part.slice(int(cuts[-1]))
                if part.num_rows:
                    held.append(part)
        if held:
            yield flush()

    return go


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, as a written table: sizes and sketches first, full sets for the rest."""
    side = lambda c, *cols: sets.select(F.col("cid").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols]).hint("merge")
    light = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("a_n") + F.col("b_n")
    light = light.where((F.least("a_n", "b_n") * (100 + percent) >= total * percent) & (apart * (100 + percent) <= total * (100 - percent))).select("a", "b")
    light = materialize(light, "candidates")
    full = light.join(side("a", "n", "members"), "a").join(side("b", "n", "members"), "b")
    common = F.size(F.array_intersect("a_members", "b_members"))
    found = materialize(full.withColumn("common", common).where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent).select("a", "b"), "confirmed")
    release(light)
    return found


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85, rows: int = 4, miss: float = 1e-9, block: int = 1024
) -> DataFrame:
    """(_uid, id, n_shingles, component_id, kept) for every row of docs.

    Linked are documents whose sets of `words`-word shingles (ASCII white space parts words, A-Z is
    lower-cased) meet ``100 * intersection >= percent * union``; component_id is the smallest id
    reachable and kept says that the row's id is that.  Null, empty and blank texts have no
    shingles and are linked with nothing.  Equal texts are linked.  A null id counts as larger than
    all others: its component_id is null only where the component has no id at all.  Rows that
    repeat an id are separate documents.  `_uid` tells rows apart (the id itself where ids are
    unique integers).  Empty tables give empty results.
    """
    bands = band_count(percent, rows, miss)
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    ids, _ = row_ids(base, "_id", ["_id", "text"])
    kind = base.schema["_id"].dataType.simpleString()
    found = materialize(ids.select("_uid", "_id", "text").mapInArrow(_signatures(words, bands, rows), f"_uid long, _id {kind}, n long, c1 long, c2 long, bands array<long>"), "signatures")
    classes = materialize(
        found.where("n > 0").groupBy("c1", "c2").agg(F.min("_uid").alias("cid"), F.min("_id").alias("least"), F.first("bands").alias("bands"), F.first("n").alias("n")), "classes"
    )
    keyed = classes.select("cid", "n", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).where("size > 1"), "buckets")
    members = materialize(keyed.join(buckets.hint("merge"), "key").where("cid != pivot"), "members")
    wanted = materialize(members.select("cid").unionByName(members.select(F.col("pivot").alias("cid"))).distinct(), "wanted")
    sets = materialize(
        ids.join(wanted.withColumnRenamed("cid", "_uid").hint("merge"), "_uid").select("_uid", "text").mapInArrow(_sets(words), "cid long, n long, members array<long>, sketch array<long>"), "sets"
    )
    pairs = materialize(members.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct(), "star")
    star = _confirmed(pairs, sets, percent)
    release(buckets, wanted, pairs)
    first = connected_components(star)
    labelled = materialize(  # the pivot has been compared with all
        members.where("size > 2").join(first.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select("key", "cid", "n", F.coalesce("component", "cid").alias("component")), "labelled"
    )
    release(members)
    whole = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("left"), F.sum("n").alias("weight"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("two")).where("low != high")
    open_ = materialize(whole.groupBy("left", "weight", "one", "two").agg(F.min("key").alias("key")).select("key", "left", "weight"), "open")
    # A block has `block` classes of MEMBERS members each, or fewer that are larger.
    parts = F.ceil(F.greatest(F.col("left") / F.lit(float(block)), F.col("weight") / F.lit(float(block * MEMBERS)))).cast("int")
    spread = (
        labelled.join(open_.hint("merge"), "key")
        .withColumn("parts", parts)
        .withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "cid", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    work = spread.join(sets.hint("merge"), "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    last = materialize(work.mapInArrow(_blocks(percent), "a long, b long"), "rest")
    final = connected_components(star.unionByName(last)) if last.limit(1).count() else first
    grouped = classes.join(final.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = materialize(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = materialize(grouped.select("c1", "c2", "component").join(smallest.hint("merge"), "component").select("c1", "c2", F.lit(True).alias("_in"), "component_id"), "named")
    release(classes, sets, star, last, labelled, open_, first, final, smallest)
    out = found.join(named.hint("merge"), ["c1", "c2"], "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("_id"))
    return out.select("_uid", F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs of which each group of near-duplicates has one: the smallest id, and of rows
    that share it the first.  Columns stay as they are."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{options.get('text_col', 'text')}`").alias("text"))
    ids, written = row_ids(packed, "_id", ["_id", "text", "_row"])
    found = near_duplicates(ids.select(F.col("_uid").alias("_key"), "text"), id_col="_key", **{**options, "text_col": "text"}).drop("_key")
    if written:  # by id first, then by row
        tagged = ids.select("_uid", "_id").join(found.select(F.col("_uid"), "component_id", "n_shingles"), "_uid")
        first = tagged.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "_uid"))["_uid"].alias("_uid"))
        keep = materialize(first, "kept")
    else:
        keep = materialize(found.where("kept").select("_uid"), "kept")
    return ids.join(keep.hint("merge"), "_uid", "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
