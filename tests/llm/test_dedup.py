import collections
import hashlib
import re

import numpy as np
import pytest

from sparkloom.llm.components import connected_components
from sparkloom.llm.minmax_dedup import band_count, keep_one, near_duplicates, sketch
from sparkloom.llm.suffix_dedup import remove_repeats, repeated_starts

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = collections.Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if n[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "anchor", "cap"), [(200, 64, 1024), (200, 64, 0), (50, 20, 2), (13, 5, 1024)])
def test_repeats_by_brute_force(spark, odd_docs, length, anchor, cap):
    got = collections.Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(odd_docs, length=length, anchor=anchor, group_cap=cap).collect())
    rows = odd_docs.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows], length), strict=True))
    assert got == want


def test_repeats_in_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: x for r, x in zip(rows, brute_repeats([r.text for r in rows], 200), strict=True)}
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()} == want


def test_whole_characters(spark, odd_docs, no_docs):
    out = remove_repeats(odd_docs, whole_characters=True)
    assert out.columns == [*odd_docs.columns, "n_removed", "n_spans", "kept_sha256"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[4].text is None and rows[1].text == "" and rows[7].text == "One" and rows[1].spans == "keep me" and rows[1]._uid == 7
    assert rows[14].text.startswith("é") or rows[14].n_removed % 2 == 0
    assert remove_repeats(no_docs).collect() == []


def test_very_long_text_in_pieces(spark, monkeypatch):
    from sparkloom.llm import suffix_dedup

    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(97, 123, 6000)))
    text += text[1000:1500] + "x" + text[2000:2300]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    data = np.frombuffer(text.encode(), np.uint8)
    found = [(base + a, base + b) for part, off, base in suffix_dedup.pieces(data, np.array([0, len(data)]), 200) for _, _, _, _, a, b, _ in zip(*suffix_dedup.runs(part, off, 200, 64), strict=True)]
    starts = sorted(s for a, b in found for s in range(a, b + 1))
    assert starts == list(range(len(text) - 199))


def thue_morse(n, a, b):
    """A text and its complement: every polynomial over the bytes modulo a power of two takes them for equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_structured_texts_stay_apart(spark):
    pairs = [t for n in (1024, 4096) for a, b in (("a", "b"), ("abcdefgh", "ijklmnop")) for t in thue_morse(n, a, b)]
    rows = list(enumerate(pairs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {i: i for i, _ in rows}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(pairs, 200)))


def test_names_with_dots_and_inner_names(spark):
    df = spark.createDataFrame([(1, "x" * 300, "k", 5)], "`doc.id` long, `text.a` string, kept_text string, `b.c` int")
    out = remove_repeats(df, id_col="doc.id", text_col="text.a", whole_characters=True)
    assert out.columns == ["doc.id", "text.a", "kept_text", "b.c", "n_removed", "n_spans", "kept_sha256"]
    assert [(r[0], r[2], r[3], r.n_removed) for r in out.collect()] == [(1, "k", 5, 300)]
    assert keep_one(df, id_col="doc.id", text_col="text.a").collect() == df.collect()


def test_periodic_texts(spark):
    texts = ["Aningti " * 300, "Aningti " * 20 + "end", "ab" * 150, "xyz" * 66 + "xy", "q" * 199, "q" * 200, "q" * 201 + "Aningti " * 26]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(rows).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


def test_radix_passes():
    data = np.frombuffer(b"abcabcabcXabcabcabcY", np.uint8)
    starts = np.arange(len(data) - 7)
    want = collections.Counter(bytes(data[s : s + 8]) for s in starts)
    assert repeated_starts(data, starts, 8).tolist() == [want[bytes(data[s : s + 8])] > 1 for s in starts]
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    for length, anchor in ((3, 1), (13, 5), (16, 8), (21, 16), (24, 24)):
        starts = np.arange(len(data) - length + 1)
        want = collections.Counter(bytes(data[s : s + length]) for s in starts)
        assert repeated_starts(data, starts, length, anchor=anchor).tolist() == [want[bytes(data[s : s + length])] > 1 for s in starts]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_links(sets, percent):
    """Root of each index, all pairs compared."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    roots, least = brute_links(sets, percent), {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return collections.Counter((i, len(s), least.get(r), i == least.get(r)) for (i, _), s, r in zip(rows, sets, roots, strict=True))


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    want = brute_components([(r.doc_id, r.text) for r in odd_docs.collect()], 3, 85)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs).collect()) == want
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 1024), (5, 80, 2)])
def test_near_duplicates_of_edited_copies(spark, words, percent, block):
    """A hot group of copies with 0 to 12 edits: many links near the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(160):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 13)):
            w[at] = f"e{rng.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=words, percent=percent, block=block).collect())
    assert got == brute_components(rows, words, percent)


def test_keep_one(spark, odd_docs, no_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    want = {r[0] for r in brute_components([(r.doc_id, r.text) for r in odd_docs.collect()], 3, 85) if r[3]}
    assert set(ids) - {None} == want - {None} and max(ids.values()) == 1
    assert keep_one(no_docs).collect() == []


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100}


def test_sketch_bound_and_bands():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        x = np.union1d(x, y[: len(y) // 2])
        assert np.bitwise_count(sketch(x) ^ sketch(y)).sum() <= len(np.setxor1d(x, y))
    assert (1 - 0.85**4) ** band_count(85, 4, 1e-9) <= 1e-9 and band_count(85, 4, 1e-9) % 2 == 0
