import base64
import collections
import json
import math
import random
import re
import unicodedata

import numpy as np
import pytest

from sparkloom.llm import compression_quality, decontaminate, language_bloom, license_scan, lm_difference, url_trees, warc_salvage
from sparkloom.llm.bpe_automaton import MergeAutomaton, WordCoder, encode_documents

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def greedy(word, ids, merges):
    """Plain BPE: the merges in their order, each from left to right."""
    parts = [*word[:-1], word[-1] + "</w>"]
    for u, v in merges:
        out = []
        for p in parts:
            if out and out[-1] == u and p == v:
                out[-1] = u + v + "\0"
            else:
                out.append(p)
        parts = [p.rstrip("\0") for p in out]
    return [ids[p] for p in parts]


def explicit(ids, merges):
    """The automaton's arcs, gadget by gadget, as a full table."""
    n = len(ids)
    arcs, alive = np.ones((n, n), bool), np.zeros(n, bool)
    made = {u + v for u, v in merges}
    for t, i in ids.items():
        alive[i] = t not in made
    for u, v in merges:
        a, b, ab = ids[u], ids[v], ids[u + v]
        row = arcs[b].copy()
        own = arcs[b, a]
        arcs[a, b] = False
        arcs[:, ab] = arcs[:, a]
        arcs[ab] = row
        arcs[ab, ab] = own
        alive[ab] = True
    return arcs


@pytest.mark.parametrize("seed", range(6))
def test_gadgets_against_plain_merges(seed):
    rng = random.Random(seed)
    base = [*"abc", *(c + "</w>" for c in "abc")]
    tokens, merges = list(base), []
    while len(merges) < 25:
        u, v = rng.choice([t for t in tokens if not t.endswith("</w>")]), rng.choice(tokens)
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    ids = {t: i for i, t in enumerate(tokens)}
    automaton = MergeAutomaton(ids, merges)
    arcs = explicit(ids, merges)
    for x in range(len(ids)):
        if not tokens[x].endswith("</w>"):
            assert [automaton.allows(x, y) for y in range(len(ids))] == arcs[x].tolist()
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert automaton.encode(word.encode()) == greedy(word, ids, merges)


def test_bpe_equals_the_library(spark, sf, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(PATH), WordCoder(json.load(open(PATH)))
    rng = random.Random(1)
    pool = ["hello", "<|endoftext|>", "<|startoftext|>", "<|", "ΣΑΣ", "İstanbul", "é", "é", "'s", "DON'T", "12345", "日本語", "aaaa", "!!!???", " ", "\x1c", "\x85", "ß", "ﬁ", "㎏", "\n", "😀😀", "_a_", "ǅ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["a" + chr(c) * 2 + "b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c > 0xA000 and unicodedata.category(chr(c)) in ("Cn", "Lu", "Ll", "Mn", "No"))]
    texts += ["x" * 3000 + "Y" * 2000, "ab" * 700 + " " + "é" * 900]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.texts(t) == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)), t
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in encode_documents(docs, PATH, keep_ids=True, keep_decoded=True).collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    out = encode_documents(odd_docs, PATH).collect()
    assert {r.n_tokens for r in out if not (r.text or "").strip()} == {0} and all(r.spans == "keep me" for r in out)
    assert encode_documents(no_docs, PATH).collect() == []


def test_caches_are_bounded_and_change_nothing(monkeypatch):
    from sparkloom.llm import bpe_automaton

    spec = json.load(open(PATH))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))) for _ in range(4000)] + ["z" * 5000]
    want = [WordCoder(spec).texts(w) for w in words[:1]] and [c.texts(w) for c in [WordCoder(spec)] for w in words]
    monkeypatch.setattr(bpe_automaton, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(bpe_automaton, "TABLE", 500)
    monkeypatch.setattr(bpe_automaton, "ARCS", 50)
    coder = WordCoder(spec)
    assert [coder.texts(w) for w in words] == want
    assert len(coder.known) + len(coder.old) < 200 and max(map(len, coder.known)) <= bpe_automaton.CACHE_WORD and len(coder.automaton.arcs) <= 50


def test_quality_by_brute_force(spark, odd_docs, no_docs):
    for r in compression_quality.quality(odd_docs).collect():
        t = r.text or ""
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r.kept)
    assert compression_quality.quality(no_docs).collect() == []


def test_compression_bands(spark):
    rng = random.Random(0)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(400))
    same = " ".join(f"x{i}" for i in range(30)) + " " + "y" * 9000
    rows = spark.createDataFrame([(1, prose), (2, noise), (3, same)], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in compression_quality.quality(rows).collect()} == {1: True, 2: False, 3: False}


def test_compression_bands_decide(spark, sf):
    """Random base64 words fail at any length, also as the tail of prose; clean documents stay."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = compression_quality.quality(docs).where("not base_failed and n_symbols <= 0.1 * n_words").collect()
    assert len(rows) > 500 and all(r.kept for r in rows)
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(rng.randint(3, 9))).decode() for _ in range(n))[:n]
    prose = next(r.text for r in rows if len(r.text.encode()) > 1024)
    while len(prose.encode()) > 1024:
        prose = prose[:-1]
    texts = [noise(n) for n in (216, 300, 433, 700, 1013, 2890, 20_000)] + [prose + noise(600)]
    out = compression_quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.base_failed, r.kept) for r in out] == [(False, False)] * len(texts)


def test_licenses_by_brute_force(spark, odd_docs, no_docs):
    texts = ["under the MIT license. Under the mit License", "Apache License, Version 2.0 and cc-by-nc CC BY NC", "licensed under the GNU General Public License, version 3", "the mit license under the", "cc by cc by nc by nc", None, "é under the mit license", "THIS IS FREE and unencumbered software released into the public domain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(odd_docs.selectExpr("cast(doc_id as int) doc_id", "text"))
    for r in license_scan.scan_licenses(df).collect():
        w = license_scan.word_list(r.text or "")
        places = [(label, k) for label, p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for _, k in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if r.text and "GNU" in r.text:
            assert r.labels == "gpl-3"
        if r.text and "unencumbered" in r.text:
            assert r.labels == "unlicense"
    assert license_scan.scan_licenses(no_docs).collect() == []


def test_license_texts_are_found(spark):
    """Every text of the index under its own label, also with other words around and a few changed; the given names apart."""
    own = license_scan.templates()
    rng = random.Random(2)
    other = lambda: " ".join("".join(rng.choice("bcdfg") for _ in range(5)) for _ in range(30))
    texts = [f"{other()} {text} {other()}" for _, text, _ in own]
    named = [
        ("Mozilla Public License Version 2.0", "mpl-2"), ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
        ("under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("GNU General Public License version 2", "gpl-2"), ("GNU General Public License, Version 3", "gpl-3"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("license version public general", ""), ("the permission to use software is granted", ""),
    ]
    df = spark.createDataFrame(list(enumerate([*texts, *(t for t, _ in named)])), "doc_id int, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for k, (label, text, _) in enumerate(own):
        assert label in rows[k].labels.split(","), (label, text, rows[k].labels)
    for k, (text, label) in enumerate(named, len(own)):
        assert rows[k].labels == label and (rows[k].score > 0) == bool(label), (text, rows[k].labels)


def test_method_labels_by_brute_force(spark, sf):
    """Places, votes and key phrases of every template at every word of every document."""
    index = license_scan.Index()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(-1 - k, f"x y z {t} q {t[: len(t) // 2]} mit") for k, (_, t, _) in enumerate(license_scan.templates())]
    rows = license_scan.scan_licenses(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()
    for r in rows:
        w = license_scan.word_list(r.text)
        base = {label for label, p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        found = set()
        for t, (label, text, keys, exact) in enumerate(index.entries):
            chosen = {n: [k for x, k in index.postings[index.names.index(n)] if x == t] for n in index.names if any(x == t for x, _ in index.postings[index.names.index(n)])}
            if exact or not set(chosen) & set(w):
                continue
            for s in {p - k for p, x in enumerate(w) for k in chosen.get(x, ())}:
                agree = {n for n, places in chosen.items() if any(0 <= s + d + k < len(w) and w[s + d + k] == n for k in places for d in range(-license_scan.SLACK, license_scan.SLACK + 1))}
                around = w[max(0, s - license_scan.SLACK) : max(0, s + len(text) + license_scan.SLACK)]
                if sum(index.idf[n] for n in agree) >= license_scan.AGREE * index.votes[t] - 1e-9 and all(any(around[k : k + len(key)] == key for k in range(len(around))) for key in keys):
                    found.add(label)
        assert r.labels == ",".join(sorted(base | found)), r.doc_id


def test_warc_round_trip(spark, sf):
    rows = [(1, "http://a/ b", "x\r\n\r\ny"), (3, None, "same"), (2, "u", "same"), (2, "v", "same"), (None, "w", "same"), (5, "z", None), (6, "q", ""), (7, "q", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "html"))
    groups = collections.defaultdict(list)
    for r in pages.collect():
        groups[(r.html or "").encode()].append(r.page_id)
    want = collections.Counter()
    for payload, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            again = first is not None and i != first
            want[(i, len(payload), warc_salvage.sha1_base32(payload), "revisit" if again else "response", first if again else None)] += 1
    for compress in (False, True):
        got = warc_salvage.round_trip(pages, compress=compress, archive_bytes=20_000).collect()
        assert {r.kind for r in got} == {"record"}
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc_salvage.round_trip(pages.limit(0)).collect() == []


def test_salvage_recovers_and_logs():
    one = lambda i: warc_salvage.format_record(i, "u", b"payload %d" % i * 40, warc_salvage.sha1_base32(b"payload %d" % i * 40))
    import gzip

    for records in ([one(i) for i in range(12)], [gzip.compress(one(i)) for i in range(12)]):
        raw = b"".join(records)
        rng = random.Random(2)
        for _ in range(120):
            damaged = bytearray(raw)
            damaged[rng.randrange(len(raw))] ^= 0x55
            parts = list(warc_salvage.salvage(bytes(damaged)))
            assert sum(p[0] == "record" for p in parts) >= 11
            cut = rng.randrange(len(raw))
            missing = raw[:cut] + raw[cut + rng.randrange(1, 300) :]
            parts = list(warc_salvage.salvage(missing))
            spans = sorted({(p[1], p[2]) for p in parts})
            assert spans[0][0] == 0 and spans[-1][1] == len(missing) and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
            assert sum(p[0] == "record" for p in parts) >= 9
    assert list(warc_salvage.salvage(b"")) == [] and [p[0] for p in warc_salvage.salvage(b"junk")] == ["gap"]


def test_salvage_inside_members():
    """Valid records of gzip archives stay, whatever fails beside them."""
    import gzip
    import hashlib
    import itertools

    def record(i, digest=None, n=900):
        payload = random.Random(i).randbytes(n // 2).hex().encode()
        return warc_salvage.format_record(i, "u", payload, digest or warc_salvage.sha1_base32(payload))

    def ids(raw):
        parts = list(itertools.islice(warc_salvage.salvage(raw), 1000))
        spans = sorted({(p[1], p[2]) for p in parts})
        assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        return [int(p[3]["warc-record-id"][10:-1]) for p in parts if p[0] == "record"], [p[3] for p in parts if p[0] == "gap"]

    wrong = warc_salvage.sha1_base32(b"other")
    for bad in range(12):
        raw = b"".join(gzip.compress(record(i, wrong if i == bad else None)) for i in range(12))
        assert ids(raw) == ([i for i in range(12) if i != bad], ["payload digest"])
    assert ids(gzip.compress(b"".join(record(i, wrong if i == 1 else None) for i in range(4)) + b"\r\n") + gzip.compress(record(4))) == ([0, 2, 3, 4], ["payload digest"])
    assert ids(gzip.compress(record(0) + b"WARC/1.1\r\njunk\r\n\r\n" + record(1))) == ([0, 1], ["header line without a colon"])
    for level in (0, 6):
        long = gzip.compress(b"".join(record(i, n=20_000) for i in range(10)), level)
        for cut in (len(long) * 2 // 3, len(long) - 3):
            got = ids(long[:cut] + gzip.compress(record(10)))[0]
            assert got[-1] == 10 and got[:-1] == list(range(len(got) - 1)) and len(got) >= 6
        crc = bytearray(long)
        crc[-6] ^= 1
        assert ids(bytes(crc) + gzip.compress(record(10)))[0] == list(range(11))
    payload = random.Random(5).randbytes(450).hex().encode()
    for good, other in ((hashlib.sha1(payload).hexdigest(), hashlib.sha1(b"").hexdigest()), (wrong[:-4], None)):
        assert ids(record(5, good))[0] == [5] and (other is None or ids(record(5, other))[0] == [])
    for name, check in (("sha256", True), ("md5", True), ("blake3", False)):
        digest = hashlib.new(name if check else "sha256", payload).hexdigest()
        for text, want in ((digest, [5]), ("0" * len(digest), [] if check else [5])):
            assert ids(record(5).replace(b"Payload-Digest: sha1:" + warc_salvage.sha1_base32(payload).encode(), f"Payload-Digest: {name}:{text}".encode()))[0] == want


def test_salvage_does_not_trust_lengths():
    """A forged length that ends at a later record's end mark hides none of the records between."""
    import gzip

    def record(i):
        payload = random.Random(i).randbytes(300).hex().encode()
        return warc_salvage.format_record(i, "u", payload, warc_salvage.sha1_base32(payload))

    for bad in range(8):
        for reach in range(1, 9 - bad):
            records = [record(i) for i in range(9)]
            length = re.search(rb"\nContent-Length: (\d+)", records[bad])
            forged = int(length[1]) + sum(map(len, records[bad + 1 : bad + 1 + reach]))
            records[bad] = records[bad].replace(length[0], b"\nContent-Length: %d" % forged)
            raw = b"".join(records)
            for archive, inner in ((raw, False), (gzip.compress(raw), True), (b"".join(map(gzip.compress, records)), False)):
                parts = list(warc_salvage.salvage(archive))
                got = [int(p[3]["warc-record-id"][10:-1]) for p in parts if p[0] == "record"]
                assert got == [i for i in range(9) if i != bad]
                spans = sorted({(p[1], p[2]) for p in parts})
                assert spans[0][0] == 0 and spans[-1][1] == len(archive) and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
                assert inner or sum(p[0] == "gap" for p in parts) == 1


def test_archives_of_odd_pages(spark):
    """Very long pages and columns with the names of results."""
    rows = [(1, "u", "x" * 3_000_000, "a", "b"), (2, None, "x" * 3_000_000, None, "b"), (3, "v" * 70_000, "é\r\n\r\nWARC/1.1\r\n", "a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, sha string")
    for compress in (False, True):
        got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_salvage.round_trip(pages, compress=compress).collect())
        assert got == [(1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), (3, 16, "response", None)]


@pytest.mark.parametrize(
    ("url", "parts", "rule"),
    [
        ("http://A.net/x?y#z", ("a.net", "/x"), "net/"), ("https://b.example.net/en/1", ("b.example.net", "/en/1"), "example.net/en/"), ("http://example.com/de/", ("example.com", "/de/"), "example.com/de/"),
        ("http://x.org/fr/a", ("x.org", "/fr/a"), "org/fr/"), ("http://x.net", ("x.net", ""), None), ("http://notexample.com/de/1", ("notexample.com", "/de/1"), None), (None, ("", ""), None), ("no scheme", ("", ""), None), ("ftp://net?/x", ("net", ""), None),
    ],
)
def test_url_rules(url, parts, rule):
    assert url_trees.split_url(url) == parts
    assert url_trees.Rules().match(*parts)[0] == rule


def test_url_sample_is_of_distinct_urls(spark):
    """One url of most rows is learned from once, and the sample is bounded by labelled urls."""
    rows = [("http://a.net/hot",)] * 5000 + [(f"http://b{i}.net/x{i}",) for i in range(600)] + [(f"http://c{i}.com/",) for i in range(600)] + [(None,), ("",), ("http://d.net/" + "y" * 100_000,)]
    pages = spark.createDataFrame(rows, "url string")
    urls, labels = url_trees.labelled_sample(pages)
    assert len(urls) == len(set(urls)) == 602 and set(labels) == {1}
    assert 0 < len(url_trees.labelled_sample(pages, sample=100)[0]) < 200
    out = url_trees.judge(pages, url_trees.UrlModel(urls, labels)).collect()
    assert len(out) == len(rows) and len({(r.verdict, r.score) for r in out if r.url == "http://a.net/hot"}) == 1


def test_trees_by_brute_force():
    """Each tree's splits are the best of all thresholds, and a prediction is the sum of its leaves."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (300, 3)).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5)).astype(float)
    model = url_trees.Trees(trees=3, depth=2).fit(x, y)
    score = np.full(300, model.start)
    for split, value in model.nodes:
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        node = np.zeros(300, int)
        for k in range(len(split)):
            rows = node == k
            if rows.sum() < 10:
                continue
            best = max(gain(rows & (x[:, f] <= c)) + gain(rows & (x[:, f] > c)) for f in range(3) for c in range(8)) - gain(rows)
            if split[k, 0] >= 0:
                low = model._bin(x)[:, split[k, 0]] <= split[k, 1]
                assert abs(gain(rows & low) + gain(rows & ~low) - gain(rows) - best) < 1e-6
                node[rows] = 2 * k + 1 + ~low[rows]
        score += value[node]
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-score))) and np.mean((model.predict(x) > 0.5) == y) > 0.9


def test_url_trees_on_held_out_urls(spark, sf):
    pages = spark.read.parquet(sf.replace("0.001", "0.1") + "/pages.parquet")
    urls, labels = url_trees.labelled_sample(pages)
    train = [k for k in range(len(urls)) if k % 4]
    model = url_trees.UrlModel([urls[k] for k in train], [labels[k] for k in train])
    test = [k for k in range(len(urls)) if k % 4 == 0]
    p = model.block([urls[k] for k in test], [url_trees.split_url(urls[k]) for k in test])
    assert np.mean((p >= 0.5) == np.array([labels[k] for k in test])) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "http://é.net/", "x")], "page_id int, url string, host string")
    rows = {r.page_id: r for r in url_trees.judge(odd, model).collect()}
    assert rows[1].host == "" and rows[1].rule is None and rows[1].verdict in ("allow", "block") and rows[3].rule == "net/"
    empty = url_trees.UrlModel([], [])
    assert [r.verdict for r in url_trees.judge(odd.limit(0), empty).collect()] == []
    assert {r.verdict for r in url_trees.judge(odd.limit(1), empty).collect()} <= {"allow", "block"}


def test_language_on_held_out_documents(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet")
    model = language_bloom.fit(docs)
    from pyspark.sql import functions as F

    held = language_bloom.identify(docs, model).where("crc32(cast(doc_id as string)) % 3 = 1 and n_chars > 30")
    right, n = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.99
    rows = language_bloom.identify(odd_docs, model).collect()
    assert {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert language_bloom.identify(no_docs, model).collect() == []
    nothing = language_bloom.fit(no_docs)
    assert {r.lang_pred for r in language_bloom.identify(odd_docs, nothing).collect()} == {"und"}


def test_language_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 32, 3000, dtype=np.uint32)) for _ in range(70)]
    model = language_bloom.LanguageFilter([f"l{i}" for i in range(70)], sets, cells=1 << 16)
    for lang in (0, 63, 64, 69):
        g = sets[lang]
        counts = model.counts(g, np.zeros(len(g), int), 1)[0]
        assert counts[lang] == len(g) and model.decide(g, np.zeros(len(g), int), 1)[0][0] == lang


def brute_language(texts, sets):
    """(language, score) of each text by exact sets of n-grams: what a filter without false positives decides."""
    for t in texts:
        low = [b + 32 if 65 <= b < 91 else b if b > 127 or 97 <= b < 123 else 32 for b in (t or "").encode()]
        low = [32, *low, 32]
        g = [tuple(low[k : k + 4]) for k in range(len(low) - 3) if low[k : k + 2] != [32, 32]]
        share = [(sum(x in s for x in g) / max(1, len(g)), lang) for lang, s in sorted(sets.items())]
        best = max(s for s, _ in share)
        yield next(lang for s, lang in share if s == best), best


def test_language_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.where("crc32(cast(doc_id as string)) % 3 != 1 and lang is not null").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        low = [32, *(b + 32 if 65 <= b < 91 else b if b > 127 or 97 <= b < 123 else 32 for b in r.text.encode()), 32]
        counts[r.lang].update(tuple(low[k : k + 4]) for k in range(len(low) - 3) if low[k : k + 2] != [32, 32])
    sets = {lang: {g for g, n in c.items() if n >= language_bloom.LEAST} for lang, c in counts.items()}
    model = language_bloom.fit(docs)
    texts = ["A.", "Re.", "x", "1", "", None, "é", "zz top", "AB" * 30_000] + [r.text for r in docs.collect()]
    got = language_bloom.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r, (lang, score) in zip(sorted(got, key=lambda r: r.doc_id), brute_language(texts, sets), strict=True):
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in r.text or "") and r.score == 0
        else:
            assert abs(r.score - score) < 0.02 and (r.lang_pred == lang or abs(dict((x, s) for s, x in [(next(brute_language([r.text], {k: v}))[1], k) for k, v in sets.items()])[r.lang_pred] - score) < 0.02)
    tie = language_bloom.LanguageFilter(["a", "b"], [np.array([1], np.uint32)] * 2)
    assert [r.lang_pred for r in language_bloom.identify(spark.createDataFrame([(1, "zzzz")], "doc_id int, text string"), tie).collect()] == ["a"]


def test_contamination_by_brute_force(spark, sf, odd_docs, no_docs):
    docs, items = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [word.findall(t.lower())] for i in range(len(w) - 4)}
    wanted = {r.item_id: grams(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        g = grams(r.text)
        want |= {(r.doc_id, i) for i, s in wanted.items() if len(s & g) >= 0.8 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want and want
    more = items.unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "...")], "item_id long, text string"))
    assert decontaminate.contaminated(odd_docs, more).collect() == [] and decontaminate.contaminated(no_docs, items).collect() == []
    assert decontaminate.contaminated(odd_docs, items.limit(0)).collect() == []
    assert decontaminate.clean_documents(odd_docs, items).count() == odd_docs.count()


def test_contamination_with_an_edited_short_answer(spark):
    words = [f"w{i}" for i in range(60)]
    question = " ".join(words[:40]) + "."
    other = " ".join(words[40:]) + " " + " ".join(f"z{i}" for i in range(20))
    items = spark.createDataFrame([(1, question + " Ñ."), (2, other + ". It is not so."), (3, other + ". a b c d e f g h i j")], "item_id long, text string")
    texts = [question + " Ñ.", question + " Other words.", question, other + ". It was not so.", other + ".", " ".join(words[:25]) + " Ñ.", other + ". a b c d e k l m n o"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (6, 2)}


def test_contamination_does_not_depend_on_the_parts(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    named = items.selectExpr("concat('item ', item_id) as item_id", "text")
    rows = lambda: sorted(tuple(r) for r in decontaminate.contaminated(docs, named).collect())
    want = rows()
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    got = rows()
    assert want and [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_retrieval_is_exact(spark, sf):
    """Block-max retrieval finds what scoring every item finds."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 40))) for _ in range(150)]
    index = decontaminate.ItemIndex(list(range(150)), items)
    found = 0
    for k in range(200):
        text = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=60)) + " " + items[k % 150][: rng.randint(0, 200)]
        terms = np.unique(index.lookup(np.unique(decontaminate.hashed([text])[0])))
        terms = terms[terms >= 0]
        score = np.zeros(150)
        for t in terms:
            a, b = index.first[t], index.first[t + 1]
            score[index.item[a:b]] += index.impact[a:b]
        got = {i: s for _, i, s in index.retrieve(np.zeros(len(terms), int), terms)}
        assert all((index.item[a:b] // decontaminate.BLOCK == q).all() and (index.term[a:b] == t).all() for a, b, q, t in zip(index.run[:-1], index.run[1:], index.b_block, index.b_term, strict=True))
        assert {i for i in range(150) if score[i] >= decontaminate.SCORE + 1e-9} <= set(got) <= {i for i in range(150) if score[i] >= decontaminate.SCORE - 1e-9}
        assert all(abs(got[i] - score[i]) < 1e-9 for i in got)
        found += len(got)
    assert found > 100


def brute_losses(texts, good, scored=None):
    """(tokens, target loss, background loss) of each text by the counts of all others; of `scored` by those of all."""
    split = lambda t: WORD.findall((t or "").lower())
    kept = {True: [split(t) if d in good else [] for d, t in enumerate(texts)], False: [split(t) for t in texts]}
    whole = {k: (collections.Counter(w for v in rows for w in v), collections.Counter(p for v in rows for p in zip(v[:-1], v[1:], strict=True))) for k, rows in kept.items()}
    size = len(whole[False][0]) + 1
    for d, text in enumerate(texts if scored is None else scored):
        w, losses = split(text), []
        for only in (True, False):
            mine = kept[only][d] if scored is None else []
            own = collections.Counter(mine), collections.Counter(zip(mine[:-1], mine[1:], strict=True))
            one, two = (lambda x, a=a, b=b: a[x] - b[x] for a, b in zip(whole[only], own, strict=True))
            total, loss = sum(whole[only][0].values()) - len(mine), 0.0
            for i, x in enumerate(w):
                weight = lm_difference.WEIGHT if i and one(w[i - 1]) else 0.0
                pair = two((w[i - 1], x)) / one(w[i - 1]) if weight else 0.0
                loss -= math.log(weight * pair + (1 - weight) * (one(x) + lm_difference.ADD) / (total + lm_difference.ADD * size))
            losses.append(loss / len(w) if w else None)
        yield len(w), *losses


def same_losses(rows, want):
    for r in rows:
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n and (r.difference is None) == (not n)
        if n:
            assert abs(r.target_loss - target) < 1e-6 and abs(r.background_loss - background) < 1e-6 and abs(r.difference - target + background) < 1e-6
    assert len(rows) == len(want)


LIMITS = ({}, {"bits": 1, "share": 0.2, "least": 1}, {"bits": 3, "share": 0.01, "least": 1}, {"bits": 0, "share": 1.0})


@pytest.mark.parametrize("limits", LIMITS)
def test_losses_by_brute_force(spark, limits):
    """Whatever is sent to the tasks, the losses are those of counting."""
    texts = ["a b a c", "a b b", "c c a", "B a", None, "", "a b zz", "c a b \u00e9", "only here", "a"] * 2 + ["a b a c " * 30, "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    good = docs.where("doc_id % 2 = 0").select("doc_id")
    same_losses(lm_difference.score(docs, good, **limits).collect(), dict(enumerate(brute_losses(texts, {d for d in range(len(texts)) if d % 2 == 0}))))
    other = ["a b zz", "new words", None, "c a b"]
    new = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    same_losses(lm_difference.score(new, good, corpus=docs, **limits).collect(), dict(enumerate(brute_losses(texts, {d for d in range(len(texts)) if d % 2 == 0}, other))))


def test_losses_of_odd_rows(spark, odd_docs, no_docs):
    rows = [r for r in odd_docs.collect()]
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, " + "doc_id long, text string, lang string, source string, n_chars long, spans string, kept boolean, _uid long")
    good = spark.createDataFrame([(2,), (None,), (8,), (8,)], "doc_id long")
    out = lm_difference.score(numbered, good)
    assert out.columns == [*numbered.columns, "n_tokens", "target_loss", "background_loss", "difference"]
    want = list(brute_losses([r.text for r in rows], {i for i, r in enumerate(rows) if r.doc_id in (2, 8)}))
    got = out.collect()
    assert all(r.spans == "keep me" and r._uid == 7 for r in got) and len(got) == len(rows)
    same_losses([type("R", (), {**r.asDict(), "doc_id": r.place}) for r in got], dict(enumerate(want)))
    assert lm_difference.score(no_docs, good).collect() == []
    none = lm_difference.score(numbered, good.limit(0)).collect()
    assert all(r.difference is None or math.isfinite(r.difference) for r in none)
    assert all(math.isfinite(r.difference) for r in lm_difference.score(numbered, good, corpus=no_docs).collect() if r.n_tokens)


def test_losses_count_every_word_and_bigram(spark):
    """Copies are told apart from single documents, and no word is unknown however many there are."""
    rng = random.Random(9)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.3)), 200_000)}" for _ in range(400)) for _ in range(300)]
    texts += [f"x{i} y{i} x{i}" for k in range(2) for i in range(40_000)] + [f"single{i} word{i}" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    good = docs.where("doc_id % 2 = 0").select("doc_id")
    want = dict(enumerate(brute_losses(texts, {d for d in range(len(texts)) if d % 2 == 0})))
    assert len({w for t in texts for w in t.split()}) > 1 << 16
    for limits in ({}, {"bits": 10, "share": 2.0**-10}):
        same_losses(lm_difference.score(docs, good, **limits).collect(), want)
    copies, singles = ([want[d][2] for d in r] for r in (range(300, 80_300), range(80_300, 85_300)))
    assert max(copies) < min(singles)
