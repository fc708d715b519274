import re

import pytest

import corpus_pipeline
from sparkloom.llm import queries
from tests.llm.test_dedup import brute_components, brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's output on what its predecessor kept."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(("documents", docs.collect()))
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf).cache()
        out.append((name, docs.collect()))
        if name != "bpe":
            assert docs.columns == COLUMNS
    return dict(out)


def test_language_keeps_prose(stages):
    assert {r.doc_id for r in stages["documents"] if re.search(r"\w", r.text) and len(r.text) > 40} <= {r.doc_id for r in stages["language_id"]}


def test_near_dedup_stage(stages):
    want = {r[0] for r in brute_components([(r.doc_id, r.text) for r in stages["language_id"]], 5, 80) if r[3]}
    assert {r.doc_id for r in stages["near_dedup"]} == want


def test_exact_dedup_stage(stages):
    rows = stages["near_dedup"]
    removed = {r.doc_id: x[0] for r, x in zip(rows, brute_repeats([r.text for r in rows], 200), strict=True)}
    before, after = {r.doc_id: r.text for r in rows}, {r.doc_id: r for r in stages["exact_dedup"]}
    assert any(removed.values())
    for d, n in removed.items():
        if not n:
            assert after[d].text == before[d]
        elif d in after:  # characters on a border stay, so a few bytes less may go
            assert 0 <= n - (len(before[d].encode()) - len(after[d].text.encode())) <= 40 and after[d].n_chars == len(after[d].text)
    left = [r.text for r in stages["exact_dedup"]]
    assert all(x[0] == 0 for x in brute_repeats(left, 400))


def test_decontaminate_stage(spark, sf, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [word.findall(t.lower())] for i in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages["exact_dedup"] if not any(len(s & grams(r.text)) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in stages["decontaminate"]} == want


def test_bpe_stage_and_run(spark, sf, stages):
    assert {r.doc_id for r in stages["bpe"]} == {r.doc_id for r in stages["decontaminate"]}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages["bpe"]}


def test_stages_of_odd_rows(spark, sf, odd_docs, no_docs):
    """Nulls, empty and very long texts, rows that repeat, extra columns with clashing names, empty tables, no n_chars."""
    more = spark.createDataFrame([(20 + k, t, "en", "s", None, "keep me", None, 7) for k, t in enumerate(["A.", "De.", "...", "word " * 100_000])], odd_docs.schema)
    docs = odd_docs.unionByName(more).selectExpr("*", "1 as score", "2 as `a.b`", "3 as n_removed", "4 as lang_pred", "5 as ids", "6 as component_id")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf)
        empty = f(spark, no_docs, sf)
        assert empty.collect() == []
        if name == "bpe":
            assert out.count() == docs.count() and {"a.b", "doc_id", "n_tokens", "ids"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and {r.spans for r in out.collect()} <= {"keep me"} and {r["a.b"] for r in out.collect()} <= {2} and {r.n_removed for r in out.collect()} <= {3}
            assert f(spark, docs.drop("n_chars"), sf).count() == out.count()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert {4, 5, 6, 22} <= kept and 2 not in kept
    left = {r.doc_id: r.text for r in corpus_pipeline.exact_dedup(spark, docs, sf).collect()}
    assert left[4] is None and left[5] == "" and 1 not in left and 23 not in left


def test_short_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = spark.createDataFrame([(-1, "A."), (-2, "Re."), (-3, "x"), (-4, "..."), (-5, None)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(short, allowMissingColumns=True), sf).collect()}
    assert {-1, -2, -3} <= kept and not {-4, -5} & kept


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    if name.startswith("op4_"):
        assert rows > 0
    else:
        table = "pages" if name[:4] in ("op6_", "op8_") else "documents"
        assert rows == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in r.description]
    rows = lambda x: sorted(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in x)
    assert rows(r.asDict() for r in queries.QUERIES[name](spark, sf).collect()) == rows(dict(zip(columns, x, strict=True)) for x in r.fetchall())
