import json
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import chunking
from sparkloom.operators.exact import estimate
from sparkloom.sources import tables


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n,1", max_size=600), st.integers(5, 60))
def test_chunks(text, most):
    parts = chunking.chunks(text, most=most, least=3)
    assert "".join(parts) == text
    assert all(estimate(p) <= most + 3 + most * (len(p.split()) == 1) for p in parts)


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "line one\n" * 300), (2, None), (3, "")], "k int, text string")
    rows = chunking.chunk_table(df, ["k"], most=100).collect()
    assert {r.k for r in rows} == {1} and len(rows) > 5


def test_annotate():
    text = "\n".join(f"line {i}" for i in range(10))
    out = chunking.annotate(text, "line 0\n[… 3 lines omitted …]\nline 4\nline 9")
    assert out.split("\n")[:5] == ["line 0", "[… lines 2-4 omitted …]", "line 4", "[… lines 6-9 omitted …]", "line 9"]
    assert chunking.annotate(text, "other") is None
    assert chunking.align(["a", "b", "a"], ["a", "a"]) == [True, False, True]


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_reindent(value):
    text = json.dumps(value, separators=(",", ":"))
    assert json.loads(chunking.reindent(text)) == value


def test_reindent_layout():
    assert chunking.reindent('{"a":[1E5,{}],"b":[]}') == json.dumps({"a": [1, {}], "b": []}, indent=2).replace("1,", "1E5,")


def test_notebook_diff():
    diff = '@@ -1 +1 @@\n-   "execution_count": 1,\n+   "execution_count": 2,\n     "print(\\"x\\")\\n",\n+    "image/png": "' + "A" * 300 + '"\n end'
    assert chunking.notebook_diff(diff).split("\n") == ["@@ -1 +1 @@", "[2 execution counts changed]", ' print("x")', "+<image/png, 300 characters>", " end"]


def test_windows(spark):
    words = [(1, i, w) for i, w in enumerate(("a b c " * 6).split())]
    df = spark.createDataFrame(words, "d int, pos int, word string")
    rows = {r.pos: r.penalty for r in chunking.repetition_penalty(df, ["d"]).collect()}
    assert rows[0] == 0 and rows[17] > rows[8] > 0
    scores = spark.createDataFrame([(1, i, 0, float(s)) for i, s in enumerate([3, 1, 2, 1])], "d int, pos int, b int, score double")
    got = {r.pos: round(r.blended, 6) for r in chunking.local_ranks(scores, ["d"], "b").collect()}
    assert got == {0: round(0.65 * 3 + 0.35, 6), 1: round(0.65 + 0.35 / 3, 6), 2: round(1.3 + 0.35 * 2 / 3, 6), 3: 0.65}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
        for i in range(20):
            role = "assistant" if i % 2 else "user"
            c.execute("INSERT INTO message VALUES (?, 's', ?, ?)", (str(i), 1_700_000_000_000 + i, json.dumps({"role": role, "tokens": {"input": i, "output": 1, "cache": {"read": 2, "write": 3}}})))
        c.execute("CREATE TABLE empty_one (a INTEGER)")
    rows = tables.database_usage(spark, path).collect()
    assert len(rows) == 10 and {r.new_input for r in rows} == {i + 3 for i in range(1, 20, 2)}
    assert tables.sqlite_table(spark, path, "empty_one").count() == 0


def test_session_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"session_id": "a", "model": "m", "system_prompt": "x" * 8, "messages": [{"role": "user", "content": "y" * 4}, {"role": "assistant", "content": "z" * 12}, {"role": "assistant", "content": None}]}, indent=1))
    r = tables.session_estimates(spark, str(tmp_path / "s")).first()
    assert (r.requests, r.input, r.output) == (2, 3.0, 3.0)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.txt").write_text("head and more")
    (tmp_path / "p" / "two.txt").write_text("other")
    shown = spark.createDataFrame([("one.txt", "head"), ("two.txt", "head")], "name string, preview string")
    assert [r.text for r in tables.preview_files(spark, str(tmp_path / "p"), shown).collect()] == ["head and more"]

