from sparkloom.operators import lines, logs, retrieval


def test_containment_finds_short_and_inner_items(spark):
    texts = ["(alpha beta gamma delta epsilon)", "xalpha beta gamma deltay", "alpha  beta\ngamma", "", None, "one two", "the word", "alpha beta gamma delta"]
    items = ["alpha beta gamma delta", "word", "two", "alpha beta gamma", "beta gamma delta epsilon zeta", "", None, "alpha  beta\ngamma", " word", "(alpha beta gamma delta epsilon)", "e w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t is not None and x is not None and x in t}
    for block in (200, 2):
        got = [tuple(r) for r in retrieval.containment(docs, asked, "doc_id", "item_id", block=block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_forged_counts_are_not_expanded(spark):
    rows = spark.createDataFrame([("some line here  [× 3]",), ("some line here  [× 2000000000]",), ("x\n" * 3,)], "t string")
    got = [r[0] for r in rows.select(lines.expand_dups(rows.t)).collect()]
    assert got == ["some line here\n" * 2 + "some line here", None, "x\n" * 3]


def test_templates_join_the_earliest_of_the_most_alike():
    rows = ["a b c d", "a b x y", "a b c z", "", "q 1", "q 2", "a b x w", "other", "a b c d"]
    assert logs.templates(rows) == [(["a", "b", "<*>", "<*>"], [0, 1, 2, 6, 8]), (["q", "<*>"], [4, 5]), (["other"], [7])]
    assert logs.templates(["", " "]) == []
