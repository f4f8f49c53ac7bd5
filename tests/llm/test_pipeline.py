"""The pipeline's stages on a small table, each against brute force or its own rule."""

from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm.common import stage, table
from tests.llm.test_binary_operators import check_packing
from tests.llm.test_text_operators import components_by_hand, removed_by_hand

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, f in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(f(spark, docs, SF), name)
        rows = docs.collect()
        kept[name] = (before, rows)
        if name != "packing":
            assert docs.columns == columns
    before, rows = kept["near_duplicates"]
    assert {r["doc_id"] for r in rows} == {c for _, _, c in components_by_hand(before, 5, 80, 100)}
    before, rows = kept["repeated_passages"]
    cut = {d: (n, gone, text) for d, n, gone, text in removed_by_hand(before, 35)}
    assert {r["doc_id"] for r in rows} == {d for d, (n, gone, _) in cut.items() if not gone or gone < n}
    originals = dict(before)
    for r in rows:
        assert r["text"] == (cut[r["doc_id"]][2] if cut[r["doc_id"]][1] else originals[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    before, rows = kept["mixing"]
    assert {r["doc_id"] for r in rows} == {d for d, _ in before}
    before, rows = kept["packing"]
    assert sum(r["piece"] == 0 for r in rows) == len(before) and check_packing(rows, 4096)
    before, rows = kept["quality"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    stayed = {r["doc_id"] for r in rows}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in stayed for d in good) >= 0.95 * len(good)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_by_five_words(spark):
    words = [f"w{i}" for i in range(400)]
    edited = [f"e{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()] == [1]


def test_repeated_rows_keep_one(spark):
    text = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    rows = [(1, text["a"], "en"), (1, text["a"], "en"), (1, text["a"], "de"), (2, text["b"], "en"), (2, text["b"] + " more", "en"), (None, text["c"], "en"), (None, text["c"], "en"), (None, text["c"] + " x", "en"), (3, text["d"], "en"), (None, text["d"], "en"), (4, "", "en"), (5, None, "en"), (4, "", "en"), (None, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    left = corpus_pipeline.near_duplicates(spark, df, SF)
    assert left.columns == df.columns
    left = stage(left, "left")
    got = sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in left.collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (4, ""), (5, ""), (None, "")], key=str)
    out = corpus_pipeline.repeated_passages(spark, left, SF)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, left.collect()), key=str)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, perturbed string, mix_pass string, component_id string, n_removed string"


def test_stages_take_any_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns named as the operators' own, an empty table."""
    more = (None, "s", None, "k", 2, "p", "m", "c", "r")
    texts = [(1, "a b c d"), (1, "a b c d"), (2, None), (2, None), (3, ""), (4, " \t\n "), (None, "e f g"), (None, None), (6, " ".join(f"w{i}" for i in range(40_000)))]
    df = spark.createDataFrame([(d, t, *more) for d, t in texts] + [(7, "x y", *[None] * 9)], CLASHING).repartition(3)
    left = {"near_duplicates": 8, "repeated_passages": 10, "mixing": None, "packing": None, "quality": None}
    for name, f in corpus_pipeline.STAGES:
        out, none = f(spark, df, SF), f(spark, df.limit(0), SF)
        assert none.count() == 0 and (name == "packing" or out.columns == none.columns == df.columns)
        rows = out.collect()
        if left[name]:
            assert len(rows) == left[name]
        if name in ("mixing", "packing"):
            assert {r["doc_id"] for r in rows} == {d for d, _ in texts} | {7}
        if name not in ("packing", "repeated_passages"):
            assert all((r["kept"], r["perturbed"], r["mix_pass"]) == ((None,) * 3 if r["doc_id"] == 7 else ("k", "p", "m")) for r in rows)


def test_passages_of_repeated_rows(spark):
    """What the stage before leaves of repeated rows passes whole."""
    text = " ".join(f"t{i}" for i in range(90))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other words")], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    left = stage(corpus_pipeline.near_duplicates(spark, df, SF), "left")
    assert sorted(map(tuple, corpus_pipeline.repeated_passages(spark, left, SF).collect())) == [(1, text, len(text)), (2, "other words", 11)]
