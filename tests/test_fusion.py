import itertools

import pytest
from pyspark.sql import functions as F

from passagekit.operators.classify import fit_router, label_with_threshold, route, route_model, softmax
from passagekit.operators.fusion import attach_chunks, collect_context, rerank_by_tag, splice, truncate_hits


def hits(spark, rows, lexical=False):
    schema = "qid long, pos int, id long" + (", score double" if lexical else "")
    return spark.createDataFrame([(*r, 1.0) if lexical else r for r in rows], schema)


def test_splice_equals_slicing(spark):
    semantic, lexical, expected = [], [], []
    for k in (0, 1, 2, 3):
        for qid, (n, m) in enumerate(itertools.product(range(5), range(4))):
            semantic = [(qid, p, 100 + p) for qid, (n, m) in enumerate(itertools.product(range(5), range(4))) for p in range(n)]
            lexical = [(qid, p, 200 + p) for qid, (n, m) in enumerate(itertools.product(range(5), range(4))) for p in range(m)]
        expected = []
        for qid, (n, m) in enumerate(itertools.product(range(5), range(4))):
            row = [100 + p for p in range(n)]
            row[k:k] = [200 + p for p in range(m)]
            expected += [(qid, pos, i) for pos, i in enumerate(row)]
        found = splice(hits(spark, semantic), hits(spark, lexical, True), k)
        assert sorted((r["qid"], r["pos"], r["id"]) for r in found.collect()) == sorted(expected)


def test_splice_dedup(spark):
    found = splice(hits(spark, [(1, 0, 7), (1, 1, 8)]), hits(spark, [(1, 0, 8)], True), 1, dedup=True)
    assert sorted((r["pos"], r["id"]) for r in found.collect()) == [(0, 7), (1, 8)]
    kept = splice(hits(spark, [(1, 0, 7), (1, 1, 8)]), hits(spark, [(1, 0, 8)], True), 1)
    assert sorted((r["pos"], r["id"]) for r in kept.collect()) == [(0, 7), (1, 8), (2, 8)]


@pytest.mark.parametrize("predicted,order", [("b", [2, 0, 1]), ("other", [0, 1, 2]), (None, [0, 1, 2])])
def test_rerank(spark, predicted, order):
    base = "https://docs.ray.io/en/latest/"
    rows = [(1, 0, 0, base + "a/x"), (1, 1, 1, "elsewhere"), (1, 2, 2, base + "b/x")]
    table = spark.createDataFrame(rows, "qid long, pos int, id long, source string").withColumn("predicted", F.lit(predicted).cast("string"))
    found = rerank_by_tag(table).orderBy("pos").collect()
    assert [r["id"] for r in found] == order
    assert truncate_hits(rerank_by_tag(table), 2).count() == 2


def test_contexts(spark):
    chunks = spark.createDataFrame([(1, "t1", "s"), (2, "t2", "r"), (3, "t3", "s")], "id long, text string, source string")
    found = attach_chunks(hits(spark, [(9, 1, 1), (9, 0, 3), (9, 2, 2)]), chunks, 3)
    many = hits(spark, [(9, 1, 1), (9, 0, 3), (8, 0, 1)])
    ways = [attach_chunks(many, chunks, n, broadcast_hits=2, broadcast_ids=10) for n in (None, 2, 3, 11)]
    assert all(sorted(w.collect()) == sorted(ways[0].collect()) and w.count() == 3 for w in ways)
    row = collect_context(found).first()
    assert (row["document_ids"], row["texts"], row["sources"]) == ([3, 1, 2], ["t3", "t1", "t2"], ["s", "r"])
    assert collect_context(found, distinct_sources=False).first()["sources"] == ["s", "s", "r"]


def test_thresholds(spark):
    probabilities = F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))
    row = spark.range(1).select(
        label_with_threshold(probabilities, ["a", "b", "c"], 0.4).alias("tie"),
        label_with_threshold(probabilities, ["a", "b", "c"], 0.5).alias("below"),
        softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("even")).first()
    assert (row["tie"], row["below"], row["even"]) == ("b", "other", [0.5, 0.5])


def test_routing(spark):
    row = spark.range(1).select(*(route_model(F.lit(v), "cheap", "strong").alias(f"c{i}") for i, v in enumerate((1, 0, True, "1")))).first()
    assert tuple(row)[:2] == ("cheap", "strong") and row["c3"] == "cheap"
    training = spark.createDataFrame([("short easy", 1), ("easy one", 1), ("hard proof", 0), ("hard theorem", 0)], "text string, label int")
    router = fit_router(training, features=64)
    asked = spark.createDataFrame([(1, "easy easy"), (2, "hard hard"), (3, None)], "qid long, query string")
    assert {r["qid"]: r["llm"] for r in route(asked, router, "cheap", "strong").filter("qid < 3").collect()} == {1: "cheap", 2: "strong"}
