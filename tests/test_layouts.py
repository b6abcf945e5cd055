"""Stored layouts: postings by term, vectors by cell, chunks by range of ids. Each must give what a scan gives, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from passagekit.operators import cells, postings
from passagekit.operators.cells import CellStore, knn_cells, write_cells
from passagekit.operators.fusion import attach_chunks
from passagekit.operators.knn import knn
from passagekit.operators.lexical import bm25_index, bm25_topk
from passagekit.operators.postings import PostingsIndex, asked_terms, postings_topk, write_postings
from passagekit.operators.topk import BEST_FIELDS, first_k, question_blocks
from passagekit.sources.index_store import read_ranges, write_ranges


def texts(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def hits(df):
    return sorted((r["qid"], r["pos"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("limit,part", [(10_000, 7), (9, 20)])
def test_postings_against_the_scan(spark, monkeypatch, tmp_path, limit, part):
    monkeypatch.setattr(postings, "PART_ROWS", part)
    words = [f"w{i}" for i in range(60)] + ["the"] * 40
    chunks = spark.createDataFrame(list(enumerate(texts(1, 300, words))), "id long, text string").repartition(3)
    asked = spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts(2, 15, words))] + [(90, "unknown words"), (91, ""), (92, None), (93, "w1 w1 the")], "qid long, query string")
    index = bm25_index(chunks)
    write_postings(index, str(tmp_path / "p"), buckets=8)
    store = PostingsIndex.load(spark, str(tmp_path / "p"))
    for k in (4, 50):
        assert hits(postings_topk(asked, store, k, max_questions=limit)) == hits(bm25_topk(asked, index, k))


def test_postings_with_negative_weights_and_without_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "all a"), (1, "all b"), (2, "all a b"), (3, "all")], "id long, text string")
    for name, some in (("few", chunks), ("none", chunks.where("id < 0"))):
        index = bm25_index(some)
        write_postings(index, str(tmp_path / name), buckets=2)
        asked = spark.createDataFrame([(1, "all a"), (2, "b"), (3, "zzz")], "qid long, query string")
        store = PostingsIndex.load(spark, str(tmp_path / name))
        assert hits(postings_topk(asked, store, 3)) == hits(bm25_topk(asked, index, 3))


def test_postings_read_asked_folders_and_skip_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "PART_ROWS", 10)
    rows = [(i, ("fox " * 9 if i < 10 else "fox ") + "lazy dog " * (1 + i % 3) + f"w{i}") for i in range(200)]
    index = bm25_index(spark.createDataFrame(rows, "id long, text string").coalesce(1))
    write_postings(index, str(tmp_path / "p"), buckets=16)
    store = PostingsIndex.load(spark, str(tmp_path / "p"))
    buckets, known = asked_terms(["fox"], store)
    assert len(buckets) == 1
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"IN ({buckets[0]})" in plan.replace(f"= {buckets[0]}", f"IN ({buckets[0]})")
    assert "Exchange hashpartitioning" not in plan  # the term table is not moved
    scored = []
    original = postings._scored
    monkeypatch.setattr(postings, "_scored", lambda b, pairs, *rest: scored.append(pairs) or original(b, pairs, *rest))
    asked = spark.createDataFrame([(1, "w3 w4")], "qid long, query string")
    assert hits(postings_topk(asked, store, 2)) == hits(bm25_topk(asked, index, 2))
    assert sum(p.count() for p in scored) < 20 / 4  # of 20 parts


def vectors(seed, n, centres):
    rng = random.Random(seed)
    return [[c + rng.gauss(0, 0.02) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("limit", [10_000, 7])
def test_cells_against_the_scan(spark, tmp_path, limit):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    held = list(enumerate(vectors(5, 400, centres))) + [(900, None), (901, [0.0] * 6), (902, centres[0]), (903, centres[0])]
    asked = list(enumerate(vectors(6, 20, centres))) + [(50, centres[0]), (51, None), (52, [0.0] * 6), (53, [2.0 * x for x in centres[1]])]
    index = spark.createDataFrame(held, "id long, embedding array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "qid long, embedding array<double>")
    write_cells(index, str(tmp_path / "c"))
    store = CellStore.load(spark, str(tmp_path / "c"))
    rows = lambda df: sorted((r["qid"], r["pos"], r["id"], r["distance"]) for r in df.collect())
    for k in (5, 500):
        assert rows(knn_cells(questions, store, k, max_questions=limit)) == rows(knn(questions, index, k))


def test_cells_read_only_what_is_near(spark, tmp_path):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    index = spark.createDataFrame(list(enumerate(vectors(8, 900, centres))), "id long, embedding array<double>")
    write_cells(index, str(tmp_path / "c"), cells=60)
    store, report = CellStore.load(spark, str(tmp_path / "c")), {}
    asked = spark.createDataFrame([(1, centres[3])], "qid long, embedding array<double>")
    found = knn_cells(asked, store, 5, report=report)
    assert report["cells"] == 60 and 0 < report["read"] <= 15
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [tuple(r) for r in knn(asked, index, 5).orderBy("pos").collect()]


def test_cells_of_no_vectors_and_of_one_copy(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    for name, rows in (("none", []), ("copies", [(i, [1.0, 1.0]) for i in range(40)]), ("zeros", [(i, [0.0, 0.0]) for i in range(3)])):
        write_cells(spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path / name))
        found = knn_cells(asked, CellStore.load(spark, str(tmp_path / name)), 3)
        assert [r["id"] for r in found.orderBy("pos").collect()] == [r[0] for r in rows[:3]]


def test_lookups_read_the_folders_of_the_hits(spark, tmp_path):
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(0, 4000, 5)]
    path = str(tmp_path / "r")
    write_ranges(spark.createDataFrame(rows, "id long, text string, source string"), path, 8)
    index = read_ranges(spark, path)
    wanted = spark.createDataFrame([(1, 0, 10), (1, 1, 15), (2, 0, 3995)], "qid long, pos int, id long")
    for bound in (3, None):
        found = attach_chunks(wanted, index, bound)
        assert sorted((r["qid"], r["pos"], r["text"], r["source"]) for r in found.collect()) == [
            (1, 0, "text 10", "s1"), (1, 1, "text 15", "s0"), (2, 0, "text 3995", "s2")]
        assert found.columns == ["id", "text", "source", "qid", "pos"]
    assert "dynamicpruning" in attach_chunks(wanted, index, 3)._jdf.queryExecution().executedPlan().toString()
    # overwriting replaces the folders that rows belong to
    write_ranges(spark.createDataFrame([(10, "new", "s")], "id long, text string, source string"), path, 8)
    left = {r["id"]: r["text"] for r in read_ranges(spark, path).collect()}
    assert left[10] == "new" and 15 not in left and left[3995] == "text 3995"
    with pytest.raises(Exception, match="no chunk has the id of a hit"):
        attach_chunks(spark.createDataFrame([(1, 0, 11)], "qid long, pos int, id long"), read_ranges(spark, path), 3).collect()


def test_merge_in_two_levels(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4), i, rng.choice([0.1, 0.2, None, 0.3])) for i in range(400)]
    found = spark.createDataFrame(rows, BEST_FIELDS).repartition(20)
    wanted = sorted(map(tuple, first_k(found, 7, slots=1).collect()), key=str)
    two = first_k(found, 7, slots=5)
    assert sorted(map(tuple, two.collect()), key=str) == wanted
    assert "_slot" in two._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_questions(spark):
    asked = spark.range(103).select(F.col("id").alias("qid")).union(spark.range(20).select(F.lit(5).alias("qid")))
    sizes, seen = [], []
    for block in question_blocks(asked, 10):
        rows = [r["qid"] for r in block.collect()]
        sizes.append(len(rows))
        seen += rows
    assert max(sizes) <= 10 and sorted(seen) == sorted([*range(103), *[5] * 20])
