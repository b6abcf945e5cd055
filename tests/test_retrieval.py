import math
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagekit.operators.embedding import check_dim, embed, embed_with, hash_embed
from passagekit.operators.knn import NearPairs, cosine_distance, knn, knn_one
from passagekit.operators.lexical import LexicalIndex, bm25_index, bm25_scores, bm25_topk
from passagekit.operators.topk import BestRows
from passagekit.catalog.stubs import vowel_model

VECTORS = "id long, embedding array<float>"


def brute_knn(questions, index, k):
    rows = []
    for qid, q in questions:
        costs = []
        for i, v in index:
            lengths = [math.sqrt(sum(x * x for x in u)) if u else 0.0 for u in (q, v)]
            known = all(lengths)
            costs.append((not known, round(1 - sum(a * b for a, b in zip(q, v)) / (lengths[0] * lengths[1]), 10) if known else 0.0, i))
        rows += [(qid, pos, i, None if unknown else cost) for pos, (unknown, cost, i) in enumerate(sorted(costs)[:k])]
    return sorted(rows)


@pytest.mark.parametrize("limit", [10_000, 3])
def test_knn_equals_brute_force(spark, limit):
    rng = np.random.default_rng(7)
    base = rng.integers(-3, 4, size=(60, 4)).astype(float)
    index = [(i, v.tolist()) for i, v in enumerate(base)] + [(100, [0.0] * 4), (101, None), (102, base[3].tolist())]
    questions = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, size=(11, 4)).astype(float) + 0.5)] + [(50, [0.0] * 4), (51, None)]
    asked = spark.createDataFrame(questions, "qid long, embedding array<float>")
    held = spark.createDataFrame(index, VECTORS).repartition(5)
    for k in (1, 4, 100):
        found = sorted(map(tuple, knn(asked, held, k, max_questions=limit).collect()))
        expected = brute_knn(questions, index, k)
        assert [r[:3] for r in found] == [r[:3] for r in expected]
        assert all((a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-9) for a, b in zip(found, expected))


def test_knn_with_a_hot_vector(spark):
    """A third of the index is one vector: ties go by id and nothing is lost."""
    index = [(i, [1.0, 0.0] if i % 3 == 0 else [1.0, float(i)]) for i in range(300)]
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "qid long, embedding array<float>")
    found = knn(asked, spark.createDataFrame(index, VECTORS).repartition(7), 40).collect()
    assert sorted(r["id"] for r in found) == [3 * i for i in range(40)]


def test_near_pairs_are_few_and_exact():
    """Only pairs that may enter a list are worked out in double precision, and the lists are those of all pairs."""
    rng = np.random.default_rng(3)
    asked, held = rng.normal(size=(300, 16)), rng.normal(size=(6000, 16))
    held[5000:5003] = held[40]  # copies
    asked, held = (x / np.linalg.norm(x, axis=1)[:, None] for x in (asked, held))
    qids, ids, k = np.arange(300), np.arange(6000) * 3 % 6007, 4
    best, near = BestRows(qids, k), NearPairs(asked)
    worked, put = [], best.add_pairs
    best.add_pairs = lambda question, ids, costs: (worked.append(len(question)), put(question, ids, costs))
    for at in range(0, 6000, 1500):
        near.add(best, qids, held[at:at + 1500], ids[at:at + 1500])
    costs = np.round(1.0 - asked @ held.T, 10)
    wanted = [(q, int(ids[i]), costs[q, i]) for q in qids for i in np.lexsort((ids, costs[q]))[:k]]
    assert [tuple(r.values()) for r in best.rows().to_pylist()] == wanted
    assert sum(worked) < costs.size // 20
    # a bound leaves out what lies above it
    last = np.array([c for _, _, c in wanted[k - 1::k]])
    bounded = BestRows(qids, k, last)
    near.add(bounded, qids, held, ids)
    assert [tuple(r.values()) for r in bounded.rows().to_pylist()] == wanted
    none = BestRows(qids, k, last - 3.0)
    near.add(none, qids, held, ids)
    assert none.rows().num_rows == 0


def test_blocks_of_questions_embed_the_corpus_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    held = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    index = spark.createDataFrame(held, VECTORS).mapInArrow(counted, VECTORS)
    asked = [(q, [float(q % 3), 1.0, 2.0]) for q in range(20)]
    questions = spark.createDataFrame(asked, "qid long, embedding array<float>")
    found = sorted((r["qid"], r["pos"], r["id"], r["distance"]) for r in knn(questions, index, 3, max_questions=4).collect())
    assert found == brute_knn(asked, held, 3) and met.value == 60


def test_knn_without_rows(spark):
    none = spark.createDataFrame([], "qid long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], VECTORS)
    assert knn(none, some, 3).count() == 0
    assert knn(spark.createDataFrame([(1, [1.0])], "qid long, embedding array<float>"), some.filter("false"), 3).count() == 0


def test_knn_refuses_other_sizes(spark):
    asked = spark.createDataFrame([(1, [1.0])], "qid long, embedding array<float>")
    with pytest.raises(PySparkException):
        knn(asked, spark.createDataFrame([(1, [1.0, 2.0])], VECTORS), 1).collect()


def test_knn_one_equals_knn(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], VECTORS)
    asked = spark.createDataFrame([(0, [2.0, 1.0])], "qid long, embedding array<float>")
    several = [(r["id"], r["distance"]) for r in knn(asked, rows, 6).orderBy("pos").collect()]
    assert [tuple(r) for r in knn_one([2.0, 1.0], rows, 6).collect()] == several
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<float>, b array<float>")
    assert zero.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] is None


def brute_bm25(texts, queries):
    docs = {i: re.sub("[^a-zA-Z0-9]", " ", t).lower().split() for i, t in texts}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    return {
        (q, i): sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in query.lower().split())
        for q, query in queries for i, d in docs.items()
    }


TEXTS = [(i, t) for i, t in enumerate([
    "red fox", "red red dog", "blue cat sat", "grey owl", "", "???", "red dog red dog", "dog", "red red dog", "Cat, cat; CAT!", "the dog the fox",
])]
ASKED = [(1, "dog cat?"), (2, "red  red fox"), (3, "nothing here"), (4, ""), (5, "THE cat")]


@pytest.mark.parametrize("limit", [10_000, 2])
def test_bm25_equals_brute_force(spark, limit):
    index = bm25_index(spark.createDataFrame(TEXTS, "id long, text string").repartition(3))
    asked = spark.createDataFrame(ASKED, "qid long, query string")
    expected = brute_bm25(TEXTS, ASKED)
    scores = {(r["qid"], r["id"]): r["score"] for r in bm25_scores(asked, index, max_questions=limit).collect()}
    assert set(scores) == {k for k, v in expected.items() if abs(v) > 1e-9}
    assert all(abs(scores[k] - expected[k]) < 1e-9 for k in scores)
    for k in (1, 3, 20):
        found = [(r["qid"], r["pos"], r["id"]) for r in bm25_topk(asked, index, k, max_questions=limit).collect()]
        ranked = [(q, pos, i) for q, _ in ASKED for pos, i in enumerate(
            sorted((i for i, _ in TEXTS), key=lambda i: (-round(expected[q, i], 10), i))[:k])]
        assert sorted(found) == sorted(ranked)


def test_bm25_golden(spark):
    index = bm25_index(spark.createDataFrame(TEXTS[:4], "id long, text string"))
    found = bm25_topk(spark.createDataFrame([(1, "dog cat?")], "qid long, query string"), index, 2).orderBy("pos").collect()
    assert [(r["id"], round(r["score"], 6)) for r in found] == [(1, 0.777337), (0, 0.0)]


def test_negative_mean_idf_ranks_below_zero(spark):
    texts = [(0, "a b"), (1, "a b"), (2, "c")]
    index = bm25_index(spark.createDataFrame(texts, "id long, text string"))
    found = bm25_topk(spark.createDataFrame([(1, "a")], "qid long, query string"), index, 3).orderBy("pos").collect()
    assert [r["id"] for r in found] == [2, 0, 1] and found[1]["score"] < 0


def test_bm25_saved(spark, tmp_path):
    index = bm25_index(spark.createDataFrame(TEXTS, "id long, text string"))
    index.save(str(tmp_path))
    asked = spark.createDataFrame(ASKED, "qid long, query string")
    loaded = LexicalIndex.load(spark, str(tmp_path))
    assert sorted(bm25_topk(asked, loaded, 3).collect()) == sorted(bm25_topk(asked, index, 3).collect())
    assert {tuple(r) for r in loaded.postings().filter("term = 'red'").collect()} == {
        ("red", 0, 1), ("red", 1, 2), ("red", 6, 2), ("red", 8, 2)}


def test_bm25_of_nothing(spark):
    index = bm25_index(spark.createDataFrame([], "id long, text string"))
    assert bm25_topk(spark.createDataFrame([(1, "a")], "qid long, query string"), index, 3).count() == 0


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "!")], "id long, text string").repartition(1)
    vectors = {r["id"]: r["embedding"] for r in hash_embed(rows, "text", 8).collect()}
    assert vectors[2] is None and vectors[3] == [0.0] * 8
    assert abs(sum(v * v for v in vectors[1]) - 1) < 1e-6 and sorted(v for v in vectors[1] if v)[-1] == pytest.approx(2 / math.sqrt(5))
    own = {r["id"]: r["embedding"] for r in embed_with(rows, "text", "vowels", {"vowels": vowel_model}).collect()}
    assert own[1] == [2.0, 0.0, 0.0, 0.0, 0.0] and own[2] is None
    with pytest.raises(KeyError):
        embed_with(rows, "text", "unknown")


def batch_recorder(limit):
    def model(texts):
        assert len(texts) <= limit
        return [[float(len(texts))] for _ in texts]
    return model


def test_embedding_batches(spark):
    rows = spark.range(250).select(F.col("id"), F.lit("x").alias("text")).coalesce(1)
    sizes = [r["embedding"][0] for r in embed(rows, "text", batch_recorder, 1, 100, limit=100).collect()]
    assert sorted(set(sizes)) == [50.0, 100.0] and len(sizes) == 250


def test_wrong_dimension_stops(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)
    with pytest.raises(PySparkException, match="expected a vector of 3"):
        rows.select(check_dim(F.col("embedding"), 3)).collect()
