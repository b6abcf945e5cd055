"""The kNN join and the similarity join against brute force."""

import random

import numpy as np
import pytest

from passagekit.llm import jaccard_join, voronoi_knn
from passagekit.llm.common import components
from passagekit.llm.jaccard_join import jaccard_components, one_of_each, search, shingles
from passagekit.llm.voronoi_knn import Space, best_of, bounds, exact_top_k, inner_products
from tests.llm.data import DOCS, awkward, words

VECTORS = "vec_id long, embedding array<float>, key string, ints int, cell int, group int, block int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def brute_top(rows, asked, k):
    def ints(v):
        return [int(np.floor(256 * float(np.float32(x)))) for x in v]

    good = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 16)])
def test_top_k_with_clusters_ties_and_bad_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(voronoi_knn, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(voronoi_knn, "DATA_BLOCK", blocks[1])
    monkeypatch.setattr(voronoi_knn, "MERGED", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.1]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # one vector held by a third of the rows
    rows += [(2000, None), (2010, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (None, [1.0] * 8),
             (2040, []), (2050, [1.0, 2.0]), (2060, [0.0] * 8)]
    data = table(spark, rows)
    out = exact_top_k(data.where("vec_id % 10 = 0"), data, 5)
    assert sorted(tuple(r) for r in out.collect()) == brute_top(rows, lambda q: q % 10 == 0, 5)


def test_top_k_few_rows_repeats_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    data = table(spark, rows)
    assert sorted(tuple(r) for r in exact_top_k(data.where("vec_id = 0"), data, 5).collect()) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
    assert exact_top_k(data.where("vec_id = 9"), data).count() == 0
    assert exact_top_k(data, data.where("vec_id = 9")).count() == 0
    alone = table(spark, [(0, [1.0])])
    assert exact_top_k(alone, alone).count() == 0


def test_rows_that_share_the_key_of_a_query_are_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    rows += [rows[0], rows[10], rows[10]]  # whole rows that come again
    rows += [(20, [float(x) for x in np.array(rows[20][1]) * (1 + j / 50)]) for j in range(12)]  # one key, many vectors
    ints = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v in rows]
    want = []
    for at, (q, _) in enumerate(rows):
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[at], w)), rows[i][0]) for i, w in enumerate(ints) if i != at)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    data = table(spark, rows)
    assert sorted(tuple(r) for r in exact_top_k(data.where("vec_id % 10 = 0"), data, 5).collect()) == sorted(want)


def test_bounds_prune_far_groups_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 4000
    x = np.concatenate([c + rng.normal(size=(100, 6)) * 50 for c in centres]).astype(np.int64)
    space = Space(x[::100], float((x ** 2).sum(1).max()))
    far = space.data(x)
    cell = far.argmin(1)
    near = far[np.arange(len(x)), cell]
    nearest = [sorted(near[cell == c])[:6] for c in range(8)]
    q = x[::10]
    q_far = space.queries(q)
    q_cell = q_far.argmin(1)
    reach = np.array([q_far[q_cell == c, c].max(initial=-1) for c in range(8)])
    limit = bounds(space, reach, nearest, 6)
    scores = inner_products(q, x)
    for c in range(8):
        for i in np.flatnonzero(q_cell == c):
            best = np.argsort(-scores[i], kind="stable")[:6]
            assert (far[best, c] - reach[c] <= limit[c]).all()


def test_exact_products_of_large_numbers():
    a = np.array([[2 ** 29, 3], [1, 1]])
    assert inner_products(a, a).tolist() == [[2 ** 58 + 9, 2 ** 29 + 3], [2 ** 29 + 3, 2]]
    rows, columns = best_of(np.array([[5, 5, 7, 5]]), np.array([9, 4, 8, 1]), 3)
    assert columns.tolist() == [2, 3, 1]
    assert inner_products(np.array([[2 ** 61, 2 ** 61]]), np.array([[3, -2]])).tolist() == [[2 ** 61]]
    with pytest.raises(OverflowError):
        inner_products(np.array([[2 ** 62]]), np.array([[4]]))


def test_top_k_takes_large_vectors_and_refuses_too_large_ones(spark):
    rows = [(0, [2.0 ** 44, 1.0]), (1, [0.0, 2.0 ** 40]), (2, [1.0, 1.0])]
    data = table(spark, rows)
    assert sorted(tuple(r) for r in exact_top_k(data.where("vec_id = 2"), data).collect()) == brute_top(rows, lambda q: q == 2, 5)
    with pytest.raises(Exception, match="does not fit in a long"):
        exact_top_k(data, table(spark, [(3, [1e30, 0.0])])).collect()


def test_more_pivots_than_a_batch_and_few_pivots(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "LEAST_PIVOTS", 200)
    monkeypatch.setattr(voronoi_knn, "AT_ONCE", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(240)]
    data = table(spark, rows)
    for pivots in (None, 3):
        out = exact_top_k(data.where("vec_id % 20 = 0"), data, 3, pivots=pivots)
        assert sorted(tuple(r) for r in out.collect()) == brute_top(rows, lambda q: q % 20 == 0, 3)


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def brute_components(ids, texts):
    sets = [shingles(t, 4) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and (jaccard(sets[a], sets[b]) or (len(sets[a]) and len(sets[b]) and ids[a] == ids[b])):
                root[find(a)] = find(b)
    low = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((-1 if i is None else i, len(s), -1 if i is None else low[find(k)]) for k, (i, s) in enumerate(zip(ids, sets)))


def near_copies(seed, count, length, edits):
    rng, base = random.Random(seed), words(seed, length, 5000)
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(length)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    passage = " ".join(words(77, 60, 5000))
    out = []
    for s, (count, length, edits) in enumerate([(6, 200, 2), (30, 120, 2), (5, 60, 1), (8, 30, 1), (4, 400, 12), (3, 9, 0)]):
        out += near_copies(s, count, length, edits)
    out += [" ".join(words(200 + i, 40)) + " " + passage for i in range(30)]  # one passage in many texts
    out += [passage + f" own{i}" for i in range(12)]
    out += [None, "", " \n ", "one", "ONE", "one two", "One\tTwo", "one two three", "one two three four", "É é", "é é"]
    out += ["Same text here for all of these rows"] * 40 + ["same text HERE for all of these rows", "x " * 20_000, "x " * 300, "y"]
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_components_against_brute_force(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", 0 if block == 8 else 10 ** 6)
    ids = [*range(1, len(texts) - 1), None, 5]
    random.Random(1).shuffle(ids)
    out = jaccard_components(awkward(spark, texts, ids=ids), block=block).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out)
    assert found == brute_components(ids, texts)


def test_no_rows_and_no_links(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    out = jaccard_components(awkward(spark, ["a b c d e", "f g h i j", None])).collect()
    assert [r["component_id"] == r["doc_id"] for r in out] == [True] * 3


def test_one_of_each(spark):
    texts = ["a b c d e"] * 3 + ["other words are in this", None, "", "other words are in this too and more"]
    ids = [4, 2, 2, 7, 8, None, 9]
    out = one_of_each(awkward(spark, texts, ids=ids))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()) == [-1, 2, 7, 8, 9]
    assert out.columns == awkward(spark, []).columns


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 10 ** 6, rng.integers(3, 90))
        for _ in range(rng.integers(1, 5)):
            own = base.copy()
            own[rng.random(len(own)) < 0.05] += 10 ** 7
            sets.append(np.unique(own))
    sets.append(np.zeros(0, np.int64))

    def groups(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b])]
    found = search(sets, 85)
    assert all(jaccard(sets[a], sets[b]) for a, b in found) and groups(found) == groups(every)
    sides = [int(i % 2) for i in range(len(sets))]
    across = search(sets, 85, sides)
    assert groups(across) == groups([(a, b) for a, b in every if sides[a] != sides[b]])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert out == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
