"""The Merkle manifest against a tree built by plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from passagekit.llm import merkle
from passagekit.llm.merkle import document_manifest, fold, merkle_proofs
from tests.llm.data import DOCS


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level: list[str], fanout: int = 2) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each leaf its siblings before and after it on every level."""
    paths: list = [[] for _ in level]
    members = [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(a, min(a + fanout, len(level))) for a in range(0, len(level), fanout)]
        for run in runs:
            for node in run:
                for leaf in members[node]:
                    paths[leaf].append(([level[x] for x in run if x < node], [level[x] for x in run if x > node]))
        members = [[leaf for node in run for leaf in members[node]] for run in runs]
        level = [H(*[level[x] for x in run]) for run in runs]
    return level[0], paths


def part(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    leaf = lambda r, n: H(part(r[0]), part(r[3]), part(r[2]), part(n), part(r[1]))
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    roots, out = [], []
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        roots.append(climb([x[2] for x in trees[name]], fanout))
    root, tops = climb([r[0] for r in roots], fanout) if roots else ("", [])
    for name, (subroot, paths), top in zip(names, roots, tops):
        for (_, _, own, r), path in zip(trees[name], paths):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, r[4] + 1) if changed else own
            for left, right in path + top:
                node = H(*left, node, *right)
            siblings = H(*[h for left, right in path + top for h in left + right])
            out.append((r[0], own, subroot, root, siblings, node, node == root))
    return out


def found(spark, rows: list[tuple]) -> list[tuple]:
    return [tuple(r) for r in document_manifest(spark.createDataFrame(rows, DOCS)).collect()]


def docs(n: int, seed: int = 0, langs: tuple = ("en", "fr", None, "", "été")) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i, i, i]), rng.choice([None, "", f"text {i}", "ünï"]), rng.choice(langs), rng.choice([None, "s"]),
             rng.choice([None, i, 2 ** 63 - 1]), 9.0, "k", 7, 8, 9) for i in range(n)]
    return rows + rows[:n // 10]


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_against_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = docs(70, levels) + [(i, "t", "one", "s", 1, 9.0, "k", 7, 8, 9) for i in range(1)]
    assert sorted(found(spark, rows), key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 257])
def test_sizes_of_a_single_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = [(i, f"t{i}", "en", "s", i, 9.0, "k", 7, 8, 9) for i in range(n)]
    assert sorted(found(spark, rows)) == sorted(expected(rows))


def test_runs_of_three(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "FANOUT", 3)
    rows = docs(60, 4)
    assert sorted(found(spark, rows), key=key) == sorted(expected(rows, 3), key=key)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, f"t{i}", f"l{i % 23}", "s", i, 9.0, "k", 7, 8, 9) for i in range(50)]
    assert sorted(found(spark, rows)) == sorted(expected(rows))


def test_no_documents_and_a_long_text(spark):
    assert found(spark, []) == []
    rows = [(1, "ab" * 400_000, "en", "s", 5, 9.0, "k", 7, 8, 9)]
    assert found(spark, rows) == expected(rows)


def test_proofs_of_any_table_keep_its_columns(spark):
    rows = [("g", i, H(str(i)), "x", 3, 4) for i in range(11)]
    leaves = spark.createDataFrame(rows, "tree string, order0 int, hash string, root string, height int, rank int")
    out = merkle_proofs(leaves, "tree", ["order0"], "hash")
    assert out.columns == ["tree", "order0", "hash", "height", "rank", "subroot", "root", "path"]
    assert out.where(fold(F.col("hash"), F.col("path")) != F.col("root")).count() == 0 and out.count() == 11
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in joins  # proofs come out of the nested blocks
