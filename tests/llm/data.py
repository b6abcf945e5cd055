"""Small tables with the awkward rows that every operator has a defined result for."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row int, copy int, n int"


def awkward(spark, texts: list[str | None], sources: list[str | None] | None = None, ids: list[int | None] | None = None):
    """Documents with other columns whose names the operators use inside."""
    sources = sources or ["s"] * len(texts)
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", s, len(t or ""), 9.0, "k", 7, 8, 9) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def words(seed: int, count: int, vocabulary: int = 300) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(count)]


def rows_of(df, *names: str) -> list[tuple]:
    names = names or tuple(df.columns)
    return [tuple(r[n] for n in names) for r in df.collect()]
