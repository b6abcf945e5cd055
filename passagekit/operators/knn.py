"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.operators.topk import MAX_QUESTIONS, BestRows, best_k

# Distances are compared at this many decimals, so that copies tie whatever the order of summation.
DECIMALS = 10
# Products in single precision and questions of a step, rows of the first step, and pairs that are worked out in double precision together.
NEAR_CELLS, ASKED_AT_ONCE, FIRST_ROWS, PAIRS_AT_ONCE = 400_000, 2_000, 64, 16_384


def unit_rows(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which rows have one; NULL and zero vectors have none."""
    column = vectors.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    sizes = np.unique(lengths[valid])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sizes.tolist()}")
    dim = int(sizes[0]) if len(sizes) else 0
    rows = np.zeros((len(column), dim))
    rows[valid] = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(valid.sum()), dim)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    known = norms > 0
    rows[known] /= norms[known, None]
    return rows, known


class NearPairs:
    """Adds the rows that are near enough to matter to the best rows of a block of questions.

    Products in single precision leave the pairs that may beat a question's k-th row, by a margin over their error; only these
    are worked out in double precision. Questions without k rows yet meet a few rows in full, then twice as many, and so on.
    """

    def __init__(self, asked: np.ndarray):
        self.asked, self.rough = asked, asked.astype(np.float32)
        # an entry and a product are each off by 2^-24 at most, a sum of n products by n times that
        self.margin = (asked.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -DECIMALS
        self.products, self.close = np.empty(NEAR_CELLS, np.float32), np.empty(NEAR_CELLS, bool)

    def add(self, best: BestRows, who: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        """Let the questions at the places `who` meet unit vectors; NaN costs are as unknown."""
        some = held.astype(np.float32)
        start, step = 0, max(FIRST_ROWS, 2 * best.k)
        while start < len(held):
            end = min(start + min(step, NEAR_CELLS // ASKED_AT_ONCE), len(held))
            for at in range(0, len(who), ASKED_AT_ONCE):
                self._part(best, who[at:at + ASKED_AT_ONCE], held[start:end], some[start:end], ids[start:end])
            start, step = end, 2 * step

    def _part(self, best: BestRows, who: np.ndarray, held: np.ndarray, some: np.ndarray, ids: np.ndarray) -> None:
        shape, cells = (len(who), len(held)), len(who) * len(held)
        products, close = self.products[:cells].reshape(shape), self.close[:cells].reshape(shape)
        settled = np.isfinite(best.last_cost[who])
        least = np.where(settled, 1.0 - best.last_cost[who] - self.margin, np.inf).astype(np.float32)
        np.greater_equal(np.matmul(self.rough[who], some.T, out=products), least[:, None], out=close)
        near = np.flatnonzero(close)
        if len(near) > cells // 8:  # many ties: not pair by pair
            settled[:] = False
        else:
            for at in range(0, len(near), PAIRS_AT_ONCE):
                question, row = np.divmod(near[at:at + PAIRS_AT_ONCE], len(held))
                costs = np.round(1.0 - np.einsum("ij,ij->i", self.asked[who[question]], held[row]), DECIMALS)
                best.add_pairs(who[question], ids[row], costs)
        if not settled.all():
            best.add(np.round(1.0 - self.asked[who[~settled]] @ held.T, DECIMALS), ids, who[~settled])


def _cosine_scorer(questions: pa.Table):
    asked, askable = unit_rows(questions["embedding"])
    near, askers, others = NearPairs(asked), np.flatnonzero(askable), np.flatnonzero(~askable)

    def score(batch: pa.Table, best: BestRows) -> None:
        held, known = unit_rows(batch["embedding"])
        ids = batch["id"].to_numpy()
        if held.shape[1] and asked.shape[1] and held.shape[1] != asked.shape[1]:
            raise ValueError(f"question vectors of {asked.shape[1]}, index vectors of {held.shape[1]}")
        if held.shape[1] and asked.shape[1]:
            near.add(best, askers, held[known], ids[known])
        # rows of unknown distance go by id, so only the lowest ids of a batch matter
        short = askers[np.isinf(best.last_cost[askers])]
        for who, tied in ((short, np.sort(ids[~known])[:best.k]), (others, np.sort(ids)[:best.k])):
            best.add(np.full((len(who), len(tied)), np.inf), tied, who)

    return score


def knn(questions: DataFrame, index: DataFrame, k: int, qid_col: str = "qid", id_col: str = "id",
        embedding_col: str = "embedding", max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """The k nearest index rows of every question: qid, pos (from 0), id, distance.

    Ties go by id. A NULL or zero vector has no distance and comes last. Only ids and vectors are
    read; texts are joined to the hits afterwards (`attach_chunks`).
    """
    asked = questions.select(F.col(qid_col).alias("qid"), F.col(embedding_col).alias("embedding"))
    held = index.select(F.col(id_col).alias("id"), F.col(embedding_col).alias("embedding"))
    return best_k(asked, held, k, _cosine_scorer, max_questions, write_corpus=True).withColumnRenamed("cost", "distance")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot / (|a| |b|) in double precision; NULL for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn_one(vector: list[float], index: DataFrame, k: int, id_col: str = "id", embedding_col: str = "embedding") -> DataFrame:
    """The k nearest rows of a single vector: id, distance. Each task keeps k rows of its own."""
    asked = F.array(*(F.lit(float(v)) for v in vector))
    distance = F.round(cosine_distance(F.col(embedding_col), asked), DECIMALS).alias("distance")
    return (
        index.select(F.col(id_col).alias("id"), distance)
        .orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)
    )
