"""Exact nearest neighbours by cosine distance from vectors that are stored by cells.

Every vector lies with the nearest of some pivots. A cell's summary holds its pivot, how many vectors it has and how near and far
they are. The triangle inequality on unit vectors (whose squared distance is twice the cosine distance) tells which cells can hold
one of a question's k nearest; the other folders are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.knn import NearPairs, unit_rows
from passagekit.operators.topk import BEST_FIELDS, MAX_QUESTIONS, BestRows, bounded, first_k, question_blocks, slices
from passagekit.session import materialize, new_path

#: Cells grow with the square root of the number of vectors up to here, so that all pivots fit in a task.
MAX_CELLS = 4096
#: Where vectors without a direction (NULL or zero) lie.
UNKNOWN = -1
#: Distances are rounded to DECIMALS; the root of twice that is less than this.
SLACK = 2e-5


@dataclass(frozen=True)
class CellStore:
    """vectors: cell, id, embedding, radius. summary: cell, pivot, n, low, high."""

    vectors: DataFrame
    summary: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellStore:
        kind = spark.read.parquet(f"{path}/layout").first()["kind"]
        summary = spark.read.schema("cell int, n long, low double, high double, pivot array<double>").parquet(f"{path}/summary")
        return CellStore(spark.read.schema(kind).parquet(f"{path}/vectors"), summary)


def write_cells(index: DataFrame, path: str, cells: int | None = None, id_col: str = "id", embedding_col: str = "embedding") -> None:
    """Write ids and vectors in folders by cell.

    Pivots are the vectors with the lowest hashed ids, as many as the root of the number of vectors (at most MAX_CELLS). Rows are dealt by
    ranges of (cell, radius), so a cell with any share of the vectors is spread over many tasks and files.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_col).alias("id"), F.col(embedding_col).alias("embedding"))
    known = rows.where(F.exists("embedding", lambda x: x != 0))
    if cells is None:
        cells = min(MAX_CELLS, max(1, round(known.count() ** 0.5)))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(cells).select("embedding").toArrow()
    pivots = unit_rows(chosen["embedding"])[0]
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, valid = unit_rows(pa.chunked_array([batch["embedding"]]))
            cell, radius = np.full(len(held), UNKNOWN), np.zeros(len(held))
            for part in slices(len(shared.value), len(held)):
                if held.shape[1] and len(shared.value):
                    near = held[part] @ shared.value.T
                    cell[part] = np.where(valid[part], near.argmax(axis=1), UNKNOWN)
                    radius[part] = np.sqrt(np.maximum(2.0 - 2.0 * near.max(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["embedding"], pa.array(cell.astype(np.int32)), pa.array(radius, mask=~valid)],
                names=["id", "embedding", "cell", "radius"])

    vector = rows.schema["embedding"].dataType.simpleString()
    kind = f"id long, embedding {vector}, radius double, cell int"
    rows.mapInArrow(assign, f"id long, embedding {vector}, cell int, radius double").repartitionByRange("cell", "radius", "id").sortWithinPartitions("cell", "radius", "id").write.mode(
        "overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.range(1).select(F.lit(kind).alias("kind")).write.mode("overwrite").parquet(f"{path}/layout")
    counts = spark.read.schema(kind).parquet(f"{path}/vectors").groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    centres = spark.createDataFrame(pa.table({
        "cell": np.arange(len(pivots), dtype=np.int32), "pivot": pa.array(list(pivots), pa.list_(pa.float64()))}))
    counts.join(F.broadcast(centres), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def knn_cells(questions: DataFrame, store: CellStore, k: int, qid_col: str = "qid", embedding_col: str = "embedding",
              max_questions: int = MAX_QUESTIONS, report: dict[str, int] | None = None) -> DataFrame:
    """The k nearest stored rows of every question, exactly as `knn` gives them: qid, pos, id, distance.

    `report` gets the number of cells and of those read for the last block of questions.
    """
    asked = questions.select(F.col(qid_col).alias("qid"), F.col(embedding_col).alias("embedding"))
    cells = store.summary.where(F.col("cell") != UNKNOWN).orderBy("cell").toArrow()
    head = bounded(asked, max_questions)
    if head is not None:
        return _nearest(head, store, cells, k, report)
    spark, path = questions.sparkSession, new_path(questions.sparkSession, "lists")
    for block in question_blocks(asked, max_questions):
        _nearest(block.toArrow(), store, cells, k, report).write.mode("append").parquet(path)
    return spark.read.schema("qid long, pos int, id long, distance double").parquet(path)


def _nearest(head: pa.Table, store: CellStore, cells: pa.Table, k: int, report: dict[str, int] | None) -> DataFrame:
    spark = store.vectors.sparkSession
    asked, askable = unit_rows(head["embedding"])
    qids = head["qid"].to_numpy()
    found = [spark.createDataFrame([], BEST_FIELDS)]
    read = 0
    if cells.num_rows and askable.any():
        pivots = np.stack(cells["pivot"].to_numpy())
        if pivots.shape[1] != asked.shape[1]:
            raise ValueError(f"question vectors of {asked.shape[1]}, stored vectors of {pivots.shape[1]}")
        n, low, high = (cells[c].to_numpy() for c in ("n", "low", "high"))
        numbers = cells["cell"].to_numpy()
        away = np.sqrt(np.maximum(2.0 - 2.0 * asked @ pivots.T, 0.0))
        # the cells that surely hold k vectors within the least distance; mostly the first one does
        first = np.zeros(away.shape, bool)
        nearest = np.argmin(away + high, axis=1)
        first[np.arange(len(first)), nearest] = True
        more = np.flatnonzero(n[nearest] < k)
        order = np.argsort(away[more] + high, axis=1, kind="stable")
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, order, np.cumsum(n[order], axis=1) - n[order] < k, axis=1)
        first[more] = chosen
        first &= askable[:, None]
        early = materialize(_scan(store, asked, qids, first, numbers, k))
        last = first_k(early, k).where(F.col("pos") == k - 1).select("qid", "cost").toArrow()
        kth = dict(zip(last["qid"].to_pylist(), last["cost"].to_pylist()))
        bound = np.array([kth.get(q, np.inf) for q in qids.tolist()])
        reach = np.sqrt(np.maximum(2.0 * np.minimum(bound, 2.0), 0.0)) + SLACK
        least = np.maximum(np.maximum(away - high, low - away), 0.0)
        rest = (least <= reach[:, None]) & ~first & askable[:, None]
        found += [early, _scan(store, asked, qids, rest, numbers, k, bound)]
        read = int((first | rest).any(axis=0).sum())
    if report is not None:
        report.update(cells=cells.num_rows, read=read)
    # vectors without a direction come last, and all vectors tie for a question without one
    null = F.lit(None).cast("double").alias("cost")
    listed = spark.createDataFrame(pa.table({"qid": qids, "known": askable}))
    nowhere = store.vectors.where(F.col("cell") == UNKNOWN).select("id").orderBy("id").limit(k)
    found.append(listed.where("known").select("qid").join(F.broadcast(nowhere)).select("qid", "id", null))
    if not askable.all():
        lowest = store.vectors.select("id").orderBy("id").limit(k)
        found.append(listed.where("NOT known").select("qid").join(F.broadcast(lowest)).select("qid", "id", null))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return first_k(whole, k).withColumnRenamed("cost", "distance")


def _scan(store: CellStore, asked: np.ndarray, qids: np.ndarray, wanted: np.ndarray, numbers: np.ndarray, k: int,
          bound: np.ndarray | None = None) -> DataFrame:
    """The k nearest rows per task for the wanted (question, cell) pairs; folders that nobody wants are not read.

    `bound` is a distance for each question above which no row is looked at.
    """
    spark = store.vectors.sparkSession
    shared = spark.sparkContext.broadcast((asked, qids, np.packbits(wanted, axis=0), {int(c): i for i, c in enumerate(numbers)}, bound))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, qids, bits, place, bound = shared.value
        best, near = BestRows(qids, k, bound), NearPairs(asked)
        for batch in batches:
            cell, ids = batch["cell"].to_numpy(), batch["id"].to_numpy()
            held, _ = unit_rows(pa.chunked_array([batch["embedding"]]))
            for one in np.unique(cell):
                rows = np.flatnonzero(cell == one)
                who = np.flatnonzero(np.unpackbits(bits[:, place[int(one)]], count=len(qids)))
                near.add(best, who, held[rows], ids[rows])
        rows = best.rows()
        yield rows.filter(pc.is_valid(rows["cost"]))  # a product that is no number is no distance

    cells = [int(c) for c in numbers[wanted.any(axis=0)]]
    return store.vectors.where(F.col("cell").isin(cells)).select("id", "embedding", "cell").mapInArrow(scan, BEST_FIELDS)
