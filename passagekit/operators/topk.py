"""Score every question against every row of a corpus and keep each question's best k.

Both retrieval operators share this. A task scores one Arrow batch at a time against a block of
questions and keeps k rows per question, so only tasks x questions x k rows are shuffled, never
the scored pairs.

* Up to `max_questions` questions are read to the driver and broadcast. The read stops one row
  after the bound, so the bound is checked before anything larger is collected.
* More questions are written once, numbered, and taken in blocks of at most that many, one after the
  other. Each block is broadcast to a scan of the corpus and its lists are written before the next
  one, so the corpus is never shuffled and the driver holds one block.
* Lists are merged in two levels on clusters: first within slots of tasks, then over the slots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.session import materialize, new_path

MAX_QUESTIONS = 10_000
SCORE_CELLS = 4_000_000

BEST_FIELDS = "qid long, id long, cost double"
_BEST = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("cost", pa.float64())])


class BestRows:
    """The k lowest costs per question so far; equal costs go by id, unknown costs come last.

    `bound` is a cost for each question above which no row matters.
    """

    def __init__(self, qids: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.qids, self.k = qids, k
        self.bound = np.full(len(qids), np.inf) if bound is None else bound
        # Places that no row has yet hold NaN, which sorts behind unknown costs (infinity).
        self.ids = np.full((len(qids), k), np.iinfo(np.int64).max)
        self.costs = np.full((len(qids), k), np.nan)
        # Cost and id of the k-th row of each question, which a new row has to beat.
        self.last_cost = self.bound.copy()
        self.last_id = np.full(len(qids), np.iinfo(np.int64).max)

    def add(self, costs: np.ndarray, ids: np.ndarray, who: np.ndarray | None = None) -> None:
        """Take in costs of shape (questions, rows); `who` are the places of the questions, by default all."""
        if not costs.size:
            return
        costs = np.where(np.isnan(costs), np.inf, costs)
        who = np.arange(len(self.qids)) if who is None else who
        last = self.last_cost[who, None]
        better = (costs < last) | ((costs == last) & (ids < self.last_id[who, None]))
        if costs.shape[1] > self.k and better.sum() > 4 * self.k * len(costs):
            better &= costs <= np.partition(costs, self.k - 1, axis=1)[:, self.k - 1:self.k]
        question, row = np.nonzero(better)
        self.add_pairs(who[question], ids[row], costs[question, row])

    def add_pairs(self, question: np.ndarray, ids: np.ndarray, costs: np.ndarray) -> None:
        """Take in one row of a question each; only the lists of these questions are sorted."""
        better = (costs < self.last_cost[question]) | ((costs == self.last_cost[question]) & (ids < self.last_id[question]))
        question, ids, costs = question[better], ids[better], costs[better]
        if not len(question):
            return
        who, place = np.unique(question, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(who)), self.k), place])
        found = np.concatenate([self.ids[who].ravel(), ids])
        cost = np.concatenate([self.costs[who].ravel(), costs])
        order = np.lexsort((found, cost, place))
        place = place[order]
        kept = order[np.arange(len(order)) - np.searchsorted(place, np.arange(len(who)))[place] < self.k]
        self.ids[who], self.costs[who] = found[kept].reshape(-1, self.k), cost[kept].reshape(-1, self.k)
        last = self.costs[who, -1]
        full = ~np.isnan(last)
        self.last_cost[who[full]], self.last_id[who[full]] = last[full], self.ids[who[full], -1]

    def rows(self) -> pa.RecordBatch:
        question, place = np.nonzero(~np.isnan(self.costs))
        costs = self.costs[question, place]
        cost = pa.array(costs, pa.float64(), mask=np.isinf(costs))
        return pa.RecordBatch.from_arrays([pa.array(self.qids[question]), pa.array(self.ids[question, place]), cost], schema=_BEST)


def best_k(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    make_scorer: Callable[[pa.Table], Callable[[pa.Table, BestRows], None]],
    max_questions: int = MAX_QUESTIONS,
    write_corpus: bool = False,
) -> DataFrame:
    """qid, pos (from 0), id, cost.

    `make_scorer(questions)` returns a function that adds a corpus batch to the best rows. `questions` has a column qid, `corpus`
    a column id. With `write_corpus` a corpus that several blocks of questions meet is worked out and written once.
    """
    spark = questions.sparkSession
    head = bounded(questions, max_questions)
    if head is None:
        return _by_blocks(questions, materialize(corpus) if write_corpus else corpus, k, make_scorer, max_questions)
    if not head.num_rows:
        return first_k(spark.createDataFrame([], BEST_FIELDS), k)
    return first_k(_against_broadcast(spark.sparkContext.broadcast(head), corpus, k, make_scorer), k)


def adding(make: Callable[[pa.Table], Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]]):
    """A scorer for `best_k` from one that gives pairs of costs (questions x rows) and row ids."""
    def make_scorer(questions: pa.Table) -> Callable[[pa.Table, BestRows], None]:
        score = make(questions)

        def add(batch: pa.Table, best: BestRows) -> None:
            for costs, ids in score(batch):
                best.add(costs, ids)

        return add

    return make_scorer


def bounded(questions: DataFrame, limit: int) -> pa.Table | None:
    """The questions if there are at most `limit`; reading stops one row after that."""
    head = questions.limit(limit + 1).toArrow()
    return head if head.num_rows <= limit else None


def _against_broadcast(shared, corpus, k, make_scorer):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shared.value
        score = make_scorer(questions)
        best = BestRows(questions["qid"].to_numpy(), k)
        for batch in batches:
            score(pa.Table.from_batches([batch]), best)
        yield best.rows()

    return corpus.mapInArrow(scan, BEST_FIELDS)


def question_blocks(questions: DataFrame, max_questions: int) -> Iterator[DataFrame]:
    """The questions in blocks of at most `max_questions` rows, from a written and numbered copy."""
    parts = -(-questions.count() // max_questions)
    numbered = materialize(questions.repartition(parts).withColumn("_n", F.monotonically_increasing_id()))
    block = F.struct(F.shiftright("_n", 33).alias("part"), F.expr(f"(_n & {(1 << 33) - 1}) div {max_questions}").alias("turn"))
    for row in sorted(tuple(r[0]) for r in numbered.select(block).distinct().collect()):
        yield numbered.where((block["part"] == row[0]) & (block["turn"] == row[1])).drop("_n")


def _by_blocks(questions, corpus, k, make_scorer, max_questions):
    spark, path = questions.sparkSession, new_path(questions.sparkSession, "lists")
    for block in question_blocks(questions, max_questions):
        shared = spark.sparkContext.broadcast(block.toArrow())
        first_k(_against_broadcast(shared, corpus, k, make_scorer), k).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("qid long, pos int, id long, cost double").parquet(path)


def first_k(found: DataFrame, k: int, slots: int | None = None) -> DataFrame:
    """The k best rows per question: a partial limit in every task, then one row_number.

    With many tasks the rows of a question are cut down to k within each slot of tasks first, so that the last step gets
    slots x k rows of a question and not tasks x k. `slots` is by default the root of the shuffle partitions, and 1 below 8.
    """
    if slots is None:
        slots = isqrt(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        slots = slots if slots >= 8 else 1
    if slots > 1:
        found = _cut(found.withColumn("_slot", F.spark_partition_id() % slots), k, "qid", "_slot")
    ranked = _cut(found, k, "qid")
    return ranked.select("qid", (F.col("pos") - 1).alias("pos"), "id", "cost")


def _cut(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("cost").asc_nulls_last(), "id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def slices(n_questions: int, n_rows: int, cells: int = SCORE_CELLS) -> Iterator[slice]:
    """Cut rows so that one score matrix stays below a fixed number of cells."""
    step = max(cells // max(n_questions, 1), 1)
    return (slice(start, min(start + step, n_rows)) for start in range(0, n_rows, step))
