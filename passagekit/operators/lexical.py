"""Okapi BM25 over whole corpora.

The index keeps one row per chunk with its distinct terms, so a task can score its chunks alone:
bulk questions need no shuffle of postings and no (question, chunk) pairs leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.text import document_tokens, query_tokens
from passagekit.operators.topk import MAX_QUESTIONS, adding, best_k, bounded, slices
from passagekit.session import materialize

# The Okapi parameters and the floor for terms in more than half of the chunks.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Scores are compared at this many decimals, so that copies tie whatever the order of summation.
DECIMALS = 10

# Matched (question, chunk) pairs held at a time inside a task.
PAIR_CELLS = 4_000_000


@dataclass(frozen=True)
class LexicalIndex:
    """chunks: id, dl, terms, tfs. terms: term, df, idf. stats: one row n, avgdl, mean_idf."""

    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame
    avgdl: float | None = None

    def postings(self) -> DataFrame:
        """term, id, tf."""
        return _postings(self.chunks).select("term", "id", "tf")

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        chunks, terms, stats = (spark.read.parquet(f"{path}/{part}") for part in ("chunks", "terms", "stats"))
        return LexicalIndex(chunks, terms, stats, stats.first()["avgdl"])


def _postings(chunks: DataFrame) -> DataFrame:
    """id, dl, term, tf. The outer form keeps the optimizer from counting once more in a filter of its own."""
    pairs = chunks.select("id", "dl", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p"))
    return pairs.select("id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).filter("term is not null")


@F.arrow_udf(T.StructType([
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]))
def _count_terms(tokens: pa.Array) -> pa.Array:
    """The distinct tokens of each row in alphabetical order, and how often each occurs."""
    coded = tokens.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rows = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    words = max(len(order), 1)
    keys, counts = np.unique(rows * words + rank[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    offsets = pa.array(np.searchsorted(keys, np.arange(len(tokens) + 1) * words).astype(np.int32))
    terms = coded.dictionary.take(pa.array(order)).take(pa.array(keys % words))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
        names=["terms", "tfs"])


def add_term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """Add dl, terms and tfs: how many tokens, the distinct ones, and how often each occurs. No shuffle."""
    held = df.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    counted = held.select(*df.columns, F.size("_tokens").alias("dl"), _count_terms.asNondeterministic()("_tokens").alias("_counted"))
    return counted.select(*df.columns, "dl", "_counted.terms", "_counted.tfs")


def chunk_terms(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, dl, terms, tfs."""
    keyed = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return add_term_counts(keyed, document_tokens(F.col("_text"))).drop("_text")


def bm25_index(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> LexicalIndex:
    """Term counts per chunk, document frequencies and corpus statistics.

    One pass counts everything: each chunk contributes its distinct terms and, under the NULL term,
    its length. Counts are combined before the shuffle, so a term that all chunks share costs one
    row per task. The small term table is written once; chunks stay lazy.
    """
    counted = chunk_terms(chunks, id_col, text_col)
    lengths = chunks.select(
        F.coalesce(document_tokens(F.col(text_col)), F.array().cast("array<string>")).alias("_tokens"))
    entries = lengths.select(
        F.size("_tokens").cast("long").alias("dl"),
        F.explode_outer(F.concat(F.array_distinct("_tokens"), F.array(F.lit(None).cast("string")))).alias("term"),
    )
    totals = materialize(entries.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total")))
    corpus = totals.filter("term is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    corpus_rows = corpus.collect()
    n, avgdl = corpus_rows[0] if corpus_rows else (0, None)
    raw_idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    known = totals.filter("term is not null").select("term", "df", raw_idf.alias("_raw"))
    exact = F.sum(F.col("_raw").cast("decimal(24,17)"))  # the same sum whatever the order of the rows
    mean = known.agg((exact.cast("double") / F.count("_raw")).alias("mean_idf")).first()["mean_idf"]
    idf = F.when(F.col("_raw") < 0, F.lit(mean).cast("double") * EPSILON).otherwise(F.col("_raw"))
    stats = totals.sparkSession.range(1).select(
        F.lit(n).cast("long").alias("n"), F.lit(avgdl).cast("double").alias("avgdl"), F.lit(mean).cast("double").alias("mean_idf"))
    return LexicalIndex(counted, known.select("term", "df", idf.alias("idf")), stats, avgdl)


def question_terms(questions: DataFrame, index: LexicalIndex, qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """qid and its known terms as an array of (term, weight); weight = idf times the repeats in the question.

    Questions without a known term keep an empty array.
    """
    words = add_term_counts(
        questions.select(F.col(qid_col).alias("qid"), F.col(query_col).alias("_query")), query_tokens(F.col("_query")))
    pairs = words.select("qid", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p"))
    asked = pairs.select("qid", F.col("p.terms").alias("term"), F.col("p.tfs").alias("repeats"))
    entry = F.struct("term", (F.col("idf") * F.col("repeats")).alias("weight"))
    # the few asked terms go to the term table, not the other way round
    known = index.terms.join(asked.select("term").distinct(), "term", "left_semi")
    return asked.join(known, "term", "left").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("idf").isNotNull(), entry))).alias("entries"))


class _Matcher:
    """A block of questions by term: for each vocabulary word, who asks it and with which weight."""

    def __init__(self, questions: pa.Table):
        entries = questions["entries"].combine_chunks()
        owners = np.repeat(np.arange(len(entries)), np.diff(entries.offsets.to_numpy()))
        flat = entries.flatten()
        coded = flat.field("term").dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.size = len(entries)
        self.vocabulary = coded.dictionary
        self.owners = owners[order]
        self.weights = flat.field("weight").to_numpy(zero_copy_only=False)[order]
        self.starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))

    def matches(self, batch: pa.Table, avgdl: float):
        """Rows, vocabulary codes and saturated term counts of the batch's terms that someone asks for."""
        terms = batch["terms"].combine_chunks()
        rows = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
        codes = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        asked = codes >= 0
        rows, codes = rows[asked], codes[asked]
        tf = batch["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[asked].astype(np.float64)
        lengths = batch["dl"].to_numpy()[rows]
        return rows, codes, tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / avgdl))


def _bm25_scorer(avgdl: float | None):
    avgdl = avgdl or 1.0  # an index without tokens matches nothing

    def make(questions: pa.Table):
        matcher = _Matcher(questions)

        def score(batch: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            ids = batch["id"].to_numpy()
            rows, codes, gains = matcher.matches(batch, avgdl)
            askers = np.diff(matcher.starts)[codes]
            for part in slices(matcher.size, len(ids), PAIR_CELLS):
                width = part.stop - part.start
                scores = np.zeros(matcher.size * width)
                lo, hi = np.searchsorted(rows, [part.start, part.stop])
                for a, b in _spans(askers[lo:hi], PAIR_CELLS):
                    span = slice(lo + a, lo + b)
                    counts = askers[span]
                    before = np.cumsum(counts) - counts
                    slot = np.arange(counts.sum()) + np.repeat(matcher.starts[codes[span]] - before, counts)
                    cells = matcher.owners[slot] * width + np.repeat(rows[span] - part.start, counts)
                    scores += np.bincount(cells, matcher.weights[slot] * np.repeat(gains[span], counts), len(scores))
                yield 0.0 - np.round(scores.reshape(matcher.size, width), DECIMALS), ids[part]

        return score

    return make


def _spans(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut entries into runs whose counts stay near the limit."""
    reached = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = reached[start - 1] if start else 0
        end = max(int(np.searchsorted(reached, base + limit, side="right")), start + 1)
        yield start, end
        start = end


def bm25_topk(questions: DataFrame, index: LexicalIndex, k: int, qid_col: str = "qid", query_col: str = "query",
              max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """The k best chunks of every question: qid, pos (from 0), id, score.

    Ties go by id. Chunks that match nothing score 0 and fill up the list when fewer than k score
    higher.
    """
    asked = question_terms(questions, index, qid_col, query_col)
    hits = best_k(asked, index.chunks, k, adding(_bm25_scorer(index.avgdl)), max_questions)
    return hits.select("qid", "pos", "id", (-F.col("cost") + F.lit(0.0)).alias("score"))


def bm25_scores(questions: DataFrame, index: LexicalIndex, qid_col: str = "qid", query_col: str = "query",
                max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """The score of every chunk for every question, without the zeros: qid, id, score.

    The result itself holds a row per scoring pair; for rankings use `bm25_topk`, which keeps the
    pairs inside the tasks. Up to `max_questions` each task writes the scores of its own chunks and
    nothing is shuffled; beyond that postings and questions are joined by term.
    """
    asked = question_terms(questions, index, qid_col, query_col)
    head = bounded(asked, max_questions)
    if head is None:
        return _joined_scores(asked, index)
    shared = questions.sparkSession.sparkContext.broadcast(head)
    make = _bm25_scorer(index.avgdl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = shared.value["qid"].to_numpy()
        score = make(shared.value)
        for batch in batches:
            for costs, ids in score(pa.Table.from_batches([batch])):
                question, row = np.nonzero(costs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[question]), pa.array(ids[row]), pa.array(-costs[question, row])], names=["qid", "id", "score"])

    return index.chunks.mapInArrow(scan, "qid long, id long, score double")


def _joined_scores(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    weights = asked.select("qid", F.explode_outer("entries").alias("e")).select("qid", "e.term", "e.weight")
    tf = F.col("tf").cast("double")
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl or 1.0)))
    scored = _postings(index.chunks).select("id", "term", gain.alias("gain")).join(weights, "term")
    totals = scored.groupBy("qid", "id").agg(F.round(F.sum(F.col("gain") * F.col("weight")), DECIMALS).alias("score"))
    return totals.filter("score <> 0")
