"""BM25 from postings on disk: only the asked terms are read, and only the parts of the corpus that can reach a list.

The corpus is cut into parts of at most `PART_ROWS` chunks. A block holds one term's postings of one part with the largest
saturated count in it, its peak. Blocks lie in folders by a hash of the term. For a question, the sum of weight times peak over
its terms bounds every score in a part, so a part below the k-th score found so far is skipped unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.functions.text import query_tokens
from passagekit.operators.lexical import B, DECIMALS, K1, PAIR_CELLS, LexicalIndex, add_term_counts, bm25_topk
from passagekit.operators.topk import BEST_FIELDS, MAX_QUESTIONS, BestRows, bounded, first_k, question_blocks
from passagekit.session import materialize, new_path

#: Chunks of a part, at most; also bounded by the rows of an Arrow batch.
PART_ROWS = 2000
#: Folders that the terms are dealt to by hash.
BUCKETS = 64
#: Parts that are scored first for every question, to learn a score that its list reaches at least.
FIRST_PARTS = 2
#: Scores are rounded to DECIMALS; a bound this much below the k-th score still counts as reaching it.
SLACK = 1e-6

_PAIRS = "part long, qid long"
_BLOCKS = "term string, part long, peak double, ids array<long>, gains array<double>"


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(term) % buckets).cast("int")


@dataclass(frozen=True)
class PostingsIndex:
    """blocks: bucket, term, part, peak, ids, gains. terms: bucket, term, df, idf. lexical: the index by chunks, for the rare rest."""

    blocks: DataFrame
    terms: DataFrame
    lexical: LexicalIndex
    buckets: int

    @staticmethod
    def load(spark: SparkSession, path: str) -> PostingsIndex:
        blocks = spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{path}/blocks")
        terms = spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/asked_terms")
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        return PostingsIndex(blocks, terms, LexicalIndex.load(spark, path), buckets)


def _blocks_of(avgdl: float):
    """The blocks of each Arrow batch of chunks; a batch is a part."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, PART_ROWS):
                yield _part_blocks(whole.slice(start, PART_ROWS), part, avgdl)
                part += 1

    return cut


def _part_blocks(batch: pa.RecordBatch, part: int, avgdl: float) -> pa.RecordBatch:
    lists = [pc.list_flatten(batch[c]) for c in ("terms", "tfs")]
    rows = pc.list_parent_indices(batch["terms"]).to_numpy(zero_copy_only=False)
    coded = lists[0].dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((rows, codes))
    codes, rows = codes[order], rows[order]
    tf = lists[1].to_numpy(zero_copy_only=False)[order].astype(np.float64)
    lengths = batch["dl"].to_numpy(zero_copy_only=False)[rows]
    gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / avgdl))
    ids = batch["id"].to_numpy(zero_copy_only=False)[rows]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    offsets = pa.array(np.append(starts, len(codes)).astype(np.int32))
    peaks = np.maximum.reduceat(gains, starts) if len(starts) else np.empty(0)
    return pa.RecordBatch.from_arrays([
        coded.dictionary.take(pa.array(codes[starts])), pa.array(np.full(len(starts), part, np.int64)), pa.array(peaks),
        pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(gains)),
    ], names=["term", "part", "peak", "ids", "gains"])


def write_postings(index: LexicalIndex, path: str, buckets: int = BUCKETS) -> None:
    """Write the index by chunks and, beside it, its blocks and terms in folders by the hash of the term.

    Blocks are dealt by ranges of (folder, term, part), so a term that every chunk holds is spread over many tasks and files, and
    files are sorted by term.
    """
    index.save(path)
    spark = index.terms.sparkSession
    chunks = spark.read.parquet(f"{path}/chunks").select("id", "dl", "terms", "tfs")
    blocks = chunks.mapInArrow(_blocks_of(index.avgdl or 1.0), _BLOCKS)
    placed = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets))
    placed.repartitionByRange("bucket", "term", "part").sortWithinPartitions("bucket", "term", "part").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/terms").withColumn("bucket", bucket_of(F.col("term"), buckets))
    terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/asked_terms")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


class _Asked:
    """A block of questions: for each asked term its number, and the weights by (question, term)."""

    def __init__(self, words: pa.Table, idf: pa.Table):
        weight = dict(zip(idf["term"].to_pylist(), idf["idf"].to_pylist()))
        self.qids = np.unique(words["qid"].to_numpy())
        entries = [(t, q, weight[t] * n) for q, t, n in zip(*(words[c].to_pylist() for c in ("qid", "term", "repeats"))) if t in weight]
        entries.sort()
        self.number = {t: i for i, t in enumerate(sorted({e[0] for e in entries}))}
        terms = np.array([self.number[e[0]] for e in entries], np.int64)
        self.owner = np.searchsorted(self.qids, np.array([e[1] for e in entries], np.int64))
        self.weight = np.array([e[2] for e in entries], np.float64)
        self.starts = np.searchsorted(terms, np.arange(len(self.number) + 1))

    def entries_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a list of terms: which of them, and which entry, for every question that asks it."""
        counts = self.starts[codes + 1] - self.starts[codes]
        which = np.repeat(np.arange(len(codes)), counts)
        return which, np.arange(counts.sum()) + np.repeat(self.starts[codes] - np.cumsum(counts) + counts, counts)


def postings_topk(questions: DataFrame, index: PostingsIndex, k: int, qid_col: str = "qid", query_col: str = "query",
                  max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """The k best chunks of every question, exactly as `bm25_topk` gives them: qid, pos, id, score.

    Questions are taken in blocks of at most `max_questions`; a block's terms and weights are broadcast.
    """
    asked = questions.select(F.col(qid_col).alias("qid"), F.col(query_col).alias("query"))
    if bounded(asked.select("qid"), max_questions) is not None:
        return _block_topk(asked, index, k)
    spark, path = questions.sparkSession, new_path(questions.sparkSession, "lists")
    for block in question_blocks(asked, max_questions):
        _block_topk(block, index, k).write.mode("append").parquet(path)
    return spark.read.schema("qid long, pos int, id long, score double").parquet(path)


def asked_terms(names: list[str], index: PostingsIndex) -> tuple[list[int], DataFrame]:
    """The folders of the asked terms, and these terms with their weights; nothing else of the term table is read or moved."""
    buckets = sorted({crc32(t.encode()) % index.buckets for t in names})
    listed = _names(index.terms.sparkSession, names)
    known = index.terms.where(F.col("bucket").isin(buckets)).join(F.broadcast(listed), "term", "left_semi")
    return buckets, known.select("term", "idf")


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"term": pa.array(names, pa.string())}))


def _block_topk(asked: DataFrame, index: PostingsIndex, k: int) -> DataFrame:
    spark = asked.sparkSession
    counted = add_term_counts(asked, query_tokens(F.col("query")))
    pairs = counted.select("qid", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    words = pairs.select("qid", F.col("p.terms").alias("term"), F.col("p.tfs").alias("repeats")).toArrow()
    if not words.num_rows:
        return _filled(asked, None, index, k)
    buckets, known = asked_terms(sorted(set(words["term"].to_pylist())), index)
    idf = known.toArrow()
    if not idf.num_rows:
        return _filled(asked, None, index, k)
    shared = spark.sparkContext.broadcast(_Asked(words, idf))
    vocabulary = _names(spark, sorted(shared.value.number))
    blocks = index.blocks.where(F.col("bucket").isin(buckets)).join(F.broadcast(vocabulary), "term", "left_semi")
    # terms and peaks of each part: at most as many as there are asked terms
    peaks = materialize(blocks.groupBy("part").agg(F.collect_list("term").alias("terms"), F.collect_list("peak").alias("peaks")))
    first = materialize(first_k(peaks.mapInArrow(_best_parts(shared), BEST_FIELDS), FIRST_PARTS))
    first_pairs = first.where("cost < 0").select(F.col("id").alias("part"), "qid")
    early = materialize(_scored(blocks, first_pairs, shared, k))
    reached = first_k(early, k).where(F.col("pos") == k - 1).select("qid", "cost").toArrow()
    floor = dict(zip(reached["qid"].to_pylist(), reached["cost"].to_pylist()))
    thresholds = spark.sparkContext.broadcast(np.array([max(-floor.get(q, 0.0), 0.0) for q in shared.value.qids.tolist()]))
    reaching = peaks.mapInArrow(_reaching_parts(shared, thresholds), _PAIRS)
    rest = reaching.join(first_pairs, ["part", "qid"], "left_anti")
    late = _scored(blocks, rest, shared, k)
    hits = first_k(early.unionByName(late), k)
    if (shared.value.weight < 0).any():
        # a term of negative weight can put chunks below those that match nothing; such questions take the scan
        below = spark.createDataFrame(
            [(int(q),) for q in np.unique(shared.value.qids[shared.value.owner[shared.value.weight < 0]])], "qid long")
        scanned = bm25_topk(asked.join(F.broadcast(below), "qid", "left_semi"), index.lexical, k)
        others = asked.join(F.broadcast(below), "qid", "left_anti")
        return _filled(others, hits.join(F.broadcast(below), "qid", "left_anti"), index, k).unionByName(scanned)
    return _filled(asked, hits, index, k)


def _bounds(shared: _Asked, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """Upper bounds of (questions x parts) for slices of a batch of parts."""
    for start in range(0, batch.num_rows, step := max(PAIR_CELLS // max(len(shared.qids), 1), 1)):
        piece = batch.slice(start, step)
        terms = pc.list_flatten(piece["terms"]).to_pylist()
        row = pc.list_parent_indices(piece["terms"]).to_numpy(zero_copy_only=False)
        peaks = pc.list_flatten(piece["peaks"]).to_numpy(zero_copy_only=False)
        which, entry = shared.entries_of(np.array([shared.number[t] for t in terms], np.int64))
        cells = shared.owner[entry] * piece.num_rows + row[which]
        gains = np.maximum(shared.weight[entry], 0.0) * peaks[which]
        sums = np.bincount(cells, gains, len(shared.qids) * piece.num_rows)
        yield slice(start, start + piece.num_rows), sums.reshape(len(shared.qids), piece.num_rows)


def _best_parts(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(shared.value.qids, FIRST_PARTS)
        for batch in batches:
            parts = batch["part"].to_numpy()
            for piece, sums in _bounds(shared.value, batch):
                best.add(-sums, parts[piece])
        yield best.rows()

    return scan


def _reaching_parts(shared, thresholds):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["part"].to_numpy()
            for piece, sums in _bounds(shared.value, batch):
                question, row = np.nonzero((sums > 0) & (sums >= thresholds.value[:, None] - SLACK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[piece][row]), pa.array(shared.value.qids[question])], names=["part", "qid"])

    return scan


def _scored(blocks: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """The k best chunks of each (part, question) pair. Only blocks of parts that a pair names are read further; a group is one part."""
    def score(part: pa.Table, wanted: pa.Table) -> pa.Table:
        asked = shared.value
        questions = np.unique(np.searchsorted(asked.qids, wanted["qid"].to_numpy()))
        best = BestRows(asked.qids[questions], k)
        if part.num_rows and len(questions):
            part = part.combine_chunks()
            codes = np.array([asked.number[t] for t in part["term"].to_pylist()], np.int64)
            lists = part["ids"].combine_chunks() if isinstance(part["ids"], pa.ChunkedArray) else part["ids"]
            block = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            ids, row = np.unique(pc.list_flatten(lists).to_numpy(zero_copy_only=False), return_inverse=True)
            gains = pc.list_flatten(part["gains"].combine_chunks()).to_numpy(zero_copy_only=False)
            for start in range(0, len(questions), step := max(PAIR_CELLS // len(ids), 1)):
                some = questions[start:start + step]
                place = np.full(len(asked.qids), -1)
                place[some] = np.arange(len(some))
                scores = np.zeros(len(some) * len(ids))
                for a in range(0, len(block), PAIR_CELLS // 16):
                    span = slice(a, a + PAIR_CELLS // 16)
                    which, entry = asked.entries_of(codes[block[span]])
                    mine = place[asked.owner[entry]] >= 0
                    which, entry = which[mine], entry[mine]
                    cells = place[asked.owner[entry]] * len(ids) + row[span][which]
                    scores += np.bincount(cells, asked.weight[entry] * gains[span][which], len(scores))
                costs = 0.0 - np.round(scores.reshape(len(some), len(ids)), DECIMALS)
                costs[costs >= 0] = np.inf  # chunks that score nothing are filled in later
                here = np.full((len(questions), len(ids)), np.inf)
                here[start:start + step] = costs
                best.add(here, ids)
        rows = best.rows()
        return pa.Table.from_batches([rows.filter(pc.is_valid(rows["cost"]))])

    named = pairs.select("part").distinct()
    mine = blocks.select("part", "term", "ids", "gains").join(named, "part", "left_semi")
    return mine.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(score, BEST_FIELDS)


def _filled(asked: DataFrame, hits: DataFrame | None, index: PostingsIndex, k: int) -> DataFrame:
    """Lists with fewer than k positive scores are filled with zeros in id order; of the 2k lowest ids k are in no such list."""
    spark = asked.sparkSession
    zero = index.lexical.chunks.select("id").orderBy("id").limit(2 * k)
    hits = spark.createDataFrame([], "qid long, pos int, id long, cost double") if hits is None else materialize(hits)
    short = asked.select("qid").join(hits.where(F.col("pos") == k - 1).select("qid"), "qid", "left_anti")
    fill = short.join(F.broadcast(zero)).join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    both = hits.select("qid", "id", "cost").unionByName(fill.select("qid", "id", F.lit(0.0).alias("cost")))
    return first_k(both, k).select("qid", "pos", "id", (-F.col("cost") + F.lit(0.0)).alias("score"))
