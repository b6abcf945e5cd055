"""Merge ranked lists, re-rank by tag, truncate and collect the context of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.uris import TAG_PATTERN, tag_of
from passagekit.session import materialize
from passagekit.sources.index_store import RANGE, RANGE_BITS

# Hits up to this many rows (ids, positions and scores, under 100 bytes each) are broadcast.
BROADCAST_HITS = 200_000
# Hit ids up to this many (8 bytes each, under 300 MB as a hash table) are broadcast as a filter.
BROADCAST_IDS = 8_000_000
# Folders of an index by ranges that a filter may name.
MAX_FOLDERS = 10_000


def attach_chunks(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None, id_col: str = "id",
                  broadcast_hits: int = BROADCAST_HITS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Add text and source to hits after ranking, without shuffling the corpus where that can be avoided.

    `max_hits` is a proven bound on the number of hits (questions x k). Few hits are broadcast to
    the chunks. Of more hits only the ids are broadcast, which leaves the chunks that were hit for
    an ordinary join. Without a bound, or beyond both, both sides are shuffled by id. A hit whose id the chunks lack, as
    from an index that is older or newer, stops the job. Chunks of `read_ranges` are read only in the folders of the hits.
    """
    if RANGE in chunks.columns:
        return _attach_ranges(hits, chunks, max_hits, id_col, broadcast_ids)
    body = chunks.select(F.col(id_col).alias("id"), "text", "source", F.lit(True).alias("_known"))
    if max_hits is not None and max_hits <= broadcast_ids:
        hits = materialize(hits)
        ids = F.broadcast(hits.select("id").distinct()) if max_hits > broadcast_hits else F.broadcast(hits.select("id"))
        body = body.join(ids, "id", "left_semi")
    return _with_texts(hits, hits.join(body, "id", "left"))


def _attach_ranges(hits: DataFrame, chunks: DataFrame, max_hits: int | None, id_col: str, broadcast_ids: int) -> DataFrame:
    """The folders to read are found at run time from the broadcast hits, or named beforehand where the hits are too many."""
    layout = chunks.select(RANGE_BITS).first()
    hits = materialize(hits.withColumn(RANGE, F.shiftright("id", layout[0] if layout else 0)))
    body = chunks.select(F.col(id_col).alias("id"), RANGE, "text", "source", F.lit(True).alias("_known"))
    wanted = hits.select(RANGE, "id").where(F.col(RANGE) >= F.lit(-1 << 62)).distinct()  # only a filtered side prunes folders at run time
    if max_hits is not None and max_hits <= broadcast_ids:
        body = body.join(F.broadcast(wanted), [RANGE, "id"], "left_semi")
    else:
        folders = [r[0] for r in wanted.select(RANGE).distinct().limit(MAX_FOLDERS + 1).collect()]
        body = body.where(F.col(RANGE).isin(folders)) if len(folders) <= MAX_FOLDERS else body
    return _with_texts(hits.drop(RANGE), hits.drop(RANGE).join(body.drop(RANGE), "id", "left"))


def _with_texts(hits: DataFrame, found: DataFrame) -> DataFrame:
    known = F.when(F.col("_known"), F.col("text")).otherwise(
        F.raise_error(F.concat(F.lit("no chunk has the id of a hit: "), F.col("id").cast("string"))).cast("string"))
    others = [c for c in hits.columns if c != "id"]
    return found.select("id", known.alias("text"), "source", *others)


def splice(semantic: DataFrame, lexical: DataFrame, k: int, dedup: bool = False) -> DataFrame:
    """Insert the lexical hits before position k of the semantic ones: qid, pos, id, score.

    With fewer than k semantic hits they follow at the end. An id found by both lists stays twice
    unless `dedup`, which keeps its first place.
    """
    both = semantic.select("qid", "pos", "id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("_lexical")).unionByName(
        lexical.select("qid", "pos", "id", "score", F.lit(True).alias("_lexical")))
    group = Window.partitionBy("qid")
    n_lexical = F.sum(F.col("_lexical").cast("int")).over(group)
    n_semantic = F.sum((~F.col("_lexical")).cast("int")).over(group)
    place = (
        F.when(F.col("_lexical"), F.least(F.lit(k), n_semantic) + F.col("pos"))
        .when(F.col("pos") < k, F.col("pos"))
        .otherwise(F.col("pos") + n_lexical)
    )
    merged = both.select("qid", place.cast("int").alias("pos"), "id", "score")
    if dedup:
        first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("pos"))
        merged = merged.withColumn("_first", first).filter("_first = 1").drop("_first")
        merged = _renumber(merged, F.col("pos"))
    return merged


def _renumber(hits: DataFrame, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1
    return hits.withColumn("_place", place).withColumn("pos", F.col("_place")).drop("_place")


def rerank_by_tag(hits: DataFrame, predicted: str = "predicted", pattern: str = TAG_PATTERN, source: str = "source",
                  other: str = "other") -> DataFrame:
    """Hits with the predicted tag first, each part in its old order; no change where the tag is `other`."""
    mismatch = F.coalesce(tag_of(F.col(source), pattern) != F.col(predicted), F.lit(True))
    return _renumber(hits, F.when(F.coalesce(F.col(predicted) != other, F.lit(False)), mismatch), F.col("pos"))


def truncate_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of every question."""
    return hits.filter(F.col("pos") < k)


def collect_context(hits: DataFrame, distinct_sources: bool = True) -> DataFrame:
    """One row per question: document_ids, texts and sources in hit order, and the context structs.

    A group holds the hits of one question, which the retrieval operators bound by their k.
    """
    row = F.struct("pos", "id", "text", "source")
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("_hits"))
    sources = F.col("_hits.source")
    return grouped.select(
        "qid",
        F.col("_hits.id").alias("document_ids"),
        F.col("_hits.text").alias("texts"),
        (F.array_distinct(sources) if distinct_sources else sources).alias("sources"),
        F.transform("_hits", lambda h: F.struct(h["id"].alias("id"), h["text"].alias("text"), h["source"].alias("source"))).alias("chunks"),
    )
