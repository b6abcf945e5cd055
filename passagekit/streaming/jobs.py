"""The index build and batch answering as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from passagekit.operators.lexical import LexicalIndex
from passagekit.plans.answering import AnswerConfig, answer_questions
from passagekit.plans.index_build import IndexConfig, build_index
from passagekit.schemas import PAGES, QUESTIONS
from passagekit.sources.index_store import index_rows
from passagekit.sources.records import log_events
from passagekit.sources.refresh import PAGE_BITS, page_digest, upsert_pages


def read_page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Pages as their Parquet files arrive."""
    reader = spark.readStream.schema(PAGES)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_question_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Questions as their Parquet files arrive."""
    reader = spark.readStream.schema(QUESTIONS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def index_stream(pages: DataFrame, path: str, checkpoint: str, config: IndexConfig = IndexConfig(),
                 trigger: dict | None = None) -> StreamingQuery:
    """Append arriving pages to the index. The same stateless plan as the batch build; the file sink
    and its checkpoint write every page exactly once."""
    return (
        index_rows(build_index(pages, config)).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Pages as their Parquet files arrive, with the time of their file as `arrived`."""
    return read_page_stream(spark, path, files_per_trigger).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def changed_pages(arrivals: DataFrame) -> DataFrame:
    """Of arriving pages (page_id, url, html, arrived) those whose content is not the last one seen under their number.

    The state of a page is its last digest. Of several versions in one batch the latest counts, of equal times the one with the
    greatest digest. A group holds what one batch brings of one page.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = None
        for part in parts:
            row = part.sort_values(["arrived", "digest"]).iloc[-1:]
            if latest is None or tuple(row[["arrived", "digest"]].iloc[0]) > tuple(latest[["arrived", "digest"]].iloc[0]):
                latest = row
        digest = latest["digest"].iloc[0]
        if not state.exists or state.get[0] != digest:
            state.update((digest,))
            yield latest[["page_id", "url", "html"]]

    rows = arrivals.select("page_id", "url", "html", "arrived", page_digest().alias("digest"))
    return rows.groupBy("page_id").applyInPandasWithState(
        keep, "page_id long, url string, html string", "digest string", "append", "NoTimeout")


def refresh_stream(arrivals: DataFrame, path: str, checkpoint: str, config: IndexConfig = IndexConfig(),
                   trigger: dict | None = None, page_bits: int = PAGE_BITS) -> StreamingQuery:
    """Keep a store (see `sources/refresh.py`) up to date with arriving pages.

    A page that comes again unchanged is dropped by its state; a changed one replaces its chunks. A retried batch
    replaces the same pages by the same chunks.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_pages(batch, path, config, page_bits)

    return (
        changed_pages(arrivals).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def answer_stream(questions: DataFrame, index: DataFrame, factory: Callable[..., object], path: str, checkpoint: str,
                  lexical: LexicalIndex | None = None, reranker: PipelineModel | None = None,
                  config: AnswerConfig = AnswerConfig(), trigger: dict | None = None) -> StreamingQuery:
    """Answer arriving questions and log them under `path/batch_id=<n>`.

    A retried batch overwrites its own folder, so nothing is logged twice. Pass a written index and
    a saved lexical index: what is still lazy would be computed again for every batch.
    """

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        answers = answer_questions(batch, index, factory, lexical, reranker, config)
        events = log_events(answers, "finished streaming query", F.col("question"), "qid", "sources")
        events.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return (
        questions.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
