"""A training corpus from raw documents: toxic ones out, boilerplate lines out, one of each near copy, sources mixed, packed.

Each stage works on all rows that the stage before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.catalog import TOKENIZERS
from passagekit.llm.common import stored, table
from passagekit.llm.jaccard_join import one_of_each
from passagekit.llm.line_dedup import drop_site_lines
from passagekit.llm.mixing import mix_sources
from passagekit.llm.packing import pack_documents
from passagekit.llm.toxicity import score_toxicity
from passagekit.session import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scored = score_toxicity(docs.select(*COLUMNS), table(prepare(spark), sf_dir, "labels"), keep=True)
    return scored.where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many different documents of their source share; their length is that of what is left."""
    return drop_site_lines(docs.select(*COLUMNS), copies_vote=False).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: texts whose five-word shingles have a Jaccard index of 0.8 or more."""
    prepare(spark)
    return one_of_each(docs.select(*COLUMNS), n=5, share=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target weights, in global random order."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    prepare(spark)
    return pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Learned scores and packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
