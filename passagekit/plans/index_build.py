"""From pages to an index of embedded chunks, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.uris import DOMAIN, SCHEME
from passagekit.operators.chunking import assign_ids, chunk_text, chunks_of_sections
from passagekit.operators.embedding import embed_with
from passagekit.operators.metrics import timed, with_metrics
from passagekit.operators.sections import section_lists
from passagekit.schemas import CHUNK_OVERLAP, CHUNK_SIZE
from passagekit.sources.index_store import write_index


@dataclass(frozen=True)
class IndexConfig:
    model: str = "hash-64"
    models: dict[str, Callable] = field(default_factory=dict)
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    container: str = "section"
    require_id: bool = True
    scheme: str = SCHEME
    domain: str | None = DOMAIN


def page_sections(pages: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """One row per page with the list of its sections."""
    return section_lists(pages.select("page_id", "url", "html"), config.container, config.require_id,
                         scheme=config.scheme, domain=config.domain)


def section_chunks(sections: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """id, text, source of all chunks of pages with their lists of sections."""
    chunks = chunks_of_sections(F.col("_sections"), config.chunk_size, config.chunk_overlap)
    rows = sections.select("page_id", "_uri", F.posexplode(chunks).alias("chunk_pos", "_chunk"))
    source = F.concat_ws("#", "_uri", F.nullif(F.col("_chunk.anchor"), F.lit("")))
    return assign_ids(rows).select("id", F.col("_chunk.text").alias("text"), source.alias("source"))


def build_index(pages: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """id, text, source, embedding of every chunk. No shuffle: each page becomes its chunks in place."""
    return embed_with(section_chunks(page_sections(pages, config), config), "text", config.model, config.models)


def chunk_documents(documents: DataFrame, config: IndexConfig = IndexConfig(), id_col: str = "doc_id") -> DataFrame:
    """Chunks of plain documents: id, text, source."""
    chunks = chunk_text(documents.select(F.col(id_col).alias("_page"), "source", "text"), config.chunk_size, config.chunk_overlap)
    return assign_ids(chunks, "_page").select("id", "text", "source")


def build_and_write(pages: DataFrame, path: str, config: IndexConfig = IndexConfig(), mode: str = "append") -> dict[str, float]:
    """Write the index in one job; seconds and row counts of the stages come from the same run."""
    seen, n_pages = with_metrics(pages, "pages")
    sections, n_sections = with_metrics(page_sections(seen, config), "sections", F.size("_sections"))
    chunks, n_chunks = with_metrics(section_chunks(sections, config), "chunks")
    index = embed_with(chunks, "text", config.model, config.models)
    return timed(lambda: write_index(index, path, mode), n_pages, n_sections, n_chunks)
