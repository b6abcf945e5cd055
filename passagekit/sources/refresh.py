"""Keep a stored index up to date: only pages that are new or changed are built, only the folders they belong to are rewritten.

The store has `chunks` (see `write_ranges`) and `pages` (page_id, url, digest), both in folders by the same ranges of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.plans.index_build import IndexConfig, build_index
from passagekit.schemas import INDEX
from passagekit.session import materialize
from passagekit.sources.index_store import RANGE, RANGE_BITS, read_ranges, write_ranges

#: Low bits of an id that number the chunks of a page.
CHUNK_BITS = 28
#: Pages of a folder, as a power of two.
PAGE_BITS = 10
#: Folders that a filter may name; beyond it the folders are found by a join.
MAX_FOLDERS = 10_000

_PAGES = f"page_id long, url string, digest string, {RANGE} long"


def page_digest() -> Column:
    """A digest of a page's url and html. NULL and empty html differ."""
    content = F.concat_ws("\n", F.coalesce("url", F.lit("")), F.when(F.col("html").isNull(), "-").otherwise(F.concat(F.lit("+"), "html")))
    return F.sha2(content, 256)


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, digest of the pages in the store; none if nothing was stored."""
    if not _exists(spark, f"{path}/pages"):
        return spark.createDataFrame([], _PAGES)
    return spark.read.schema(_PAGES).parquet(f"{path}/pages")


def stored_index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of the stored chunks, and the range that lookups by id prune by."""
    return read_ranges(spark, f"{path}/chunks", *columns)


def page_changes(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """page_id and status of every page on either side: new, changed, same or gone. Only numbers and digests are compared."""
    now = pages.select("page_id", page_digest().alias("_now"))
    before = stored.select("page_id", F.col("digest").alias("_before"))
    status = (
        F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone")
        .when(F.col("_now") == F.col("_before"), "same").otherwise("changed"))
    return now.join(before, "page_id", "full_outer").select("page_id", status.alias("status"))


def refresh_index(pages: DataFrame, path: str, config: IndexConfig = IndexConfig(), page_bits: int = PAGE_BITS) -> DataFrame:
    """Bring the store to what `pages` (page_id, url, html; one row a page) hold, and return `page_changes`.

    Pages that are the same are neither parsed nor moved, folders without a change are not written. A run that was broken off
    is made good by the next one: the table of pages is written last, so the same pages count as changed again.
    """
    spark = pages.sparkSession
    changes = materialize(page_changes(pages, stored_pages(spark, path)))
    wanted = changes.where("status IN ('new', 'changed')").select("page_id")
    _apply(pages.join(wanted, "page_id", "left_semi"), changes.where("status = 'gone'").select("page_id"), path, config, page_bits)
    return changes


def upsert_pages(pages: DataFrame, path: str, config: IndexConfig = IndexConfig(), page_bits: int = PAGE_BITS) -> None:
    """Add or replace the given pages and leave all others. Doing it again changes nothing."""
    spark = pages.sparkSession
    pages = materialize(pages.select("page_id", "url", "html"))
    _apply(pages, spark.createDataFrame([], "page_id long"), path, config, page_bits)


def _apply(pages: DataFrame, gone: DataFrame, path: str, config: IndexConfig, page_bits: int) -> None:
    spark, bits = pages.sparkSession, CHUNK_BITS + page_bits
    replaced = materialize(
        pages.select("page_id", "url", page_digest().alias("digest")).unionByName(gone, allowMissingColumns=True)
        .withColumn(RANGE, F.shiftright("page_id", page_bits)))
    folders = [r[0] for r in replaced.select(RANGE).distinct().limit(MAX_FOLDERS + 1).collect()]
    if not folders:
        return

    def kept(stored: DataFrame, page: str) -> DataFrame:
        """Rows of touched folders whose pages stay."""
        if len(folders) <= MAX_FOLDERS:
            touched = stored.where(F.col(RANGE).isin(folders))
        else:
            touched = stored.join(replaced.select(RANGE).distinct(), RANGE, "left_semi")
        numbered = touched.withColumn("_page", F.expr(page))
        return numbered.join(replaced.select(F.col("page_id").alias("_page")), "_page", "left_anti").drop("_page")

    built = build_index(pages.select("page_id", "url", "html"), config)
    old_pages = stored_pages(spark, path)
    rows = built
    if _exists(spark, f"{path}/chunks"):
        rows = built.unionByName(kept(stored_index(spark, path, *INDEX.names), f"shiftright(id, {CHUNK_BITS})").select(*INDEX.names))
    rows = materialize(rows)  # before the folders that it comes from are replaced
    write_ranges(rows, f"{path}/chunks", bits)
    _drop_empty(rows.select(F.shiftright("id", bits).alias(RANGE)), replaced, f"{path}/chunks")
    listed = materialize(
        kept(old_pages, "page_id").unionByName(replaced.where("digest IS NOT NULL")).select("page_id", "url", "digest", RANGE))
    listed.repartitionByRange(RANGE, "page_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(f"{path}/pages")
    _drop_empty(listed.select(RANGE), replaced, f"{path}/pages")


def _drop_empty(left: DataFrame, replaced: DataFrame, path: str) -> None:
    """Remove the folders of touched ranges that no row is left in; writing alone would keep their old rows."""
    spark = left.sparkSession
    empty = replaced.select(RANGE).distinct().join(left.distinct(), RANGE, "left_anti")
    for row in empty.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RANGE}={row[0]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table lies at the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(folder) and any(s.isDirectory() for s in system.listStatus(folder))
