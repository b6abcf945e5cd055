"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.session import new_path

#: Most rows (parts of a sorted table times the keys that begin in them) that `ranked` broadcasts; more are joined by a shuffle.
BROADCAST_PARTS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read to the shared folder, and go on from the written copy.

    The copy cuts the lineage; it does not depend on any executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_tasks(df: DataFrame) -> int:
    """Tasks that a grouped step can use: at least those of a shuffle, and of the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components: one row (node, component) per node of an edge, component its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014). A step takes a minimum for each node, which is
    combined before the shuffle and written, and joins it back, which adaptive execution can split at hot nodes; no
    neighbour list is gathered. Every step is written to the shared folder, so a lost executor costs no earlier step.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        star = large.join(low, "a")
        pairs = stored(
            star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`df` with each row's `rank` (from 0) among the rows of its keys, and a table of the keys with their `total`.

    NULLs come first and are a key like others. The rows are dealt by ranges of keys and order, written sorted, and numbered by
    what the parts before hold of the key: no task needs all rows of one key, and no window runs over rows.
    """
    sorts = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    numbered = stored(
        df.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = numbered.groupBy(*keys, F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("_base", F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{name}-parts")
    totals = parts.groupBy(*keys).agg(F.sum("_n").alias("total"))
    few = parts.count() <= BROADCAST_PARTS
    bases = parts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_in"), "_base")
    same = F.shiftright("_at", 33) == F.col("_in")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_{i}"))
    joined = numbered.join(F.broadcast(bases) if few else bases, same)
    return joined.select(*df.columns, (F.col("_at") - F.col("_base")).alias("rank")), totals
