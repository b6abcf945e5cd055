"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.common import stored

#: A larger rate is drawn as a sum of so many Poisson numbers of equal rate (exact), so that tables of thresholds stay short.
PART_RATE = 64.0
#: Most sources whose rates are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None,
                 temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: its size in characters, target weight and mean repetition `rate`.

    The rate is weight * epochs * total size / own size. Without given weights a source weighs size ** temperature;
    a source that given weights don't name weighs 0. Weights are scaled to a sum of 1. A source without text has rate 0.
    """
    sizes = docs.groupBy(F.col(source).alias("site")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("size"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.coalesce(*[F.when(F.col("site") == F.lit(k), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sizes = stored(sizes.withColumn("raw", F.when(F.col("size") > 0, raw).otherwise(0.0)), "source-sizes")
    raws, total = sizes.agg(F.sum("raw"), F.sum("size")).first()
    share = F.col("raw") / F.lit(float(raws or 0)) if raws else F.lit(0.0)
    rate = F.when(F.col("size") > 0, share * F.lit(float(epochs)) * F.lit(float(total or 0)) / F.col("size")).otherwise(0.0)
    return sizes.select("site", "size", share.alias("weight"), rate.alias("rate"))


def _thresholds(rates: DataFrame) -> DataFrame:
    """Per source: how many parts its rate has, and the distribution of one part as thresholds below 2^32."""
    parts = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("long"))
    mean = F.col("rate") / F.col("parts")
    steps = parts.withColumn("mean", mean).where("rate > 0").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int"))))
    by = Window.partitionBy("site").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_factorial = F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(by)
    mass = steps.withColumn("mass", F.exp(F.col("k") * F.log("mean") - F.col("mean") - log_factorial))
    cut = F.least(F.floor(F.sum("mass").over(by) * 4294967296.0), F.lit(4294967296)).cast("long")
    tables = mass.withColumn("cut", cut).groupBy("site").agg(
        F.first("parts").alias("parts"), F.array_sort(F.collect_list("cut")).alias("cuts"))
    return tables


def _number(digits: int, seed: int, *parts: Column) -> Column:
    """A number of so many hexadecimal digits from a hash, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
                seed: int = 17) -> DataFrame:
    """Repeat each document a Poisson number of times with its source's rate as mean, and shuffle all copies globally.

    Returns the given columns, `copy` (from 1 within a document) and `position_key`: rows are dealt to partitions by it
    and sorted by it within each, an order that is the same in every run. The number of copies is the inverse of the
    Poisson distribution at a number hashed from seed and key, so it depends on nothing else. Repeated rows are drawn alike.
    NULL keys count as one key; a NULL source is a source of its own; sources without any text have rate 0 (see `source_rates`).
    Other columns may have any names but `copy` and `position_key`, which are replaced.

    No step gathers the rows of a source: the rates are sums, and documents meet the small table of rates by a broadcast
    below `BROADCAST_SOURCES`, else by a join whose hot sources adaptive execution splits.
    """
    names = [c for c in docs.columns if c not in ("copy", "position_key")]
    rates = stored(_thresholds(source_rates(docs, source, text, weights, temperature, epochs)), "source-rates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    few = rates.count() <= BROADCAST_SOURCES
    parts = F.transform(F.sequence(F.lit(1), F.col("parts").cast("int")), lambda part: F.struct(
        part.alias("part"), _number(8, seed, F.col("row")[key], part).alias("at")))

    def copies(one: Column) -> Column:
        drawn = F.filter(F.sequence(F.lit(1), F.size("cuts")), lambda i: F.element_at("cuts", i) <= one["at"])
        return F.transform(drawn, lambda i: ((one["part"] - 1) * 1024 + i).cast("long"))

    drawn = (
        rows.join(F.broadcast(rates) if few else rates, F.col("row")[source].eqNullSafe(F.col("site")))
        .select("row", F.explode(F.flatten(F.transform(parts, copies))).alias("copy"))
    )
    dealt = drawn.withColumn("position_key", _number(15, seed + 1, F.col("row")[key], F.col("copy")))
    return (
        dealt.repartition("position_key").sortWithinPartitions("position_key", F.col("row")[key], "copy")
        .select(*[F.col("row")[c].alias(c) for c in names], "copy", "position_key")
    )
