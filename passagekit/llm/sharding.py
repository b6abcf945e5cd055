"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import json
from bisect import bisect_left
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import ranked

SHARDS = 40
#: Points of each shard on the ring. The plan below has shards * VNODES entries, whatever the number of documents.
VNODES = 256
#: Positions are the first hexadecimal digits of md5; the ring is cut into 2 ** CELL_BITS cells to find a key's arc by a join.
DIGITS, CELL_BITS = 15, 14
_CELL = 4 * DIGITS - CELL_BITS


def _points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. A further shard adds points and moves none."""
    return sorted((int(md5(f"{shard}:{v}".encode()).hexdigest()[:DIGITS], 16), shard) for shard in range(shards) for v in range(vnodes))


def position(key: Column) -> Column:
    """Place of a key on the ring; NULL is a key."""
    text = F.concat(F.lit("key:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of constants inside the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _cells(points: list[tuple[int, int]]) -> list[dict]:
    """For each cell of the ring its virtual nodes, and the next one clockwise after the cell."""
    places = [p for p, _ in points]
    rows = []
    for cell in range(1 << CELL_BITS):
        low, high = bisect_left(places, cell << _CELL), bisect_left(places, (cell + 1) << _CELL)
        rows.append({"cell": cell, "cuts": [{"upto": places[i], "arc": i} for i in range(low, high)], "after": high % len(points)})
    return rows


def bounded_plan(owners: list[int], counts: dict[int, int], capacities: list[int]) -> dict[int, list[dict]]:
    """Where the keys of each arc go: segments of ranks with their shard and first slot.

    owners: the shard of each virtual node, clockwise; counts: keys per arc, an arc ending at the virtual node of its number.
    Keys go clockwise in steps, all arcs at once: at each step the keys of an arc that are not placed yet ask at one virtual node;
    a shard takes them, arcs in their order and ranks from below, until it is full, and the rest go on to the next node.
    """
    loads = [0] * len(capacities)
    waiting = {arc: 0 for arc in sorted(counts) if counts[arc]}
    plan: dict[int, list[dict]] = {arc: [] for arc in waiting}
    step = 0
    while waiting:
        left = {}
        for arc, done in waiting.items():
            shard = owners[(arc + step) % len(owners)]
            taken = min(capacities[shard] - loads[shard], counts[arc] - done)
            if taken > 0:
                plan[arc].append({"low": done, "high": done + taken, "shard": shard, "slot": loads[shard]})
                loads[shard] += taken
                done += taken
            if done < counts[arc]:
                left[arc] = done
        waiting, step = left, step + 1
    return plan


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES,
                    slack: float = 0.0) -> DataFrame:
    """The given columns with `shard` (from 0) and `slot` (gapless from 0 within a shard).

    A document belongs to the first virtual node clockwise of its key's hash; where that node's shard is full it goes on to the
    next one. Without slack the shards hold as many documents as each other, but for one; with slack a shard may hold (1 + slack) times its
    share, and fewer documents leave their own shard. Another number of shards moves few documents: points stay where they are.

    Documents are taken in the order of position, key, crc32 and bytes of text. Repeated rows and rows of equal or NULL
    keys start at one point and fill the shards from there, so a key may hold any share of the rows. A NULL text has no bytes.
    Given columns may have any names but `shard` and `slot`, which are replaced.

    The rows move once, dealt by ranges of positions; an arc's documents may lie in many partitions. The driver sees a count
    per arc (at most shards * vnodes numbers), never a row.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    points = _points(shards, vnodes)
    cells = _literal(spark, _cells(points), "cell:long,cuts:array<struct<upto:long,arc:int>>,after:int")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select(
        "row", position(F.col("row")[key]).alias("position"), F.col("row")[key].alias("key"), F.crc32(F.coalesce(F.col("row")[text], F.lit(""))).alias("crc"),
        F.coalesce(F.octet_length(F.col("row")[text]), F.lit(0)).alias("bytes"))
    cut = F.filter("cuts", lambda c: c["upto"] >= F.col("position"))
    on_ring = rows.join(F.broadcast(cells), F.shiftright("position", _CELL) == F.col("cell")).select(
        "row", "position", "key", "crc", "bytes", F.coalesce(F.get(cut, F.lit(0))["arc"], F.col("after")).alias("arc"))
    placed, totals = ranked(on_ring, ["arc"], ["position", "key", "crc", "bytes"], "ring")
    counts = {r["arc"]: r["total"] for r in totals.collect()}
    total = sum(counts.values())
    if slack:
        capacities = [-int(-(1 + slack) * total // shards)] * shards
    else:
        capacities = [total // shards + (shard < total % shards) for shard in range(shards)]
    plan = bounded_plan([shard for _, shard in points], counts, capacities)
    arcs = _literal(
        spark, [{"of": arc, "parts": parts} for arc, parts in plan.items()],
        "of:int,parts:array<struct<low:long,high:long,shard:int,slot:long>>")
    part = F.get(F.filter("parts", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"])), F.lit(0))
    return placed.join(F.broadcast(arcs), F.col("arc") == F.col("of")).withColumn("part", part).select(
        *[F.col("row")[c].alias(c) for c in names], F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("rank") - F.col("part.low")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files in a folder per shard, rows in the order of their slots within a file and from file to file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of documents in `SHARDS` shards whose counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    return shard_documents(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
