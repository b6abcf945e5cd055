"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import stored

#: Most lines that are broadcast with their hosts (16 bytes each and the host once); more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A line up to white space around it; blank lines have no key and are never dropped."""
    bare = F.trim(line)
    return F.when(bare != "", F.unhex(F.md5(bare)))


def _holds(keys: Column, key: Column) -> Column:
    """Whether a sorted array holds a key, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(keys) + F.lit(1))).cast("int"))
    half = lambda s: F.shiftright(s["low"] + s["high"], 1)
    ends = F.aggregate(
        steps, F.struct(F.lit(0).alias("low"), F.size(keys).alias("high")),
        lambda s, _: F.when(s["low"] >= s["high"], s)
        .when(F.get(keys, half(s)) < key, F.struct((half(s) + 1).alias("low"), s["high"].alias("high")))
        .otherwise(F.struct(s["low"].alias("low"), half(s).alias("high"))))
    return F.get(keys, ends["low"]) == key


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1,
                    min_pages: int = 3, copies_vote: bool = True) -> DataFrame:
    """Drop the lines that more than `ratio` of a host's pages, and at least `min_pages` of them, contain.

    Returns the rows and columns given, `text` without those lines, and two columns: n_lines and n_dropped (of the text
    given). A page counts once for a line it repeats; pages without text count for their host. Lines are compared without
    the blanks around them. A NULL text stays NULL with no lines, an empty one stays empty; a NULL host is a host of its
    own; repeated rows are pages of their own. Without `copies_vote` pages of a host with equal texts count as one page (those without
    text too), so that a text does not lose its lines because it was copied. Other columns may have any names but `n_lines` and `n_dropped`, which are replaced.

    Line counts and page totals are combined before they are shuffled, and only digests travel. At most
    (lines per page) / ratio lines of a host can pass, so they fit in one row per host, sorted: a line of a page is looked up by halving. Pages meet that row by a broadcast
    below `BROADCAST_LINES`, else by a join whose hot hosts adaptive execution splits.
    """
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    site = rows.select(F.col("row")[host].cast("string").alias("host"), F.col("row")[text].alias("text"))
    digest = [] if copies_vote else [F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")]
    votes = site.select("host", *digest)
    totals = (votes if copies_vote else votes.distinct()).groupBy("host").agg(F.count("*").alias("pages"))
    keys = site.select("host", *digest, F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("key")).where("key is not null")
    keys = keys if copies_vote else keys.distinct()
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = (
        counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy("c.host").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    )
    often = stored(often.select(F.col("host").alias("site"), "keys"), "site-lines")
    n = often.agg(F.sum(F.size("keys"))).first()[0] or 0
    joined = rows.join(F.broadcast(often) if n <= BROADCAST_LINES else often,
                       F.col("row")[host].cast("string").eqNullSafe(F.col("site")), "left")
    lines = _lines(F.col("row")[text])
    both = F.transform(lines, lambda line: F.struct(line.alias("line"), _key(line).alias("key")))
    kept = F.when(F.col("keys").isNull(), lines).otherwise(
        F.filter(both, lambda one: ~F.coalesce(_holds(F.col("keys"), one["key"]), F.lit(False)))["line"])
    out = joined.select("row", kept.alias("kept"))
    return out.select(
        *[(F.array_join("kept", "\n") if c == text else F.col("row")[c]).alias(c) for c in names],
        F.greatest(F.coalesce(F.size(_lines(F.col("row")[text])), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size(_lines(F.col("row")[text])) - F.size("kept"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
    )
