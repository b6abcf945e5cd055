"""Similarity join of texts by the Jaccard index of their word n-grams, by T-occurrence search over inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import components, stored
from passagekit.llm.units import batches

#: Texts that are searched together at most; larger candidate groups are searched block against block.
BLOCK = 512
#: Most keys that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: What DivideSkip weighs a binary probe with, against a step of the merge.
PROBE = 0.0085
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of a text's word n-grams as sorted 64-bit hashes; with fewer words the whole sequence is one, without any none."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i:len(h) - size + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    out ^= out >> np.uint64(27)
    return np.unique(out.view(np.int64))


def least_overlap(n, share: int):
    """Shingles that a set of n shares with any set it links with, at least."""
    return (share * n + 99) // 100


def missing(n, share: int):
    """Shingles that a set of n may have for itself."""
    return n - least_overlap(n, share)


def common_keys(n, share: int):
    """Keys that two sets are asked to share among their first ones."""
    return 3 * missing(n, share) // 2 + 1


class Lists:
    """The inverted lists of some sets, all in one sorted array of (shingle, set)."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        _, self.shingle = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.ends = np.cumsum([0, *[len(s) for s in sets]])
        self.flat = np.sort(self.shingle.astype(np.int64) * self.count + owner)
        self.starts = np.searchsorted(self.flat, np.arange(self.shingle.max(initial=-1) + 2, dtype=np.int64) * self.count)

    def of(self, x: int) -> np.ndarray:
        """The lists that a set is in."""
        return self.shingle[self.ends[x]:self.ends[x + 1]]

    def merged(self, lists: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets before `below` in any of the lists, and in how many; the sorted lists are merged in one sort."""
        parts = [self.flat[self.starts[i]:self.starts[i + 1]] - i * self.count for i in lists.tolist()]
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return np.unique(found[found < below], return_counts=True)

    def probed(self, lists: np.ndarray, y: int) -> int:
        """In how many of the lists a set is, by binary search in each."""
        wanted = lists.astype(np.int64) * self.count + y
        at = np.searchsorted(self.flat, wanted)
        return int((self.flat[np.minimum(at, len(self.flat) - 1)] == wanted).sum())


def search(sets: list[np.ndarray], share: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets that join components: every two linked sets are in one component of the result.

    Sets are searched in order of size, each among those before it. Of its inverted lists the long ones are set aside
    (DivideSkip); the short ones are merged, and what they hold often enough is probed for in the long ones. Pairs that
    links found before join already are not probed. With `sides` only pairs of different sides are searched.
    """
    lists, sizes, links = Lists(sets), [len(s) for s in sets], []
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], i))
    if order != list(range(len(sets))):
        found = search([sets[i] for i in order], share, [sides[i] for i in order] if sides else None)
        return [(order[a], order[b]) for a, b in found]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lengths = np.diff(lists.starts)
    for x in range(len(sets)):
        own = lists.of(x)
        own = own[lengths[own] > 1]
        least = least_overlap(sizes[x], share)
        if not sizes[x] or len(own) < least:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        aside = min(least - 1, int(least / (PROBE * math.log2(max(2, lengths[own[-1]])) + 1)))
        short, long_ = own[:len(own) - aside], own[len(own) - aside:]
        near, counts = lists.merged(short, x)
        good = counts >= least - aside
        for y, n in sorted(zip(near[good].tolist(), counts[good].tolist()), key=lambda p: -p[1]):
            if sizes[y] * 100 < share * sizes[x] or (sides and sides[x] == sides[y]) or find(x) == find(y):
                continue
            both = n + lists.probed(long_, y)
            if 100 * both >= share * (sizes[x] + sizes[y] - both):
                root[find(x)] = find(y)
                links.append((y, x))
    return links


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of wanted (rep, digest, ...), each once or as often as its row is repeated."""
    few = wanted.count() <= BROADCAST_KEYS
    source = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text"))
    source = source.where(F.col("rep").isNotNull()).withColumn("digest", _digest(F.col("text")))
    return source.join(F.broadcast(wanted) if few else wanted, ["rep", "digest"])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _first_keys(texts: DataFrame, n: int, share: int) -> DataFrame:
    """rep, digest, n and the keys of each text: its smallest hashes, as many as the join asks for."""
    def run(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4 << 20):
            sizes, keys = [], []
            for one in batch.column(2).to_pylist():
                s = shingles(one, n)
                sizes.append(len(s))
                keys.append(s[:missing(len(s), share) + common_keys(len(s), share)])
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(values))],
                names=["rep", "digest", "n", "keys"])

    return texts.select("rep", "digest", "text").mapInArrow(run, "rep long, digest binary, n long, keys array<long>")


def _candidates(firsts: DataFrame, share: int) -> DataFrame:
    """(rep, key): of each text the rarest shared keys that are enough to meet every text it links with.

    Two linked sets share `common_keys` of the smaller one among their first keys (those that each may have for itself, and so
    many more). A text with fewer shared keys than that has no link, and of the others' keys the most frequent ones, one
    fewer than that, are left out on both sides: one shared key remains. Keys are counted before they are joined, so a
    frequent key is no group.
    """
    keyed = firsts.where("n > 0").select("rep", "n", F.explode("keys").alias("key"))
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "keys")
    met = keyed.join(counts, "key").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "key"))).alias("own"))
    partner = F.floor((F.col("n") * share + 99) / 100)  # the smallest set it can link with
    least = (F.floor(1.5 * (partner - F.floor((partner * share + 99) / 100))) + 1).cast("int")
    return (
        met.withColumn("least", least).where(F.size("own") >= F.col("least"))
        .select("rep", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)).alias("k"))
        .select("rep", F.col("k.key").alias("key"))
    )


def _groups(candidates: DataFrame) -> DataFrame:
    """(rep, cluster): texts that meet in keys, directly or through others."""
    pairs = stored(candidates, "candidates")
    heads = stored(pairs.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("m")).where("m > 1"), "heads")
    edges = pairs.join(heads, "key").where("rep <> head").select("rep", "head")
    found = components(edges, "rep", "head")
    return stored(found.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")


def _links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, key: str, text: str, n: int, share: int, block: int) -> DataFrame:
    """(a, b): links that join all linked texts of each cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    placed = stored(clusters.join(sizes, "cluster").join(reps, "rep").withColumn(
        "blocks", F.ceil(F.col("m") / block).cast("int")), "placed")
    bins = max(1, math.ceil(placed.count() / block) * 2)
    texts = _texts_of(docs, placed.select("rep", "digest", "cluster", "blocks"), key, text)

    def run(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4 << 20):
            sets = [shingles(t, n).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["rep", "cluster", "blocks", "shingles"])

    sets = texts.select("rep", "cluster", "blocks", "text").mapInArrow(run, "rep long, cluster long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    small = sets.where("blocks = 1").select(
        F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("home"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "rep", F.lit(0).alias("side"), "shingles")
    large = (
        sets.where("blocks > 1").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("cluster").alias("home"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "rep", "side", "shingles")
    )

    def solve(keys, rows):
        across = keys[1].as_py() != keys[2].as_py()
        rows = rows.sort_by("rep")
        reps_, found = rows["rep"].to_pylist(), [np.frombuffer(x, np.int64) for x in rows["shingles"].to_pylist()]
        pairs = search(found, share, rows["side"].to_pylist() if across else None)
        return pa.table({"a": pa.array([reps_[a] for a, _ in pairs], pa.int64()), "b": pa.array([reps_[b] for _, b in pairs], pa.int64())})

    return small.unionByName(large).groupBy("home", "i", "j").applyInArrow(solve, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, share: int = 85,
                       block: int = BLOCK) -> DataFrame:
    """Link texts whose sets of word n-grams have a Jaccard index of at least `share` percent: n_shingles and component_id.

    One row per row given: key, n_shingles (size of its set), component_id (smallest key that links reach, itself included).
    A-Z are lower-cased, words are cut at ASCII white space. NULL and empty texts have empty sets and link with nothing. Rows with
    a NULL key take no part in links and have a NULL component; keys are integers. Repeated rows are linked with each other. Other
    columns are not looked at.

    Equal texts are found by digest and one of each is searched. From its smallest hashes those are kept that two texts must
    share (see `_candidates`); texts that meet in them, directly or through others, form clusters. Small clusters
    are packed into bins and searched by DivideSkip (see `search`); a cluster of more than `block` different texts is
    searched block against block, so no task holds more than two blocks. All links between different texts are within a
    cluster; pairs that other links join already are left out, as components need no more.
    """
    names = docs.select(F.col(f"`{key}`").cast("long").alias("key"), _digest(F.col(f"`{text}`")).alias("digest"))
    names = stored(names, "digests")
    reps = stored(names.where("key is not null").groupBy("digest").agg(F.min("key").alias("rep")), "reps")
    texts = _texts_of(docs, reps, key, text)
    firsts = stored(_first_keys(texts, n, share), "first-keys")
    clusters = _groups(_candidates(firsts, share))
    links = _links(docs, reps, clusters, key, text, n, share, block)
    found = components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    nameless = docs.where(F.col(f"`{key}`").isNull()).select(
        F.lit(None).cast("long").alias("rep"), _digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    sizes = firsts.select("digest", "n").unionByName(_first_keys(nameless, n, share).select("digest", "n"))
    sizes = sizes.groupBy("digest").agg(F.max("n").alias("n"))
    known = stored(sizes.join(reps, "digest", "left").join(found, "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component")), "known")
    out = names.join(known, "digest", "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.coalesce("n", F.lit(0)) > 0, F.when(F.col("key").isNotNull(), F.col("component"))).otherwise(F.col("key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows given without all but one of each group of linked texts: the row of the smallest key stays.

    Rows of a repeated key are one document; rows with a NULL key all stay. Texts are not shuffled while the keys that go are
    few enough to broadcast.
    """
    found = jaccard_components(docs, key, text, **options)
    gone = stored(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct(), "gone")
    often = stored(docs.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("often")).count().where("count > 1").select("often"), "often")

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids

    left = docs.join(few(gone), F.col(f"`{key}`") == F.col("gone"), "left_anti")
    same = F.col(f"`{key}`") == F.col("often")
    return left.join(few(often), same, "left_anti").unionByName(left.join(few(often), same, "left_semi").dropDuplicates([key]))
