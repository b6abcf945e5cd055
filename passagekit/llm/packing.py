"""Best-fit packing of documents into sequences, bettered by exchanges between underfull ones."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import spread_tasks, stored
from passagekit.llm.units import batches, encode, together

#: Pieces that are packed together, numbers only. Groups leave about one underfull sequence each.
GROUP_PIECES = 32_768
#: The local search begins with so many of the least filled bins, which hold nearly all free places, and goes on with `WIDER` times as many,
#: up to all bins that are not full, while fewer bins might do.
SEARCH_BINS, WIDER = 200, 4


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in descending order of size: lists of positions in `sizes`."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if a bin has r places left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = open_[left].pop()
            if not open_[left]:
                free &= ~(1 << left)
            bins[at].append(i)
        else:
            at, left = len(bins), capacity
            bins.append([i])
        left -= size
        open_[left].append(at)
        free |= 1 << left
    return bins


class _Exchange:
    """The pieces of underfull bins, and exchanges that raise the sum of squared fills."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self.offers = [self._offer(b) for b in range(len(bins))]
        self.stuck = np.zeros(len(bins), bool)
        self._pool()

    def _offer(self, b: int) -> tuple:
        """What a bin can give in turn: nothing, a piece, a pair; each with the sizes."""
        kinds = [()], [(i,) for i in self.bins[b]], list(combinations(self.bins[b], 2))
        return tuple((np.array([sum(self.sizes[i] for i in x) for x in kind], np.int64), kind) for kind in kinds)

    def _pool(self) -> None:
        """The offers of all underfull bins."""
        some = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        self.pool = []
        for kind in range(3):
            parts = [self.offers[b][kind][0] for b in some]
            counts = np.array([len(x) for x in parts], np.int64)
            self.pool.append((np.concatenate(parts) if parts else np.empty(0, np.int64), np.repeat(some, counts),
                              np.repeat(np.cumsum(counts) - counts, counts)))

    def _best(self, giver: int, given: int, kind: int) -> tuple[int, tuple] | None:
        """What to take in turn for pieces of size `given`: the exchange that fills another bin most."""
        size, home, start = self.pool[kind]
        gain = given - size
        filled = self.fill[home] + gain
        good = np.flatnonzero((gain > 0) & (filled <= self.capacity) & (filled > self.fill[giver]) & (home != giver))
        if not len(good):
            return None
        at = good[np.argmax(filled[good])]
        return int(home[at]), self.offers[home[at]][kind][1][at - start[at]]

    def _swap(self, giver: int, given: tuple, taker: int, taken: tuple) -> None:
        size = sum(self.sizes[i] for i in given) - sum(self.sizes[i] for i in taken)
        self.bins[giver] = [i for i in self.bins[giver] if i not in given] + list(taken)
        self.bins[taker] = [i for i in self.bins[taker] if i not in taken] + list(given)
        self.fill[giver] -= size
        self.fill[taker] += size
        for b in (giver, taker):
            self.offers[b] = self._offer(b)
        self._pool()
        self.stuck[[giver, taker]] = False
        self._wake(giver)
        self._wake(taker)

    def _wake(self, taker: int) -> None:
        """Bins that were stuck are no more if they have an exchange with this one, which has changed; with others they have none."""
        room = self.capacity - self.fill[taker]
        if not 0 < room < self.capacity:
            return
        for kind, kinds in ((1, (0, 1, 2)), (2, (1,))):
            size, home, _ = self.pool[kind]
            taken = np.sort(np.concatenate([self.offers[taker][x][0] for x in kinds]))
            least = np.maximum(0, self.fill[home] - self.fill[taker])  # what a giver must give more than it takes
            can = np.searchsorted(taken, size - room) < np.searchsorted(taken, size - least)
            self.stuck[home[can & (home != taker)]] = False

    def better(self, giver: int) -> bool:
        """One move, one-for-one, one-for-two or two-for-one exchange out of a bin, if any raises the sum of squares."""
        own = sorted(self.bins[giver], key=lambda i: (-self.sizes[i], i))
        for given, kinds in [((i,), (0, 1, 2)) for i in own] + [(p, (1,)) for p in combinations(own, 2)]:
            size = sum(self.sizes[i] for i in given)
            for kind in kinds:
                found = self._best(giver, size, kind)
                if found:
                    self._swap(giver, given, *found)
                    return True
        self.stuck[giver] = True
        return False

    def empty(self, spare: int) -> None:
        """Exchanges out of the least filled bin that is not stuck, until `spare` bins are empty or all are stuck."""
        while int((self.fill == 0).sum()) < spare:
            givers = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~self.stuck)
            if not len(givers):
                break
            self.better(int(givers[np.argmin(self.fill[givers])]))


def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing is below (the bound of Martello and Toth).

    For every k, pieces over capacity - k share a bin with no piece of k or more, those over half of a bin need one each, and
    the places these leave must take the rest from k on.
    """
    count = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)
    many, total = np.append(np.cumsum(count[::-1])[::-1], 0), np.append(np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1], 0)
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    alone = many[np.maximum(capacity - k + 1, half)]
    large, large_total = many[half] - alone, total[half] - total[np.maximum(capacity - k + 1, half)]
    rest = total[k] - total[half] - (large * capacity - large_total)
    return int((alone + large + np.maximum(-(-rest // capacity), 0)).max()) if len(sizes) else 0


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Few bins of at most `capacity`: best fit, then a local search among the least filled bins while fewer might do.

    The search empties the least filled bin by moves and exchanges, each of which raises the sum of squared fills, so it
    ends; if that bin is stuck, the next one gives. It ends at a local optimum of all bins that are not full, or as soon as no packing can be
    smaller, which is before it begins where best fit reaches the bound.
    """
    bins, least, width = best_fit(sizes, capacity), least_bins(sizes, capacity), SEARCH_BINS
    while len(bins) > least:
        fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        order = np.argsort(fill, kind="stable")
        order = order[fill[order] < capacity]
        loose = order[:width].tolist()
        # emptying a bin takes as many free places as it has filled ones
        if capacity * len(loose) - int(fill[loose].sum()) >= capacity:
            state = _Exchange([bins[b] for b in loose], sizes, capacity)
            state.empty(len(bins) - least)
            rest = set(loose)
            bins = [x for b, x in enumerate(bins) if b not in rest] + [b for b in state.bins if b]
        if width >= len(order):
            break
        width *= WIDER
    return bins


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """Tokenise documents and cut longer ones: doc_id, piece, start, length, ids_crc32. No shuffle."""
    end = end_id.to_bytes(4, "little")

    def run(iterator):
        for batch in together(batches(iterator, table=("ids", tokenizer))):
            rows: list[tuple] = []
            for one, ids in zip(batch.column(0).to_pylist(), encode(tokenizer, batch.column(1))):
                data = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append((one, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id",
                   text: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack the ids of all documents, `end_id` after each, into sequences of at most `capacity` ids.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer than a
    sequence are cut, others are whole. A NULL text counts as empty (its end id is packed); keys may be NULL or repeat:
    each row is packed. Other columns are not looked at. An empty table gives no rows.

    Only numbers are shuffled. Pieces as long as a sequence are sequences of their own; the others are dealt evenly, by
    their place in the written table, to groups of about `group_pieces`, each packed by one task.
    """
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, key, text), "pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(keys, rows):
        rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = rows["length"].to_pylist()
        home, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, members in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in members:
                home[i], place[i] = n, at
                at += sizes[i]
        base = keys[0].as_py() << 32
        return rows.select(names[:5]).append_column("sequence_id", pa.array(home + base)).append_column("offset", pa.array(place))

    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = dealt.repartition(spread_tasks(pieces), "bucket").groupBy("bucket").applyInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.select(*names).unionByName(packed)
