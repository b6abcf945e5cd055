"""Quality rules: base counts of a text, and the likelihood ratio of its hashed n-grams between trusted and raw texts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.units import batches

#: Buckets that words and pairs of words are hashed to, and what is added to each count.
BUCKETS, ADDED = 1 << 16, 1.0
#: A text below this mean log ratio of its n-grams is not kept.
THRESHOLD = -0.1
#: Most trusted keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngrams(words: list[bytes]) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * _M1) ^ (h[1:] * _M2)
    pairs ^= pairs >> np.uint64(29)
    ones = (h * _M1) >> np.uint64(48)
    return np.concatenate([ones, (pairs * _M2) >> np.uint64(48)]).astype(np.int64) % BUCKETS


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n = len(words)
    repeats = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = (h[:-2] * _M1) ^ ((h[1:-1] << np.uint64(21) | h[1:-1] >> np.uint64(43)) * _M2) ^ (
            (h[2:] << np.uint64(42) | h[2:] >> np.uint64(22)) * (_M1 ^ _M2))
        order = np.argsort(windows, kind="stable")
        same = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
        if len(same):
            marked = np.zeros(n, bool)
            at = np.concatenate([order[same], order[same + 1]])
            for i in range(3):
                marked[at + i] = True
            repeats = int(marked.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """For each bucket the log of its share in trusted texts to its share in all texts.

    Counted over every text and every trusted text: in each task, then over tasks, at most `BUCKETS` rows. Without trusted
    texts all ratios are 0.
    """
    keys = trusted.select(F.col(f"`{key}`").alias("key")).where("key is not null").distinct().withColumn("trusted", F.lit(True))
    keys = F.broadcast(keys) if trusted.count() <= BROADCAST_KEYS else keys
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(keys, "key", "left")

    def run(iterator) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches(iterator):
            lists: tuple[list, list] = ([], [])
            for one, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (one or "").encode().split()
                if words:
                    lists[bool(mark)].append(ngrams(words))
            for kind in (0, 1):
                if lists[kind]:
                    found = np.bincount(np.concatenate(lists[kind]), minlength=BUCKETS)
                    sums[0] += found
                    sums[1] += found * kind
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "target"])

    rows = (
        source.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ADDED) / (target.sum() + ADDED * BUCKETS)) - np.log((raw + ADDED) / (raw.sum() + ADDED * BUCKETS))


def quality_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base rule, mean log ratio and verdict for every whole text.

    Words are runs of characters other than ASCII white space. The base rule fails below 50 words, or if over half of the
    words lie in windows of three words that the text repeats. `ratio` is the sum of the log ratios of all words and pairs of
    neighbours over their number, NULL without words; a text is kept if the base rule holds and the ratio is at least
    `threshold`. The same text always has the same verdict. `trusted` holds keys of trusted texts.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept. A NULL text has no words.
    Keys may be NULL (never trusted) or repeat; trusted keys may repeat or be missing from the texts. Other columns are not looked at.
    No text is shuffled while the trusted keys are few enough to broadcast (`BROADCAST_KEYS`); what is gathered is one number
    per bucket.
    """
    ratios = log_ratios(docs, trusted, key, text)

    def run(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            rows = []
            for one in batch.column(1).to_pylist():
                one = one or ""
                words = one.encode().split()
                counts = base_counts(one, words)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                ratio = math.fsum(ratios[ngrams(words)]) / (2 * len(words) - 1) if words else None
                rows.append((*counts, failed, ratio, not failed and ratio >= threshold))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"])

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    scored = source.mapInArrow(run, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, ratio double, kept boolean")
    return scored.withColumnRenamed("key", key)
