"""Split texts into overlapping chunks at the coarsest separator that fits."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.schemas import CHUNK_OVERLAP, CHUNK_SIZE

# Separators from coarse to fine; the empty one splits between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Piece boundaries of text[start:end]; every piece but the first begins with the separator."""
    if separator == "":
        return list(range(start, end + 1))
    cuts, at = [start], text.find(separator, start, end)
    while at >= 0:
        if at > start:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return cuts


def _pack(text: str, cuts: list[int], size: int, overlap: int, chunks: list[str]) -> None:
    """Fill chunks from consecutive pieces. A chunk is a slice, so only boundaries are compared.

    A chunk ends at the last boundary within `size`. The next one starts at the first boundary
    that leaves at most `overlap` characters and room for the next piece.
    """
    first, last = 0, len(cuts) - 1
    while True:
        end = bisect_right(cuts, cuts[first] + size, first + 1) - 1
        end = max(end, first + 1)
        piece = text[cuts[first]:cuts[end]].strip()
        if piece:
            chunks.append(piece)
        if end >= last:
            return
        floor = max(cuts[end] - overlap, cuts[end + 1] - size)
        first = bisect_left(cuts, floor, first, end)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of one text; each is stripped, not empty and at most `size` long where separators allow it."""
    chunks: list[str] = []
    _split(text, 0, len(text), size, overlap, separators, chunks)
    return chunks


def _split(text, start, end, size, overlap, separators, chunks):
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, end) >= 0), len(separators) - 1)
    finer = separators[at + 1:]
    cuts = _cuts(text, start, end, separators[at])
    run = 0
    for i in range(len(cuts) - 1):
        if cuts[i + 1] - cuts[i] < size:
            continue
        if i > run:
            _pack(text, cuts[run:i + 1], size, overlap, chunks)
        if finer:
            _split(text, cuts[i], cuts[i + 1], size, overlap, finer, chunks)
        else:
            chunks.append(text[cuts[i]:cuts[i + 1]])
        run = i + 1
    if run < len(cuts) - 1:
        _pack(text, cuts[run:], size, overlap, chunks)


def chunks_of(text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
              separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of chunks of a text column."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds chunk size {size}")

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array(
            [split_text(t, size, overlap, separators) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return split.asNondeterministic()(text)  # never evaluated twice by a pushed-down filter


def chunk_text(df: DataFrame, chunk_size: int = CHUNK_SIZE, chunk_overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS, text_col: str = "text") -> DataFrame:
    """One row per chunk: the other columns, chunk_pos and the chunk. Only the text visits Python."""
    others = [c for c in df.columns if c != text_col]
    chunks = chunks_of(F.col(text_col), chunk_size, chunk_overlap, separators)
    return df.select(*others, F.posexplode(chunks).alias("chunk_pos", text_col))


def chunks_of_sections(sections: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                       separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The chunks of a page's sections in one list, each with the anchor of its section."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds chunk size {size}")

    @F.arrow_udf("array<struct<anchor:string,text:string>>")
    def split(pages: pa.Array) -> pa.Array:
        found = [
            [{"anchor": s["anchor"], "text": c} for s in own.as_py() or [] if s["text"] for c in split_text(s["text"], size, overlap, separators)]
            for own in pages
        ]
        return pa.array(found, pa.list_(pa.struct([("anchor", pa.string()), ("text", pa.string())])))

    return split.asNondeterministic()(sections)


def assign_ids(chunks: DataFrame, page_col: str = "page_id", chunk_col: str = "chunk_pos", chunk_bits: int = 28) -> DataFrame:
    """Add `id`, packed from the page number and the chunk's number on its page, which runs over all its sections.

    The ids need no shuffle, never collide and stay the same in every run. No page that fits in a row has chunks enough
    to pass its share of the 63 bits; a number that does stops the job.
    """
    def part(name: str, bits: int) -> Column:
        value = F.col(name).cast("long")
        fits = (value >= 0) & (value < F.lit(1 << bits))
        return F.when(fits, value).otherwise(F.raise_error(F.lit(f"{name} is missing or needs more than {bits} bits")).cast("long"))

    return chunks.withColumn("id", F.shiftleft(part(page_col, 63 - chunk_bits), chunk_bits).bitwiseOR(part(chunk_col, chunk_bits)))
