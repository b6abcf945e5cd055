"""Token ids in files of fixed-width numbers: each id takes the fewest bits the vocabulary needs.

A file holds a 16-byte head (magic, bits, ids per block), the blocks, each packed from the highest bit on and starting at a byte,
the table (byte offset of each block; of each document its key, whether it is NULL, and where its ids end), and a foot
(numbers of ids, documents and blocks, where the table starts, magic). Any range of ids is read from its bytes alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import stored
from passagekit.llm.units import batches, encode, together

MAGIC = b"PKIDS\0\0\1"
_FOOT = struct.Struct("<QQQQ8s")
#: Ids per block, and ids that a reader holds at once.
BLOCK, AT_ONCE = 1 << 16, 1 << 20


def width(vocabulary: int) -> int:
    """Bits of an id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another in `bits` bits each, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    whole = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(whole[:, 32 - bits:].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """`count` ids from the `first` on of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, first * bits // 8).astype("<u4")
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    padded = np.frombuffer(data + bytes(5), np.uint8)
    start = at >> 3
    window = np.zeros(count, np.uint64)
    for i in range(5):
        window = (window << np.uint64(8)) | padded[start + i].astype(np.uint64)
    shift = (40 - bits - (at & 7)).astype(np.uint64)
    return ((window >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


def _place(path: str):
    """The file system and the path in it, for a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class IdFileWriter:
    """Writes documents one after another; holds one block of ids and the table of documents."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        system, name = _place(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.bits, self.block = system.open_output_stream(name), bits, block
        self.out.write(MAGIC + struct.pack("<II", bits, block))
        self.at, self.ids, self.held, self.waiting = 16, 0, 0, []
        self.offsets, self.keys, self.ends = [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.keys.append(key)
        self.ends.append(self.ids)
        if self.held >= self.block:
            self._blocks(False)

    def _blocks(self, all_: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if all_ else len(ids) - len(ids) % self.block
        for at in range(0, end, self.block):
            data = pack(ids[at:min(end, at + self.block)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._blocks(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.out.write(np.array([k is None for k in self.keys], "u1").tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(_FOOT.pack(self.ids, len(self.keys), len(self.offsets), self.at, MAGIC))
        self.out.close()


class IdFile:
    """An id file opened for reading."""

    def __init__(self, path: str):
        system, name = _place(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        magic, self.bits, self.block = struct.unpack("<8sII", self.file.read_at(16, 0))
        self.ids, docs, blocks, at, end = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"no id file: {path}")
        table = self.file.read_at(size - _FOOT.size - at, at)
        self.offsets = np.frombuffer(table, "<u8", blocks)
        self.keys = np.frombuffer(table, "<i8", docs, 8 * blocks)
        self.unknown = np.frombuffer(table, "u1", docs, 8 * (blocks + docs)).astype(bool)
        self.ends = np.frombuffer(table, "<u8", docs, 8 * (blocks + docs) + docs).astype(np.int64)

    def read(self, first: int, end: int) -> np.ndarray:
        """The ids from `first` to `end` (not included), reading only the bytes that hold them."""
        parts = []
        while first < end:
            block, at = divmod(first, self.block)
            n = min(end - first, self.block - at)
            low, high = at * self.bits // 8, -(-(at + n) * self.bits // 8)
            data = self.file.read_at(high - low, int(self.offsets[block]) + low)
            shift = at * self.bits - low * 8
            if shift:  # starts inside a byte
                low_id = at - at % 8
                low = low_id * self.bits // 8
                data = self.file.read_at(high - low, int(self.offsets[block]) + low)
                parts.append(unpack(data, self.bits, at - low_id, n))
            else:
                parts.append(unpack(data, self.bits, 0, n))
            first += n
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, end_id: int = 2, key: str = "doc_id",
                      text: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode whole texts, append `end_id` to each, and write the ids to files in ascending order of keys.

    Returns the list of files: part (their order), path, n_docs, n_ids and base, the number of ids in the files before. A NULL
    text counts as empty; NULL keys come first; documents of equal keys follow each other in an order fixed by their texts. Keys
    are integers. Other columns are not looked at. An empty table gives no file.

    One shuffle by ranges of (key, hash of the text), so neither long runs of one key nor order in the input matter. A task
    writes one file, under a new name at each attempt; only names that finished attempts return are in the list.
    """
    bits = width(max(vocabulary, end_id + 1))
    ordered = (
        docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("tie"))
        .repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(iterator):
        out, path = None, ""
        for batch in together(batches(iterator, table=("ids", tokenizer))):
            if batch.num_rows and out is None:
                part = TaskContext.get().partitionId()
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                out = IdFileWriter(path, bits, block)
            for one, ids in zip(batch.column(0).to_pylist(), encode(tokenizer, batch.column(1))):
                out.add(one, np.frombuffer(ids + end, "<u4"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([path]), pa.array([len(out.keys)], pa.int64()), pa.array([out.ids], pa.int64())],
                names=["part", "path", "n_docs", "n_ids"])

    files = stored(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "id-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    def run(iterator):
        for batch in iterator:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = IdFile(path)
                starts = np.concatenate([[0], source.ends[:-1]]).astype(np.int64)
                sums, at = np.zeros(len(starts), np.int64), 0
                while at < len(starts):
                    last = max(at + 1, int(np.searchsorted(source.ends, starts[at] + AT_ONCE, "right")))
                    low, high = int(starts[at]), int(source.ends[last - 1])
                    if last == at + 1:  # one document, as long as it may be
                        for p in range(low, high, AT_ONCE):
                            sums[at] = zlib.crc32(source.read(p, min(high, p + AT_ONCE)).tobytes(), int(sums[at]))
                    else:
                        data = memoryview(source.read(low, high).tobytes())
                        for i in range(at, last):
                            sums[i] = zlib.crc32(data[4 * (int(starts[i]) - low):4 * (int(source.ends[i]) - low)])
                    at = last
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source.keys, mask=source.unknown), pa.array(starts + base), pa.array(source.ends - starts), pa.array(sums)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return (files.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, end_id: int = 2, **columns: str) -> DataFrame:
    """Write token files and return what they hold."""
    return read_documents(write_token_files(docs, tokenizer, folder, vocabulary, end_id, **columns))


def session_folder(spark: SparkSession) -> str:
    from passagekit.session import new_path

    return new_path(spark, "token-files")
