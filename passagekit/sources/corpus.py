"""Readers for HTML files, questions and references."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from passagekit.schemas import ANSWER, QUESTIONS, REFERENCES
from passagekit.session import ARROW_BYTES, ARROW_ROWS, _bytes, materialize, new_path
from passagekit.sources.index_store import is_complete

# Names of files (some 100 bytes each) that are broadcast with their numbers at a time.
BROADCAST_NAMES = 2_000_000
# Files in a folder that `write_html_corpus` makes.
FOLDER_FILES = 1_000
# Ends of names that no compressed file has.
PLAIN_NAMES = (".html", ".htm", ".txt")
# Files and folders below a path that the driver lists itself; more are listed, and plain ones read, by executors.
LISTED_FILES = 1_000
# What opening a file costs, as bytes read, when files are dealt out to tasks.
FILE_COST = 16 << 10
# Characters that Hadoop's URIs of files quote.
QUOTED = re.compile("[^!$&-;=@-Z_a-z~\x80-\U0010ffff]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FOUND = "name string, source string, size long, folder boolean"


def write_html_corpus(pages: DataFrame, path: str, key: str = "page_id", text: str = "html") -> int:
    """Write each page's text and a newline as a file `<key>=<its key>.txt` below `path`; returns the number of files.

    A task has folders of its own, FOLDER_FILES files in each, so neither folders nor what the driver commits follow the number of pages.
    Pages of one task that share a key are lines of one file; a task that is repeated writes the same names again.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(path)
        before, out, n = object(), None, 0
        for batch in batches:
            for one, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if one != before:
                    if out is not None:
                        out.close()
                    folder = f"{root}/{TaskContext.get().partitionId():06d}-{n // FOLDER_FILES:06d}"
                    if n % FOLDER_FILES == 0:
                        system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{key}={'__HIVE_DEFAULT_PARTITION__' if one is None else one}.txt")
                    before, n = one, n + 1
                out.write((html or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    written = pages.select(F.col(key), F.col(text)).sortWithinPartitions(key).mapInArrow(write, "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def _place(path: str):
    """The file system and the path in it, for a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path))


def _children(system, folder: str) -> Iterator[tuple[str, int, bool]]:
    """Name, size and whether it is a folder, of what a folder holds and Spark's readers would not pass over."""
    from pyarrow import fs

    def entries():
        if not isinstance(system, fs.LocalFileSystem):
            for entry in system.get_file_info(fs.FileSelector(folder)):
                yield entry.base_name, entry.size or 0, entry.type == fs.FileType.Directory
            return
        with os.scandir(folder) as found:  # one by one, a folder may hold millions
            for entry in found:
                try:
                    yield entry.name, entry.stat().st_size, entry.is_dir()
                except FileNotFoundError:  # it is gone, or a link to nothing
                    pass

    for name, size, is_folder in entries():
        hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
        if (not hidden or name.startswith(("_metadata", "_common_metadata"))) if is_folder else (size and not hidden):
            yield name, size, is_folder


def _few(system, root: str, most: int) -> bool:
    folders, seen = [root], 0
    while folders:
        folder = folders.pop()
        for name, _, is_folder in _children(system, folder):
            seen += 1
            if seen > most:
                return False
            if is_folder:
                folders.append(f"{folder}/{name}")
    return True


def _folder_uri(spark: SparkSession, path: str, most: int) -> str | None:
    """URI of a folder with more than `most` files and folders, in a file system that pyarrow knows; None for all that Spark lists."""
    from pyarrow import fs

    if set(path) & set("{}[]*?\\"):
        return None
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(there).toString()
    try:
        system, root = _place(uri)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):  # a file system that only Hadoop knows
        return None
    return None if isinstance(system, fs.LocalFileSystem) and _few(system, root, most) else uri


def _found(spark: SparkSession, uri: str, glob: str) -> DataFrame:
    """name below `uri`, source (its URI), size of the files whose own name fits the glob.

    Executors list the folders of a level and write what they hold to a table, whose folders are the next level: the driver holds
    counts only. A folder is one task's, which goes through it entry by entry.
    """
    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(uri)
        columns = ["name", "source", "size", "folder"]
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, size, is_folder in _children(system, f"{root}/{folder}"):
                    name = f"{folder}/{name}" if folder else name
                    rows.append((name, QUOTED.sub(lambda c: quote(c[0], safe=""), f"{uri.rstrip('/')}/{name}"), size, is_folder))
                    if len(rows) == ARROW_ROWS:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=columns)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=columns)

    path, levels = new_path(spark, "listing"), []
    folders, count = spark.createDataFrame([("",)], "name string"), 1
    while count:
        levels.append(f"{path}/{len(levels)}")
        tasks = min(count, max(4 * spark.sparkContext.defaultParallelism, count // FOLDER_FILES))
        folders.repartition(tasks).mapInArrow(list_folders, FOUND).write.parquet(levels[-1])
        folders = spark.read.schema(FOUND).parquet(levels[-1]).where("folder").select("name")
        count = folders.count()
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()
    fits = F.substring_index("name", "/", -1).rlike(rf"(?s)\A(?:{pattern})\z")
    return spark.read.schema(FOUND).parquet(*levels).where(~F.col("folder") & fits).select("name", "source", "size")


def _contents(files: DataFrame, uri: str) -> DataFrame:
    """Add the bytes of the files with these names below `uri`; tasks get files of about as many bytes as those of Spark's readers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(uri)
        for batch in batches:
            done, contents, held = 0, [], 0
            for name in batch.column("name").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= ARROW_BYTES or done + len(contents) == batch.num_rows:
                    some = batch.slice(done, len(contents))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                    done, contents, held = done + len(contents), [], 0

    spark = files.sparkSession
    cost = files.agg(F.sum(F.col("size") + FILE_COST)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, cost // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) + 1)
    return files.repartition(tasks).mapInArrow(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def read_html_corpus(spark: SparkSession, path: str, glob: str = "*.html", max_listed: int = LISTED_FILES) -> DataFrame:
    """One row per HTML file below `path`: text, source.

    Files whose names end as plain text are read as bytes, which costs a fraction of what the reader of whole texts spends on each
    file; that one is left for other names, as it unpacks compressed files. More than `max_listed` plain files are listed and read by
    executors, as Spark's readers hold every file, and a task for a few of them, on the driver; the rows are the same.
    """
    uri = _folder_uri(spark, path, max_listed) if glob.endswith(PLAIN_NAMES) else None
    if uri:
        return _contents(_found(spark, uri, glob), uri).select(F.col("content").cast("string").alias("text"), "source")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if glob.endswith(PLAIN_NAMES):
        files, text = reader.format("binaryFile").load(path), F.col("content").cast("string")
    else:
        files, text = reader.text(path, wholetext=True), F.col("value")
    return files.select(text.alias("text"), F.col("_metadata.file_path").alias("source"))


def list_corpus(spark: SparkSession, path: str, glob: str = "*.html", max_listed: int = LISTED_FILES) -> DataFrame:
    """Paths only; no file is opened. Executors list more than `max_listed` files."""
    uri = _folder_uri(spark, path, max_listed)
    if uri:
        return _found(spark, uri, glob).select(F.concat(F.lit(uri.rstrip("/") + "/"), "name").alias("path"))
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(path).select("path")
    )


def number_pages(pages: DataFrame, source_col: str = "source", into: str = "page_id", start: int = 0) -> DataFrame:
    """Add a dense number in the order of the sources, for corpora without a numeric key.

    Only the distinct sources are sorted. Their range partitions are written once, so that the
    counts that become offsets and the ranks within a partition come from the same cut.
    """
    names = pages.select(F.col(source_col).alias("_name")).filter("_name is not null").distinct()
    cut = materialize(names.repartitionByRange("_name").withColumn("_part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in cut.groupBy("_part").count().collect())
    offsets, reached = [], start
    for part, size in sizes:
        offsets.append((part, reached))
        reached += size
    offsets = F.broadcast(pages.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_name"))
    numbered = cut.withColumn("_rank", rank).join(offsets, "_part").select("_name", (F.col("_offset") + F.col("_rank") - 1).alias(into))
    return pages.join(numbered, F.col(source_col) == F.col("_name"), "left").drop("_name")


def grown_numbers(names: DataFrame, path: str) -> DataFrame:
    """name, page_id of all names ever seen: names (one column) that the table at `path` lacks are appended to it.

    New names get the numbers after the highest one, in their order; old numbers never move. Only names are read and sorted.
    NULL is no name. The table is written by one job at a time.
    """
    spark = names.sparkSession
    schema = "name string, page_id long"
    wanted = names.toDF("name").where("name IS NOT NULL").distinct()
    if is_complete(spark, path):
        known = spark.read.schema(schema).parquet(path)
        highest = known.agg(F.max("page_id")).first()[0]
        wanted = wanted.join(known, "name", "left_anti")
    else:
        highest = None
    fresh = number_pages(wanted, "name", start=0 if highest is None else highest + 1)
    fresh.select("name", "page_id").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pages_from_files(spark: SparkSession, path: str, glob: str = "*.html", numbers: str | None = None,
                     max_names: int = BROADCAST_NAMES, max_listed: int = LISTED_FILES) -> DataFrame:
    """page_id, url, html of the HTML files below `path`; the url is the file path.

    With `numbers`, a path of a table that keeps every name's number (`grown_numbers`), adding files leaves old numbers alone;
    without it the names are numbered in their order anew. Files that executors list get their numbers before they are opened. To
    others numbers are broadcast, for more than `max_names` in ranges of names, each with the files of its range only. The HTML is
    never shuffled.
    """
    listed = list_corpus(spark, path, glob, max_listed).select(F.col("path").alias("name"))
    table = materialize(grown_numbers(listed, numbers).join(listed, "name", "left_semi") if numbers else number_pages(listed, "name"))
    uri = _folder_uri(spark, path, max_listed) if glob.endswith(PLAIN_NAMES) else None
    if uri:
        numbered = _found(spark, uri, glob).join(table.withColumnRenamed("name", "_name"), F.col("source") == F.col("_name")).drop("_name")
        return _contents(numbered, uri).select("page_id", F.col("source").alias("url"), F.col("content").cast("string").alias("html"))
    files = read_html_corpus(spark, path, glob, max_listed)
    count = table.count()
    cuts = [None, None]
    if count > max_names:
        parts = -(-count // max_names) * 2  # ranges that are uneven still stay below
        ordered = table.repartitionByRange(parts, "name").groupBy(F.spark_partition_id().alias("_part")).agg(F.min("name").alias("low"))
        cuts = [None, *[r["low"] for r in ordered.orderBy("low").collect()][1:], None]
    found = []
    for low, high in zip(cuts, cuts[1:]):
        def within(name: Column, low: str | None = low, high: str | None = high) -> Column:
            return (F.lit(True) if low is None else name >= low) & (F.lit(True) if high is None else name < high)

        some = table.where(within(F.col("name")))
        found.append(files.where(within(F.col("source"))).join(F.broadcast(some), F.col("source") == F.col("name")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select("page_id", F.col("source").alias("url"), F.col("text").alias("html"))


def only_new(pages: DataFrame, indexed: DataFrame, page_source: Column | str = "source",
             indexed_source: Column | str = "source") -> DataFrame:
    """Pages the index does not hold yet; the index side is cut down to distinct page sources first."""
    wanted = F.col(page_source) if isinstance(page_source, str) else page_source
    held = F.col(indexed_source) if isinstance(indexed_source, str) else indexed_source
    known = indexed.select(held.alias("_held")).distinct()
    names = pages.columns
    return pages.withColumn("_wanted", wanted).join(known, F.col("_wanted") == F.col("_held"), "left_anti").select(*names)


def _elements(spark: SparkSession, path: str, value: Column, num_samples: int | None) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(value).alias("qid", "_item"))
    if num_samples is not None:
        rows = rows.filter(F.col("qid") < num_samples)
    return rows.select(F.col("qid").cast("long"), "_item.*")


def read_references(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """qid, question, answer, source.

    A `.json` file is one array and so one task; large sets belong in `.parquet` or in a folder of
    JSON Lines, both with a qid column. `num_samples` keeps the positions below it.
    """
    if path.endswith(".json"):
        return _elements(spark, path, F.from_json("value", REFERENCES), num_samples)
    return _keyed(spark, path, "qid long, question string, answer string, source string", num_samples)


def read_responses(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """qid and the answer columns, from a `{config, results}` file or a folder of result rows."""
    if path.endswith(".json"):
        results = F.from_json("value", f"results array<{ANSWER.simpleString()}>")["results"]
        return _elements(spark, path, results, num_samples)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANSWER)
    return _keyed(spark, path, f"qid long, {fields}", num_samples)


def _keyed(spark: SparkSession, path: str, schema: str, num_samples: int | None) -> DataFrame:
    reader = spark.read.schema(schema)
    rows = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    return rows if num_samples is None else rows.filter(F.col("qid") < num_samples)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, query from Parquet."""
    return spark.read.schema(QUESTIONS).parquet(path)
