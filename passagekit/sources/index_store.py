"""The index table: create, write, read, reset, snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.embedding import check_dim
from passagekit.schemas import INDEX


def create_index_table(spark: SparkSession, table: str = "document", location: str | None = None) -> None:
    """Create the table if it is absent."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{where}")


def _required(name: str) -> Column:
    column = F.col(name)
    message = F.lit(f"index column {name} is NULL")
    return F.when(column.isNull(), F.raise_error(message).cast(INDEX[name].dataType)).otherwise(column).alias(name)


def index_rows(df: DataFrame, dim: int | None = None) -> DataFrame:
    """The index columns. A NULL id, text or source, or a vector of another size, stops the write."""
    vector = check_dim(F.col("embedding"), dim) if dim else F.col("embedding")
    return df.select(_required("id"), _required("text"), _required("source"), vector.cast("array<float>").alias("embedding"))


def write_index(df: DataFrame, path: str, mode: str = "append", dim: int | None = None) -> None:
    """Write rows in one distributed job."""
    index_rows(df, dim).write.mode(mode).parquet(path)


def insert_index(df: DataFrame, table: str = "document", dim: int | None = None) -> None:
    """Append rows to a catalog table."""
    index_rows(df, dim).write.mode("append").insertInto(table)


def reset_index(spark: SparkSession, path: str) -> None:
    """Empty the index."""
    spark.createDataFrame([], INDEX).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of the index; by default those without the vector, which then is not read."""
    return spark.read.schema(INDEX).parquet(path).select(*(columns or ("id", "text", "source")))


#: Partition column of an index that lies by ranges of ids, and the column that says how many low bits of an id a range spans.
RANGE, RANGE_BITS = "id_range", "range_bits"


def write_ranges(index: DataFrame, path: str, bits: int, mode: str = "overwrite") -> None:
    """Write id, text, source (and embedding, if there is one) in folders of 2 ** bits ids each, sorted by id.

    With packed ids a folder holds the chunks of 2 ** (bits - 28) pages. Rows are dealt by ranges of ids, so a folder of any
    size is written by many tasks. Overwriting replaces the folders that the rows belong to and leaves the others.
    """
    columns = [F.col(c) if c == "embedding" else _required(c) for c in INDEX.names if c in index.columns]
    placed = index.select(*columns, F.lit(bits).alias(RANGE_BITS)).withColumn(RANGE, F.shiftright("id", bits))
    placed.repartitionByRange(RANGE, "id").sortWithinPartitions(RANGE, "id").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)


def read_ranges(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of an index by ranges, and its range; lookups by id then read the folders that they need."""
    return spark.read.parquet(path).select(*(columns or ("id", "text", "source")), RANGE, RANGE_BITS)


def snapshot_path(root: str, model: str, chunk_size: int, chunk_overlap: int) -> str:
    """Where the snapshot of one configuration lies."""
    return f"{root.rstrip('/')}/{model.rsplit('/', 1)[-1]}_{chunk_size}_{chunk_overlap}"


def snapshot_index(spark: SparkSession, path: str, snapshot: str) -> None:
    """Copy the index to a snapshot."""
    read_index(spark, path, *INDEX.names).write.mode("overwrite").parquet(snapshot)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at the path."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def load_or_build_index(spark: SparkSession, root: str, model: str, dim: int | None, chunk_size: int, chunk_overlap: int,
                        build: Callable[[], DataFrame]) -> DataFrame:
    """Read the snapshot of this configuration; build and write it first if it is not complete."""
    snapshot = snapshot_path(root, model, chunk_size, chunk_overlap)
    if not is_complete(spark, snapshot):
        write_index(build(), snapshot, "overwrite", dim)
    return read_index(spark, snapshot, *INDEX.names)


def write_if_absent(df: DataFrame, path: str, dim: int | None = None) -> None:
    """Whole-index guard: do nothing if an index is there."""
    write_index(df, path, "ignore", dim)
