"""What the operators of this subpackage share: the shared folder, written tables, safe columns."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartledger.streaming.jobs import work_folder

# Rows, and bytes of all rows together, up to which a table may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 40_000_000
# Bytes of a column that a task turns into Python objects at a time.
PIECE_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the folder that all executors share and read it back.

    Cuts the lineage: a lost executor costs a read of files, not the work before them.
    """
    spark = df.sparkSession
    path = work_folder(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files in a format of their own."""
    return work_folder(spark, f"llm-{name}-{uuid.uuid4().hex[:4]}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it is proven to hold at most ``rows`` rows of ``size``
    bytes in all (measured as JSON).

    Give it a written table: it is counted. Beyond the bounds the hint is left out, and the join
    is a sort-merge join whose hot partitions adaptive execution splits.
    """
    told = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")).alias("size"))
    found = told.first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


def small_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Equi-join with a written table: broadcast if `small_side` proves it small, and by sorted
    shuffles else, whatever size the optimizer takes the table for."""
    side = small_side(right)
    return left.join(right.hint("merge") if side is right else side, on, how)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hex_to_long(hex_text: Column, digits: int) -> Column:
    """The number written by the first ``digits`` (15 at most) hex digits."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def in_pieces(batches: Iterator[pa.RecordBatch], column: str,
              size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of ``column``; a longer value is one slice."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
