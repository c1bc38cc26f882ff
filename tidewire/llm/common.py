"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch that Python gets; bounds a worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """``fn`` over every Arrow batch, partition by partition, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Free memory of this process goes back to the system, which Python workers that stay would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct, so that no name can clash and the text travels once; its text is a string."""
    text = F.col("text").cast("string").alias("text")
    return docs.select(F.struct(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("row"))


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a session on one machine takes a temporary folder and a cluster is refused.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, which goes when the session ends."""
    path = f"{shared_dir(spark)}/tidewire-{uuid.uuid4().hex}"
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def place() -> Column:
    """Where a row lies in a table that was written: the same however often a task runs again."""
    return F.xxhash64("_metadata.file_name", "_metadata.row_index")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, which goes when the session ends.

    Unlike ``checkpoint()``, the table that is read again has the size of its files as its
    statistics; estimates that a loop's joins multiply would otherwise grow without bound.
    What was shuffled for it is removed from the disks as soon as the table is written.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
