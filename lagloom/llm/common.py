"""What the training-data operators share: the shared folder, stored tables, Arrow mapping, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.sources.storage import shared_folder

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\r\x0b\x0c"
#: Entries of a per-worker memo before it starts afresh; a memo only saves time.
MEMO = 300_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/lagloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, *partition_by: str, folder: str | None = None) -> DataFrame:
    """df written to a table in the shared folder and read again: lineage ends, lost executors cost nothing."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}" if folder else shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """stored() for tables that nothing needs after the block: they are deleted at its end."""
    path = shared_path(spark, "scratch")
    yield partial(stored, folder=path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """The path of a new file in the shared folder."""
    path = shared_path(spark, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(content))
    out.close()
    return path


def hand_back() -> None:
    """What a worker has freed goes back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with Python lists: make() runs once a task and returns a function from one list per column of df
    to a dict of lists or arrays, one per field of schema. It gets an Arrow batch at a time, or that many rows of it at
    most: an array of numbers takes several times as much memory as a list."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows or 1):
                part = batch.slice(at, rows)
                out = step(*(c.to_pylist() for c in part.columns))
                done = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
                del out
                yield done
                del part, done
        del step
        hand_back()

    return df.mapInArrow(run, fields)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def folded_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "replace").lower().split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df dealt by cols to as many tasks as shuffles have: for small rows that make much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of counts with the largest n, at most `most` of them: all from the least level (a power of 2 ** (1 / 8))
    that few enough reach. Only a count for each level comes to the driver."""
    level = F.floor(F.log2(F.col(n)) * 8).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if r.rows > room:
            break
        room, least = room - r.rows, r.level
    return counts.where(level >= least) if least is not None else counts.limit(0)
