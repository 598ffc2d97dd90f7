"""Tables between the rounds of iterative work, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One is made for a local master only, whose tasks all see it; on a cluster
    without the setting this is an error, as executors do not see each other's folders."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lagloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there."""
    sc = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/lagloom-{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
