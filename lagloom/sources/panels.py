"""Sources: return panels (wide CSV), order-book files, stored tables, and panels over business tables.

A panel is (series, t, v): series by any key, t dense from 0, v double (null where there is no value)."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of runs sort by time and are read back as text, not as numbers.
RUN_FORMAT = "%Y-%m-%dT%Hh%Mm%S"

MESSAGE = T.StructType(
    [T.StructField(n, t) for n, t in (("time", T.DoubleType()), ("event_type", T.IntegerType()), ("order_id", T.LongType()), ("size", T.IntegerType()), ("price", T.LongType()), ("direction", T.IntegerType()))]
)


def orderbook_schema(levels: int) -> T.StructType:
    names = [f"{side}_{what}{k}" for k in range(1, levels + 1) for side in ("ask", "bid") for what in ("price", "size")]
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def header_date(name: Column) -> Column:
    """The date in a column name like X20000103."""
    return F.to_date(F.substring(name, 2, 8), "yyyyMMdd")


def melted(wide: DataFrame, key: str) -> DataFrame:
    """(series, t, date, v) of a frame with one row a series and one column a date; t numbers the columns."""
    days = [c for c in wide.columns if c != key]
    t = F.create_map(*[x for k, c in enumerate(days) for x in (F.lit(c), F.lit(k))])
    long = wide.select(F.col(key).alias("series"), *[F.col(f"`{c}`").cast("double").alias(c) for c in days]).unpivot("series", days, "day", "v")
    v = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    return long.select("series", t[F.col("day")].alias("t"), header_date(F.col("day")).alias("date"), v.alias("v"))


def read_returns(spark: SparkSession, path: str, key: str = "ticker", drop_incomplete: bool = False) -> DataFrame:
    """A wide CSV of returns as a panel; drop_incomplete leaves out series with a missing value."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType() if n == key else T.DoubleType()) for n in names])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    return melted(wide.na.drop("any") if drop_incomplete else wide, key)


def write_returns(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").option("header", True).csv(path)


def write_wide_returns(panel: DataFrame, path: str, key: str = "ticker") -> None:
    """A panel (series, date, v) as the wide CSV that read_returns reads: a row for each series, a column X20000103 for each
    date in order; what is missing is empty. Only the dates, which are the columns, come to the driver."""
    day = F.concat(F.lit("X"), F.date_format("date", "yyyyMMdd"))
    days = [r.day for r in panel.select(day.alias("day")).distinct().orderBy("day").collect()]
    wide = panel.select(F.col("series").alias(key), day.alias("day"), "v").groupBy(key).pivot("day", days).agg(F.max("v"))
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A stored panel, its times cut to [start, end) at the scan."""
    df = spark.read.parquet(path)
    return between(df, start, end)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_signals(spark: SparkSession, path: str, first: int | None = None, **layout) -> DataFrame:
    """Rows of a table stored by write_table with partitions (sigma, max_shift, k, start ...); layout picks partitions,
    first keeps the series below that number. Both reach the scan."""
    df = spark.read.parquet(path)
    for name, value in layout.items():
        df = df.where(F.col(name) == value)
    return df if first is None else df.where(F.col("series") < first)


def write_parameters(spark: SparkSession, path: str, **parameters) -> None:
    """The parameters of a run as a table of one row with one JSON object; names in order."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "parameters string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> dict:
    """What write_parameters stored; an error if there is not one row of parameters."""
    found = spark.read.text(path).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} does not hold one row of parameters")
    return json.loads(found[0][0])


def write_run(df: DataFrame, path: str, run_ts: datetime) -> None:
    """df as the partition run_ts of a table of runs. The same run written again is replaced; others stay."""
    out = df.withColumn("run_ts", F.lit(run_ts.strftime(RUN_FORMAT)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def read_run(spark: SparkSession, path: str, run_ts: datetime | None = None) -> DataFrame:
    """One run of a table of runs, the last by default."""
    runs = spark.read.parquet(path)
    name = run_ts.strftime(RUN_FORMAT) if run_ts else runs.agg(F.max("run_ts")).first()[0]
    return runs.where(F.col("run_ts") == name).drop("run_ts")


def between(panel: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Times in [start, end)."""
    if start is not None:
        panel = panel.where(F.col("t") >= start)
    return panel if end is None else panel.where(F.col("t") < end)


def numbered(df: DataFrame) -> DataFrame:
    """df with row_id, the position of a row in its file; rows keep the order of the scan, and no task sees all rows."""
    rows = df.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # a number a partition
    base, before = {}, 0
    for p in sorted(counts):
        base[p], before = before, before + counts[p]
    first = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))]) if base else F.create_map()
    in_part = F.col("_in") - F.shiftleft(F.col("_part").cast("long"), 33)
    return rows.withColumn("row_id", first[F.col("_part")].cast("long") + in_part).drop("_part", "_in")


def read_order_book(spark: SparkSession, message_path: str, book_path: str, levels: int = 1) -> DataFrame:
    """Messages beside the book they left, matched by position in the two headerless files."""
    message = numbered(spark.read.schema(MESSAGE).csv(message_path))
    book = numbered(spark.read.schema(orderbook_schema(levels)).csv(book_path))
    return message.join(book, "row_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densified(cells: DataFrame) -> DataFrame:
    """cells (series, t, v) with a row for each series and each time of the whole span, 0 where nothing was."""
    span = cells.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = cells.select("series").distinct().join(F.broadcast(span)).select("series", F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(cells, ["series", "t"], "left").select("series", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by customer nation and month; the last, partial month is left out."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    first = orders.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    cells = orders.select("o_custkey", "o_totalprice", month.alias("m")).join(F.broadcast(first)).where("m < last")
    cells = cells.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("series"), (F.col("m") - F.col("first")).alias("t")).agg(F.sum("o_totalprice").alias("v"))
    return densified(cells)


NATION_SQL = """
bounds AS (SELECT min(year(o_orderdate) * 12 + month(o_orderdate)) AS lo, max(year(o_orderdate) * 12 + month(o_orderdate)) AS hi FROM orders),
cells AS (
  SELECT c_nationkey AS series, year(o_orderdate) * 12 + month(o_orderdate) - lo AS t, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey, bounds WHERE year(o_orderdate) * 12 + month(o_orderdate) < hi GROUP BY 1, 2),
months AS (
  SELECT s.series, g.t::INT AS t, coalesce(c.v, 0.0) AS v FROM (SELECT DISTINCT series FROM cells) s
  CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM cells), (SELECT max(t) + 1 FROM cells))) AS t) g LEFT JOIN cells c ON c.series = s.series AND c.t = g.t)
"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by user and day, null where a user has no event."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    cells = events.join(F.broadcast(first)).groupBy(F.col("user_id").alias("series"), F.datediff(F.to_date("ts"), "first").alias("t")).agg(F.sum("value").alias("v"))
    span = cells.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = cells.select("series").distinct().join(F.broadcast(span)).select("series", F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(cells, ["series", "t"], "left").select("series", "t", "v")


USER_SQL = """
ucells AS (
  SELECT user_id AS series, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)::INT AS t, sum(value) AS v FROM events GROUP BY 1, 2),
days AS (
  SELECT s.series, g.t::INT AS t, c.v FROM (SELECT DISTINCT series FROM ucells) s
  CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM ucells), (SELECT max(t) + 1 FROM ucells))) AS t) g LEFT JOIN ucells c ON c.series = s.series AND c.t = g.t)
"""


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as series, array position as time."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.posexplode("embedding").alias("t", "x")).select("series", "t", F.col("x").cast("double").alias("v"))


def embedding_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, x): the vectors of embedding_series, whole."""
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("series"), F.col("embedding").alias("x"))


EMBED_SQL = """
vecs AS (
  SELECT vec_id AS series, (i - 1)::INT AS t, embedding[i]::DOUBLE AS v, label AS cls
  FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day as a stream of quotes: seconds after midnight, and a price from the value."""
    e = table(spark, sf_dir, "events")
    seconds = F.hour("ts") * 3600.0 + F.minute("ts") * 60.0 + F.date_format("ts", "s").cast("double")
    return e.select(F.col("event_type").alias("series"), F.to_date("ts").alias("day"), seconds.alias("time"), F.col("event_id").alias("row_id"), F.col("value").alias("v"))


QUOTES_SQL = """
quotes AS (
  SELECT event_type AS series, ts::DATE AS day, hour(ts) * 3600.0 + minute(ts) * 60.0 + floor(second(ts)) AS time, event_id AS row_id, value AS v FROM events)
"""
