"""Numbers and running sums over whole tables, in ranges.

Rows are dealt to ranges of their order and sorted there; a small table has how much each range holds, and what the ranges
before it hold is added to what a row sees in its own. So no task sees more than a range, and one key of any size is in many
ranges. The table is stored after dealing, so that a task that runs again finds its rows in the same ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.storage import stored_table

RANGE, AT = "_range", "_at"


def _ranged(df: DataFrame, order: list[Column | str], keys: tuple[str, ...]) -> DataFrame:
    by = [*keys, *order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    return stored_table(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumns({RANGE: F.shiftright(at, 33), AT: at}), "ranges")


def _before(parts: DataFrame, keys: tuple[str, ...], total: str) -> DataFrame:
    """parts (keys..., range, total) with the sum over earlier ranges of its key: a row for each range that a key is in."""
    w = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(total).over(w), F.lit(0)))


def _met(rows: DataFrame, parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    renamed = parts.select(*[F.col(k).alias(f"_{k}") for k in (*keys, RANGE)], *[c for c in parts.columns if c not in (*keys, RANGE)])
    on = rows[RANGE] == renamed[f"_{RANGE}"]
    for k in keys:
        on &= rows[k].eqNullSafe(renamed[f"_{k}"])
    return rows.join(renamed, on).drop(*[f"_{k}" for k in (*keys, RANGE)])


def numbered(df: DataFrame, order: list[Column | str], *keys: str, place: str = "place", n: str | None = None) -> DataFrame:
    """df with place: 0, 1, ... by order, among the rows of its keys; and, if named, n: how many they are. Equal rows come
    in any order."""
    rows = _ranged(df, order, keys)
    parts = rows.groupBy(*keys, RANGE).agg(F.min(AT).alias("_first"), F.count("*").alias("_rows"))
    parts = _before(parts, keys, "_rows")
    if n:
        parts = parts.withColumn(n, F.sum("_rows").over(Window.partitionBy(*keys)))
    met = _met(rows, parts.drop("_rows"), keys)
    return met.withColumn(place, F.col(AT) - F.col("_first") + F.col("_before")).drop(RANGE, AT, "_first", "_before")


def running_sum(df: DataFrame, value: Column, order: list[Column | str], *keys: str, total: str = "total") -> DataFrame:
    """df with total: the sum of value over its row and all before it by order, among the rows of its keys."""
    rows = _ranged(df.withColumn("_value", value), order, keys)
    parts = _before(rows.groupBy(*keys, RANGE).agg(F.sum("_value").alias("_sum")), keys, "_sum")
    own = F.sum("_value").over(Window.partitionBy(*keys, RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    met = _met(rows.withColumn("_own", own), parts.drop("_sum"), keys)
    return met.withColumn(total, F.col("_own") + F.col("_before")).drop(RANGE, AT, "_own", "_before", "_value")
