"""Exact order statistics and quantiles without gathering the values.

Rounds of selection: approximate quantiles, whose sketches are merged at a fixed size, cut the values of every node (all
values of a key, at first) into parts; a count for each part, added up before it is shuffled, says exactly which part
holds a wanted rank. Only values of such parts go on as nodes of their own, about one in PARTS; a part whose values are
all equal is its own answer. A node of SMALL values or fewer is sorted. No task holds more than SMALL values of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.storage import stored_table

PARTS, SMALL = 32, 20_000


def order_statistics(values: DataFrame, wanted: DataFrame, keys: tuple[str, ...], small: int = SMALL) -> DataFrame:
    """(keys..., rank, v): of values (keys..., v) those of the wanted ranks (keys..., rank), from 0; v is not null."""
    on = [*keys, "_node"]
    live = values.select(*keys, F.lit(0).cast("long").alias("_node"), "v")
    asks = wanted.select(*keys, F.lit(0).cast("long").alias("_node"), "rank", F.col("rank").alias("_off"))
    found = None
    while True:
        sizes = live.groupBy(*on).agg(F.count("*").alias("_n"), F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"), F.min("v").alias("_min"), F.max("v").alias("_max"))
        sizes = stored_table(sizes, "sizes")
        asked = asks.join(sizes, on)
        done = asked.where("_min = _max").select(*keys, "rank", F.col("_min").alias("v"))
        few = sizes.where((F.col("_n") <= small) & (F.col("_min") < F.col("_max"))).select(*on)
        sorted_ = live.join(few, on, "left_semi").groupBy(*on).agg(F.array_sort(F.collect_list("v")).alias("_v"))
        done = done.union(asks.join(sorted_, on).select(*keys, "rank", F.get("_v", F.col("_off").cast("int")).alias("v")))
        found = done if found is None else found.union(done)
        many = sizes.where((F.col("_n") > small) & (F.col("_min") < F.col("_max"))).select(*on, F.array_distinct("_cuts").alias("_cuts"), F.col("_min"))
        if many.isEmpty():
            return found
        # a value's part: how many cuts are below it or equal to it; copies of the least value are a part of their own
        part = F.size(F.filter("_cuts", lambda c: (c <= F.col("v")) & (c > F.col("_min")))) + (F.col("v") > F.col("_min")).cast("int")
        parted = live.join(many, on).select(*on, part.alias("_part"), "v")
        counts = stored_table(parted.groupBy(*on, "_part").agg(F.count("*").alias("_c"), F.min("v").alias("_lo")), "parts")
        w = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a node
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        down = F.col("_node") * (PARTS + 2) + F.col("_part") + 1
        nexts = asks.join(counts, on).where((F.col("_off") >= F.col("_before")) & (F.col("_off") < F.col("_before") + F.col("_c")))
        nexts = stored_table(nexts.select(*keys, down.alias("_node"), "_part", F.col("_node").alias("_up"), "rank", (F.col("_off") - F.col("_before")).alias("_off")), "asks")
        held = nexts.select(*keys, F.col("_up").alias("_node"), "_part").distinct()
        live = stored_table(parted.join(held, [*on, "_part"], "left_semi").select(*keys, down.alias("_node"), "v"), "live")
        asks = nexts.select(*keys, "_node", "rank", "_off")


def exact_quantiles(df: DataFrame, value: Column, probabilities: list[float], *keys: str, small: int = SMALL) -> DataFrame:
    """(keys..., q): the quantiles of the values that are not null, in the order of probabilities, linearly interpolated
    between the nearest ranks; null for keys without values."""
    values = df.select(*keys, value.cast("double").alias("v"))
    keyed = keys or ("_all",)
    if not keys:
        values = values.withColumn("_all", F.lit(0))
    values = stored_table(values, "values")  # rounds read it again and again
    counts = values.groupBy(*keyed).agg(F.count("v").alias("_n"))
    spots = F.array(*[F.struct(F.lit(k).alias("_k"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_at")) for k, p in enumerate(probabilities)])
    spots = counts.where("_n > 0").select(*keyed, F.explode(spots).alias("s")).select(*keyed, "s._k", "s._at")
    ends = spots.select(*keyed, F.explode(F.array(F.floor("_at").cast("long"), F.ceil("_at").cast("long"))).alias("rank")).distinct()
    found = order_statistics(values.where("v IS NOT NULL"), ends, keyed, small)
    low, high = (found.select(*keyed, F.col("rank").alias(f"{side}_rank"), F.col("v").alias(side)) for side in ("low", "high"))
    whole = spots.withColumns({"low_rank": F.floor("_at").cast("long"), "high_rank": F.ceil("_at").cast("long")}).join(low, [*keyed, "low_rank"]).join(high, [*keyed, "high_rank"])
    q = F.col("low") + (F.col("high") - F.col("low")) * (F.col("_at") - F.col("low_rank"))
    packed = whole.groupBy(*keyed).agg(F.array_sort(F.collect_list(F.struct("_k", q.alias("q")))).alias("s")).select(*keyed, F.col("s.q").alias("q"))
    if not keys:
        return df.sparkSession.range(1).join(packed, F.lit(True), "left").select("q")
    return counts.select(*keys).join(packed, list(keys), "left").select(*keys, "q")
