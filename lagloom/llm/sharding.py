"""Placement by a permutation-filled lookup table, in SQL expressions only.

Each shard prefers the slots of a prime-sized table in its own order: offset, offset + skip, offset + 2 skip, ...
modulo the size. Shards take turns; at its turn a shard claims the first slot of its order that is still free, until
no slot is free. Turn by turn the shares differ by one slot at most, and when a shard goes few other slots move. The
filled table has `size` rows, a parameter, so it is broadcast; a row is placed by one look-up of its key's hash.

Null keys are placed like the empty string. Repeated keys go to one shard; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table (a prime) in the registered query, and its shards.
SIZE = 1021
SHARDS = tuple(f"shard-{k:02d}" for k in range(12))


def hashed(text):
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard): the filled table. The state of the fill is a struct: whose turn it is, how far each shard has
    come in its order, and the owners so far; one step of `aggregate` looks at one slot and claims it if it is free."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the size of the table must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, and no more than slots")
    n = len(shards)
    names = F.array(*[F.lit(s) for s in shards])
    orders = F.transform(
        names,
        lambda s: F.struct(
            (hashed(F.concat(s, F.lit("/offset"))) % size).cast("int").alias("offset"),
            (hashed(F.concat(s, F.lit("/skip"))) % (size - 1) + 1).cast("int").alias("skip"),
        ),
    )
    # A shard meets every slot once, so n * size looks are always enough.
    row = spark.range(1).select(names.alias("names"), orders.alias("orders"))

    def step(state, _):
        mine = F.get(F.col("orders"), state.turn)
        slot = F.pmod(mine.offset.cast("long") + F.get(state.seen, state.turn).cast("long") * mine.skip, F.lit(size)).cast("int")
        free = F.get(state.owner, slot) < 0
        seen = F.concat(F.slice(state.seen, F.lit(1), state.turn), F.array(F.get(state.seen, state.turn) + 1), F.slice(state.seen, state.turn + 2, F.lit(n)))
        owner = F.when(free, F.concat(F.slice(state.owner, F.lit(1), slot), F.array(state.turn), F.slice(state.owner, slot + 2, F.lit(size)))).otherwise(state.owner)
        going = F.struct(
            F.when(free, (state.turn + 1) % n).otherwise(state.turn).alias("turn"),
            (state.left - free.cast("int")).alias("left"),
            seen.alias("seen"),
            owner.alias("owner"),
        )
        return F.when(state.left == 0, state).otherwise(going)

    start = F.struct(
        F.lit(0).alias("turn"), F.lit(size).alias("left"),
        F.array_repeat(F.lit(0), n).alias("seen"), F.array_repeat(F.lit(-1), size).alias("owner"),
    )
    filled = row.select("names", F.aggregate(F.sequence(F.lit(1), F.lit(n * size)), start, step).alias("end"))
    return filled.select("names", F.posexplode("end.owner").alias("slot", "k")).select("slot", F.get("names", F.col("k")).alias("shard"))


def place(df: DataFrame, key_col: str, table: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, slot, shard) for every row of df. The table has `size` rows whatever df has, so it is broadcast."""
    keyed = df.select(F.col(key_col).alias("key"), (hashed(F.coalesce(F.col(key_col).cast("string"), F.lit(""))) % size).cast("int").alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("key", "slot", "shard")
