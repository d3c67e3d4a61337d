"""Joins with a side that is unique by key, where one key may hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.scratch import Scratch

#: Rows of a key from which it is dealt, and keys up to which their table is broadcast.
HEAVY, BROADCAST_ROWS = 4096, 500_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """left joined with right, which has one row for each key at most. how: inner or left.

    Rows of keys that hold over heavy rows of left are dealt by a hash of the
    whole row, and such a key's row of right goes to each part.
    """
    held = left.groupBy(*keys).count().where(F.col("count") > heavy)
    parts = Scratch(left.sparkSession, "lookup").save(held.select(*keys, F.ceil(F.col("count") / heavy).cast("bigint").alias("__parts")), "heavy")
    n = parts.count()
    if not n:
        return left.join(right, keys, how)
    parts = F.broadcast(parts) if n <= BROADCAST_ROWS else parts
    of = F.coalesce("__parts", F.lit(1).cast("bigint"))
    a = left.withColumn("__h", F.xxhash64(*left.columns)).join(parts, keys, "left").withColumn("__part", F.pmod("__h", of)).drop("__h", "__parts")
    b = right.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")
