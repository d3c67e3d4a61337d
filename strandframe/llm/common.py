"""What several operators share: inputs, joins with small sides, native SimHash and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandframe.scratch import Scratch

#: Rows of ids (some tens of bytes each) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows; otherwise as it is, so that joins shuffle it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def extended(df: DataFrame, *new: tuple[str, str]) -> StructType:
    """df's schema with the columns of new (name, type) added; df's own stays as it is."""
    out = StructType(list(df.schema.fields))
    for name, kind in new:
        out = out.add(name, kind)
    return out


def word_array(text: Column) -> Column:
    """The words of a text, none for null or blank text."""
    words = F.split(F.coalesce(text, F.lit("")), _GAP)
    return F.filter(words, lambda w: w != "")


_ONES = 0x0101010101010101
_HALF = 0x4040404040404040
#: Counts in lanes of eight bits stay below 128, so that no sum of longs overflows.
LANE = 127


def _packed(hashes: Column) -> Column:
    """Counts of each bit over at most 127 hashes: long k holds bits k, k+8, ... in lanes of eight bits."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(8)])
    return F.aggregate(
        hashes,
        zero,
        lambda s, h: F.struct(
            *[
                (s[f"c{k}"] + (F.shiftrightunsigned(h, k) if k else h).bitwiseAND(F.lit(_ONES))).alias(f"c{k}")
                for k in range(8)
            ]
        ),
    )


def packed_sums(h: Column) -> list[Column]:
    """Aggregates c0 ... c7: the counts of each bit over at most LANE rows of hash h, packed like those of simhash."""
    return [F.sum((F.shiftrightunsigned(h, k) if k else h).bitwiseAND(F.lit(_ONES))).alias(f"c{k}") for k in range(8)]


def simhash_of_sums(n: Column) -> Column:
    """SimHash from the columns c0 ... c7 of packed_sums over n rows, at most LANE."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(_majority({f"c{k}": F.col(f"c{k}") for k in range(8)}, n))


def simhash(hashes: Column, n: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes; n is its size. A bit is 1 if set in over half of them.

    Up to 127 hashes are counted in packed lanes; longer arrays go in slices of
    127 whose counts are added up. No hashes give 0.
    """
    short = F.aggregate(
        F.array(_packed(hashes)),
        F.lit(0).cast("long"),
        lambda acc, s: _majority(s, n),
    )
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / LANE).cast("int")), lambda i: F.slice(hashes, i * LANE + 1, F.lit(LANE))
    )
    counts = F.aggregate(
        slices,
        F.array_repeat(F.lit(0), 64),
        lambda acc, part: F.zip_with(
            acc,
            F.flatten(
                F.transform(
                    F.array(_packed(part)),
                    lambda s: F.array(
                        *[
                            F.shiftrightunsigned(s[f"c{b % 8}"], 8 * (b // 8)).bitwiseAND(F.lit(127)).cast("int")
                            for b in range(64)
                        ]
                    ),
                )
            ),
            lambda x, y: x + y,
        ),
    )
    long = F.aggregate(
        F.transform(counts, lambda c, b: F.when(c * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, bit: acc.bitwiseOR(bit),
    )
    return F.when(n == 0, F.lit(0).cast("long")).when(n <= LANE, short).otherwise(long)


def _majority(s: Column | dict[str, Column], n: Column) -> Column:
    # a lane with a count over n div 2 reaches 64 once 63 - n div 2 is added, and none reaches 128
    add = (F.lit(63) - F.floor(n / 2)).cast("long") * F.lit(_ONES)
    out = F.lit(0).cast("long")
    for k in range(8):
        bit = F.shiftrightunsigned((s[f"c{k}"] + add).bitwiseAND(F.lit(_HALF)), 6)
        out = out.bitwiseOR(F.shiftleft(bit, k) if k else bit)
    return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component is the smallest node that is reachable. Nodes are of any ordered type.

    Every node points to a smaller one. In each round a node and the node it
    points to take the smallest grandparent among the neighbours, and pointers
    are halved, so the rounds grow with the logarithm of the diameter. All
    steps are joins with a side that is unique by key, and minima that are
    pre-aggregated, so a hub only adds rows, never a large group.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = scratch.save(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    up = scratch.save(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p")), "up"
    )
    # pointers only ever fall, so an unchanged sum of their hashes means that none moved
    state = F.sum(F.xxhash64("node", "p").cast("decimal(38,0)"))
    total = up.agg(state).first()[0]
    while total is not None:
        parent = up.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = up.join(parent, "p").select("node", "p", "g")
        near = both.join(grand.select(F.col("node").alias("b"), F.col("g").alias("bg")), "b").groupBy("a").agg(F.min("bg").alias("m"))
        joined = grand.join(near.withColumnRenamed("a", "node"), "node")
        moves = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.least("g", "m").alias("p")),
                    F.struct(F.col("p").alias("node"), F.least("g", "m").alias("p")),
                )
            ).alias("x")
        ).select("x.*")
        after = scratch.save(moves.groupBy("node").agg(F.min("p").alias("p")), "up")
        now = after.agg(state).first()[0]
        scratch.free(up)
        up, same, total = after, now == total, now
        if same:
            break
    scratch.free(both)
    return up.select("node", F.col("p").alias("component"))
