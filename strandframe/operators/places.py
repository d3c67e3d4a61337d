"""Rows beside all that lies near them: one shuffle to places, then whole groups of Arrow rows at once.

A place is a key and a bin that is wider than any range. A row goes to the bin
of its start, where it is at home, and as a guest to all bins whose rows, as
long as they may be, it can overlap. So each row is at home in one place and
finds all ranges that overlap it there, and all that these overlap up to the
reach of a range beyond the bin. Places of over MOST rows are left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.scratch import Scratch

#: The least width of a bin, and how many times the longest range it is at least.
WIDTH, TIMES = 1 << 16, 4
#: Rows of a place from which its key is left to the caller.
MOST = 1 << 18
#: Rows that are worked on together, if whole places allow.
TOGETHER = 1 << 17
#: Groups by hash that bound the rows of all places at little cost.
BUCKETS = 1 << 14


class Near:
    """Rows of whole places: table (with __home), their group, and start and end on one line on which groups are apart; null keys and empty ranges have live false."""

    def __init__(self, table: pa.Table, keys: list[str], width: int) -> None:
        self.table, n, self.width = table, table.num_rows, width
        change = np.zeros(n, bool)
        change[:1] = True
        for c in [*keys, "__bin"]:
            change[1:] |= changes(table.column(c))
        self.group = np.cumsum(change) - 1
        self.home, self.live = self.flag("__home"), self.flag("__live")
        self.bin = self.long("__bin")
        start, end = self.long("start"), self.long("end")
        first = np.where(self.live, start, 0)
        # a guest begins a reach before the bin at the earliest, and ends a reach behind it at the latest
        self.span = 4 * width
        self.base = self.group * self.span - (self.bin - 1) * width
        self.start = np.where(self.live, first + self.base, self.group * self.span)
        self.end = np.where(self.live, np.where(self.live, end, 0) + self.base, self.start)

    def flag(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)

    def long(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(self, name: str) -> tuple[pa.Array, np.ndarray]:
        """The values of a column of lists, and the size of each row's."""
        column = self.table.column(name).combine_chunks()
        return column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal."""
    a = column.combine_chunks()
    if a.null_count:
        null = a.is_null().to_numpy(zero_copy_only=False)
        differ = pc.not_equal(a[1:], a[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        return differ | (null[1:] != null[:-1])
    return pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)


def ranks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The place of each text in the order of bytes, equal for equal texts; -1 for null."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = a.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    return rank[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]


def _whole_places(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole places, of TOGETHER rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(n - 1, bool)
        for c in [*keys, "__bin"]:
            change |= changes(table.column(c))
        cuts = np.flatnonzero(change)
        if len(cuts):
            at = int(cuts[-1]) + 1
            yield table.slice(0, at)
            table = table.slice(at)
        held, n = table.combine_chunks().to_batches(), table.num_rows
    if n:
        yield pa.Table.from_batches(held)


def near(df: DataFrame, keys: list[str], f: Callable[[Near], pa.Table | Iterator[pa.Table]], schema: str, own: tuple[str, ...] = (), most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """(found, crowded): f of all rows of df (keys, start, end and others) in whole places, sorted by place and start, and the rows of keys that f did not see, None if there are none.

    Columns of own are null for guests. Rows with a null key and empty ranges
    are at home somewhere, and live is false for them.
    """
    live = (F.col("start") < F.col("end")) & ~F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    live = F.coalesce(live, F.lit(False))
    reach, width, heavy = 0, WIDTH, None
    while True:
        place = F.floor(F.col("start") / width)
        bucket = F.pmod(F.xxhash64(*keys, place), F.lit(BUCKETS))
        # rows and their guests lie in this bin or beside it
        rows = df.where(live).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("end") - F.col("start")).alias("reach")).collect()
        reach = max((r.reach for r in rows), default=0)
        if TIMES * reach <= width:
            break
        width = 1 << (TIMES * reach - 1).bit_length()
    over = [r.b for r in rows if r.n > most // 2]
    if over:
        # a place has guests from the bin before and behind as well
        counts = df.where(live & bucket.isin(over)).groupBy(*keys, place.alias("__bin")).count().where(F.col("count") > most // 2).select(*keys).distinct()
        heavy = Scratch(df.sparkSession, "places").save(counts, "crowded")
        n = heavy.count()
        heavy = None if not n else F.broadcast(heavy) if n <= 500_000 else heavy
    crowded = None
    rows = df
    if heavy is not None:
        rows, crowded = (df.join(heavy, keys, how).select(*df.columns) for how in ("left_anti", "left_semi"))
    bins = F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") - 1) / width))
    some = F.pmod(F.xxhash64(*rows.columns), F.lit(BUCKETS))
    placed = rows.withColumn("__live", live).withColumn("__bin", F.explode(F.when(F.col("__live"), bins).otherwise(F.array(some))))
    placed = placed.withColumn("__home", ~F.col("__live") | (F.col("__bin") == F.floor(F.col("start") / width)))
    placed = placed.withColumns({c: F.when(F.col("__home"), F.col(c)) for c in own})
    by = [*keys, "__bin"]
    placed = placed.repartition(*by).sortWithinPartitions(*by, "start")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_places(batches, keys):
            found = f(Near(table, keys, width))
            for out in [found] if isinstance(found, pa.Table) else found:
                yield from out.combine_chunks().to_batches(max_chunksize=1 << 15)

    return placed.mapInArrow(work, schema), crowded


def largest_over(first: np.ndarray, last: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The largest value of ranges [first, last] over each of n points, 0 where there is none: each range is two overlapping ones of a power of two."""
    k = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.zeros(0, np.int64)
    for level in range(int(k.max(initial=0)), -1, -1):
        here = np.zeros(n, np.int64)
        if len(out):
            half = 1 << level
            np.maximum(here, out, out=here)
            np.maximum(here[half:], out[: max(n - half, 0)], out=here[half:])
        at = np.flatnonzero(k == level)
        np.maximum.at(here, first[at], value[at])
        np.maximum.at(here, last[at] - (1 << level) + 1, value[at])
        out = here
    return out if len(out) else np.zeros(n, np.int64)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
