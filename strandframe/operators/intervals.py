"""Interval algebra on half-open ranges [start, end) by key columns.

A key may hold a large share of all rows, so windows over ranges go by (key,
bin of the start). What a bin takes over from the bins before it (how far they
reach, their depth) comes from a table with one row for each bin, which alone
is sorted by key. Ranges with a null key belong to no sequence and are left out.

Joins on overlap have bins of several widths. A range's own length gives its
level, whose bins are at least as wide, so it lies in one or two of them. A
shorter range is lifted to the levels of longer ones on the other side, and a
pair counts in the first bin that both share. Bins with many rows are dealt
into blocks, each pair of which is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandframe.operators import places
from strandframe.scratch import Scratch

#: Width of the bins that windows go by.
BIN = 1 << 16
#: Rows of one side that a bin holds at most before it is dealt.
HEAVY = 4096
#: A bin of level l is 4 ** l bases wide; shorter ranges than those of the least level share its bins.
LEAST_LEVEL = 3
#: Heavy bins up to which their table is broadcast.
BROADCAST_ROWS = 500_000


def _islands(df: DataFrame, by: list[str], gap: int) -> DataFrame:
    """df with island: runs in which each range starts at most gap after the furthest end before it."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge(df: DataFrame, keys: list[str], gap: int = 0, sums: dict[str, Column] | None = None, bin_width: int = BIN) -> DataFrame:
    """keys, start, end and the sums of each run of ranges that overlap, touch or are at most gap apart. Empty ranges are dropped.

    sums: name to a Column that is added up over a run. The runs within bins
    are written, as they are needed twice, so df is read once.
    """
    sums = sums or {}
    rows = df.where("start < end").select(*keys, "start", "end", *[c.alias(n) for n, c in sums.items()])
    by = [*keys, "__bin"]
    total = [F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(n).alias(n) for n in sums]]
    runs = _islands(_binned(rows, bin_width), by, gap).groupBy(*by, "island").agg(*total).drop("island")
    runs = Scratch(df.sparkSession, "merge").save(runs, "runs")

    # the runs of a bin are apart, so its last one reaches furthest; one that no bin before it reaches begins an island
    earlier = _earlier(keys)
    bins = runs.groupBy(*by).agg(F.max("start").alias("__last"), F.max("end").alias("__reach"))
    bins = bins.withColumn("__before", F.max("__reach").over(earlier))
    fresh = lambda c: F.col("__before").isNull() | (F.col(c) > F.col("__before") + gap)
    bins = bins.withColumn("__open", F.last(F.when(fresh("__last"), F.col("__last")), ignorenulls=True).over(earlier))
    joined = runs.join(bins.select(*by, "__before", "__open"), by)
    joined = joined.withColumn("__island", F.when(fresh("start"), F.col("start")).otherwise(F.col("__open")))
    return joined.groupBy(*keys, "__island").agg(*total).drop("__island")


def _binned(df: DataFrame, width: int, at: str = "start") -> DataFrame:
    return df.withColumn("__bin", F.floor(F.col(at) / width))


def _earlier(keys: list[str]) -> WindowSpec:
    """The bins of a key before a bin."""
    return Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)


def merge_weighted(df: DataFrame, keys: list[str], gap: int, value: str, bin_width: int = BIN) -> DataFrame:
    """keys, start, end, value: runs as of merge; the run's value is its length times the mean density of its ranges, cut to a whole number."""
    out = merge(df, keys, gap, {"__v": F.col(value), "__n": F.col("end") - F.col("start")}, bin_width)
    return out.select(*keys, "start", "end", F.floor((F.col("end") - F.col("start")) * F.col("__v") / F.col("__n")).cast("bigint").alias(value))


def complement(runs: DataFrame, lengths: DataFrame, keys: list[str], least: int = 1, bin_width: int = BIN) -> DataFrame:
    """keys, start, end: what disjoint runs leave free of [0, length), in pieces of least bases at least. lengths: keys and length; keys without runs are free as a whole."""
    both = lengths.select(*keys, F.col("length").alias("start"), F.col("length").alias("end")).unionByName(runs.select(*keys, "start", "end"))
    both, by = _binned(both, bin_width), [*keys, "__bin"]
    bins = both.groupBy(*by).agg(F.max("end").alias("__reach"))
    bins = bins.select(*by, F.coalesce(F.max("__reach").over(_earlier(keys)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("__in", F.max("end").over(inside))
    gaps = within.join(bins, by).withColumn("__s", F.greatest("__in", "__before"))
    return gaps.select(*keys, F.col("__s").alias("start"), F.col("start").alias("end")).where(F.col("end") - F.col("start") >= max(1, least))


def _last(start: Column, end: Column) -> Column:
    """The last base of a range; empty ranges stand at their start."""
    return F.greatest(end - 1, start)


def level(start: Column, end: Column) -> Column:
    """The level of a range: 4 ** level is at least its length."""
    return F.greatest(_quarters(start, end), F.lit(LEAST_LEVEL))


def _quarters(start: Column, end: Column) -> Column:
    bits = F.length(F.bin((_last(start, end) - start).cast("bigint")))
    return F.floor((bits + 1) / 2).cast("int")


def down(at: Column, lev: Column) -> Column:
    """The bin of a base."""
    return F.call_function("shiftright", at.cast("bigint"), (lev * 2).cast("int"))


def _in_bins(df: DataFrame, start: str, end: Column, places: Column) -> DataFrame:
    """df with a row for each bin (__at: role, level, bin) of each of places (role, level)."""
    first, last = F.col(start), _last(F.col(start), end)
    bins = lambda p: F.transform(F.sequence(down(first, p["level"]), down(last, p["level"])), lambda b: F.struct(p["role"].alias("role"), p["level"].alias("level"), b.alias("bin")))
    return df.withColumn("__at", F.explode(F.flatten(F.transform(places, bins))))


def _place(role: int, lev: Column | int) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(lev) if isinstance(lev, int) else lev).alias("level"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "overlap", heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows with equal keys. left has keys, start, end; right keys, r_start, r_end; other columns need names of their own.

    how: overlap (a base in common), contains (the right range lies in the left one), stab (the left start lies in the right range).

    Both sides are read once beforehand to see which levels there are, and
    once more for the rows in each bin if one may hold over heavy. Blocks of a
    heavy bin are told by a hash of the whole row, so they come out alike when
    a task is run again.
    """
    end = F.col("start") + 1 if how == "stab" else F.col("end")
    conditions = {
        "overlap": (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")),
        "contains": (F.col("start") <= F.col("r_start")) & (F.col("r_end") <= F.col("end")) & (F.col("r_start") < F.col("r_end")),
        "stab": (F.col("r_start") <= F.col("start")) & (F.col("start") < F.col("r_end")),
    }
    own, r_own = level(F.col("start"), end), level(F.col("r_start"), F.col("r_end"))
    found = left.select(F.lit(0).alias("side"), own.alias("level")).unionByName(right.select(F.lit(1).alias("side"), r_own.alias("level"))).groupBy("side", "level").count().where("level is not null").collect()
    levels = [sorted(r.level for r in found if r.side == side) for side in (0, 1)]
    most = max((sum(r["count"] for r in found if r.side == side) for side in (0, 1)), default=0)

    # role 0: the left range is at its own level, the right one at its own or lifted; role 1: the left one is lifted
    above = lambda role, others, mine: F.filter(F.array(*[_place(role, x) for x in others]), lambda p: p["level"] > mine)
    none = F.array().cast("array<struct<role:int,level:int>>")
    places = F.concat(F.array(_place(0, own)), above(1, levels[1], own)) if levels[1] else none
    r_places = F.concat(F.array(_place(0, r_own), _place(1, r_own)), above(0, levels[0], r_own)) if levels[0] else none
    a, b, by = _in_bins(left, "start", end, places), _in_bins(right, "r_start", F.col("r_end"), r_places), [*keys, "__at"]
    if most > heavy:
        count = lambda df, x, y: df.select(*by, F.lit(x).alias("__a"), F.lit(y).alias("__b"))
        bins = count(a, 1, 0).unionByName(count(b, 0, 1)).groupBy(*by).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")).where(f"__a > 0 and __b > 0 and greatest(__a, __b) > {heavy}")
        parts = lambda c: F.ceil(F.col(c) / heavy).cast("bigint").alias(c)
        bins = Scratch(left.sparkSession, "overlap").save(bins.select(*by, parts("__a"), parts("__b")), "heavy")
        n = bins.count()
        if n:
            bins = F.broadcast(bins) if n <= BROADCAST_ROWS else bins
            every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(c), F.lit(1)) - 1))
            a = a.withColumn("__h", F.xxhash64(*left.columns)).join(bins, by, "left").withColumn("__i", F.pmod("__h", F.coalesce("__a", F.lit(1)))).withColumn("__j", every("__b"))
            b = b.withColumn("__h", F.xxhash64(*right.columns)).join(bins, by, "left").withColumn("__j", F.pmod("__h", F.coalesce("__b", F.lit(1)))).withColumn("__i", every("__a"))
            a, b, by = a.drop("__h", "__a", "__b"), b.drop("__h", "__a", "__b"), [*by, "__i", "__j"]
    first = F.greatest(down(F.col("start"), F.col("__at.level")), down(F.col("r_start"), F.col("__at.level")))
    return a.join(b, by).where(conditions[how] & (F.col("__at.bin") == first)).drop("__at", "__i", "__j")


def subtract(df: DataFrame, masks: DataFrame, keys: list[str], row: str, least: int = 1, bin_width: int = BIN) -> DataFrame:
    """The pieces of df's ranges outside of masks (keys, start, end): df's columns with start and end of a piece, and masked: whether a mask met the row.

    row names a column that tells df's rows apart.
    """
    flat = merge(masks, keys, 0, None, bin_width).select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = overlap_join(df.select(*keys, row, "start", "end"), flat, keys)
    held = met.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col("r_start").alias("s"), F.col("r_end").alias("e")))).alias("__m"))
    out = df.join(held, row, "left").withColumn("masked", F.col("__m").isNotNull())
    starts = F.concat(F.array("start"), F.transform(F.coalesce("__m", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda m: m["e"]))
    ends = F.concat(F.transform(F.coalesce("__m", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda m: m["s"]), F.array("end"))
    pieces = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda p: p["e"] - p["s"] >= least)
    cut = out.withColumn("__p", F.explode(pieces)).withColumn("start", F.col("__p.s")).withColumn("end", F.col("__p.e"))
    return cut.drop("__m", "__p")


def cut_at_ends(df: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """df's rows in pieces (piece_start, piece_end) cut at every start and end of any range of the key, so that pieces are equal or disjoint.

    row names columns that tell df's rows apart.
    """
    points = df.select(*keys, F.explode(F.array("start", "end")).alias("p")).distinct()
    at = points.select(*keys, F.col("p").alias("r_start"), (F.col("p") + 1).alias("r_end"))
    inner = overlap_join(df, at, keys)
    rest = [c for c in df.columns if c not in row]
    cuts = inner.groupBy(*row).agg(F.sort_array(F.collect_set("r_start")).alias("__c"), *[F.first(c).alias(c) for c in rest])
    piece = F.transform(
        F.sequence(F.lit(0), F.size("__c") - 1), lambda i: F.struct(F.get(F.col("__c"), i).alias("s"), F.coalesce(F.get(F.col("__c"), i + 1), F.col("end")).alias("e"))
    )
    out = cuts.select(*df.columns, F.explode(piece).alias("__p"))
    return out.select(*df.columns, F.col("__p.s").alias("piece_start"), F.col("__p.e").alias("piece_end"))


def first_of_equal(pieces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each piece: the first by order."""
    rank = Window.partitionBy(*keys, "piece_start").orderBy(*order)
    return pieces.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


#: Positions of a cell that are swept together.
SWEEP = 1024


def longest_over(ranges: DataFrame, points: DataFrame, keys: list[str], sweep: int = SWEEP) -> DataFrame:
    """keys, p, longest: the length of the longest of ranges (keys, start, end) over each of points (keys, p, beyond), by a sweep without pairs.

    beyond is a length: ranges that are certainly no longer may be left out.
    Points that no range covers have no row.

    A range of level l, longer than a cell of 4 ** (l - 1) bases, covers of
    such a cell what lies after its start, what lies before its end, or all.
    So the longest one over a point is a running maximum, by start or from the
    other side by end, of ranges pre-aggregated by position. A sweep takes
    some positions of a cell, and takes over the maximum of the sweeps before
    it from a table with one row for each: ranges that pile up over one base
    are dealt to many tasks.
    """
    lev = _quarters(F.col("start"), F.col("end"))
    fine = ranges.where("start < end").select(*keys, "start", "end", lev.alias("__l")).groupBy(*keys, "__l", "start").agg(F.max("end").alias("end"))
    fine = Scratch(ranges.sparkSession, "sweep").save(fine, "ranges")
    levels = [r[0] for r in fine.select("__l").distinct().collect()]

    cell, width = F.col("__l") - 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__l") * 2 - 2)
    events = fine.select("*", F.explode(F.sequence(down(F.col("start"), cell), down(F.col("end") - 1, cell))).alias("__c"))
    from_start = F.col("start") > F.col("__c") * width
    stop = F.least("end", (F.col("__c") + 1) * width)
    at = F.when(from_start, F.col("start")).otherwise(-stop)
    events = events.select(*keys, "__l", "__c", (~from_start).alias("__side"), at.alias("__o"), F.lit(False).alias("__asks"), (F.col("end") - F.col("start")).alias("__n"))

    some = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= _quarters(F.lit(0), F.col("beyond")))
    asked = points.select(*keys, "p", F.explode(some).alias("__l")).withColumn("__c", down(F.col("p"), cell))
    # from the other side, ends before -p and points at -p - 1 keep the order of whole numbers
    sides = F.array(F.struct(F.lit(False).alias("s"), F.col("p").alias("o")), F.struct(F.lit(True).alias("s"), (-F.col("p") - 1).alias("o")))
    asked = asked.select(*keys, "__l", "__c", F.explode(sides).alias("x")).select(*keys, "__l", "__c", F.col("x.s").alias("__side"), F.col("x.o").alias("__o"), F.lit(True).alias("__asks"), F.lit(None).cast("bigint").alias("__n"))

    group = [*keys, "__l", "__c", "__side"]
    rows = events.unionByName(asked).groupBy(*group, "__o", "__asks").agg(F.max("__n").alias("__n")).withColumn("__sweep", F.floor(F.col("__o") / sweep))
    rows = Scratch(ranges.sparkSession, "sweep").save(rows, "rows")
    sweeps = rows.where("not __asks").groupBy(*group, "__sweep").agg(F.max("__n").alias("__n"))
    # a sweep hands on to all after it, those without ranges of their own included
    both = sweeps.withColumn("__asks", F.lit(False)).unionByName(rows.where("__asks").select(*group, "__sweep").distinct().withColumns({"__n": F.lit(None).cast("bigint"), "__asks": F.lit(True)}))
    before = Window.partitionBy(*group).orderBy("__sweep").rangeBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("__before", F.max("__n").over(before)).where("__asks").select(*group, "__sweep", "__before")
    within = Window.partitionBy(*group, "__sweep").orderBy("__o", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__n", F.max("__n").over(within)).where("__asks").join(carried, [*group, "__sweep"])
    p = F.when(F.col("__side"), -F.col("__o") - 1).otherwise(F.col("__o"))
    return local.select(*keys, p.alias("p"), F.greatest("__n", "__before").alias("longest")).where("longest is not null").groupBy(*keys, "p").agg(F.max("longest").alias("longest"))


def _without_shorter(near: places.Near) -> pa.Table:
    """The rows at home that no longer range overlaps: the longest range over their first or last base is no longer."""
    first, last = near.start, near.end - 1
    live = np.flatnonzero(near.live)
    points = np.unique(np.concatenate([first[live], last[live]]))
    i, j = np.searchsorted(points, first[live]), np.searchsorted(points, last[live])
    n = last[live] - first[live] + 1
    longest = places.largest_over(i, j, n, len(points))
    kept = near.home.copy()
    kept[live] &= np.maximum(longest[i], longest[j]) <= n if len(live) else True
    return near.table.filter(pa.array(kept)).drop_columns(["__live", "__bin", "__home"])


def drop_shorter(df: DataFrame, keys: list[str], sweep: int = SWEEP, most: int = places.MOST) -> DataFrame:
    """df without ranges that a strictly longer range of their key overlaps. Empty ranges overlap nothing and stay.

    Rows go once to their place and are told there. Keys with over most rows
    in one place are swept.
    """
    own = tuple(c for c in df.columns if c not in (*keys, "start", "end"))
    kept, crowded = places.near(df, keys, _without_shorter, places.schema_of(df), own, most)
    return kept if crowded is None else kept.unionByName(_drop_shorter_swept(crowded, keys, sweep))


def _drop_shorter_swept(df: DataFrame, keys: list[str], sweep: int) -> DataFrame:
    """As drop_shorter. A longer range that overlaps a range covers its first or its last base, so
    the longest ranges over these two tell; equal ranges are asked once.
    """
    each = df.where("start < end").select(*keys, "start", "end").distinct()
    n = F.col("end") - F.col("start")
    points = each.select(*keys, F.explode(F.array("start", F.col("end") - 1)).alias("p"), n.alias("n")).groupBy(*keys, "p").agg(F.min("n").alias("beyond"))
    longest = longest_over(each, points, keys, sweep)
    at = lambda c, name: longest.select(*keys, F.col("p").alias(c), F.col("longest").alias(name))
    asked = each.withColumn("__last", F.col("end") - 1).join(at("start", "__a"), [*keys, "start"]).join(at("__last", "__b"), [*keys, "__last"])
    beaten = asked.where(F.greatest("__a", "__b") > n).select(*keys, "start", "end")
    return df.join(beaten, [*keys, "start", "end"], "left_anti")


def padded(df: DataFrame, pad: int) -> DataFrame:
    return df.withColumn("start", F.col("start") - pad).withColumn("end", F.col("end") + pad)


def depth(df: DataFrame, keys: list[str], most: int | None = None, bin_width: int = BIN) -> DataFrame:
    """keys, start, end, depth: stretches of equal depth above 0; depth stops at most. Events are pre-aggregated by position."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d"))))
    events = df.where("start < end").select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    events, by = _binned(events, bin_width, "p"), [*keys, "__bin"]
    bins = events.groupBy(*by).agg(F.sum("d").alias("__d"), F.min("p").alias("__first"))
    onward = F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bin"))
    bins = bins.select(*by, F.coalesce(F.sum("__d").over(_earlier(keys)), F.lit(0)).alias("__before"), onward.alias("__next"))
    order = Window.partitionBy(*by).orderBy("p")
    now = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = events.withColumns({"__now": now, "__end": F.lead("p").over(order)}).join(bins, by)
    at = within.select(*keys, F.col("p").alias("start"), F.coalesce("__end", "__next").alias("end"), (F.col("__now") + F.col("__before")).alias("depth")).where("depth > 0")
    return at.withColumn("depth", F.least("depth", F.lit(most).cast("bigint"))) if most else at


def extent(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
