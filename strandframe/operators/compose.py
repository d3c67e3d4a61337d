"""Composition of alignments: targets that several queries share are replaced by one of these queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.operators import intervals, places
from strandframe.scratch import Scratch

#: What tells the blocks of a target apart, whichever row they are from.
BLOCK = ("target_name", "start", "end", "query_name", "query_len", "query_pos", "is_reverse")


def target_blocks(paf: DataFrame, row: str) -> DataFrame:
    """row, target_name, target_len, start, end, query_name, query_len, query_pos, is_reverse: a row for each run of paired bases, start and end on the target, query_pos its first query base."""
    back = F.col("strand") == "-"
    along = F.when(back, cigar.flip(F.col("cigar"))).otherwise(F.col("cigar"))
    b = paf.select(row, "target_name", "target_len", "query_name", "query_len", "query_start", "target_start", "target_end", back.alias("is_reverse"), F.explode(cigar.match_blocks(cigar.placed(along))).alias("b"))
    start = F.when(F.col("is_reverse"), F.col("target_end") - F.col("b.t1")).otherwise(F.col("target_start") + F.col("b.t0"))
    return b.select(
        row, "target_name", "target_len", start.alias("start"), (start + F.col("b.len")).alias("end"), "query_name", "query_len", (F.col("query_start") + F.col("b.q0")).alias("query_pos"), "is_reverse"
    )


def pieces_of(blocks: DataFrame, row: list[str]) -> DataFrame:
    """Blocks (row tells them apart) cut at all their ends, with the query position of each piece."""
    cut = intervals.cut_at_ends(blocks, ["target_name"], row)
    before = F.when(F.col("is_reverse"), F.col("end") - F.col("piece_end")).otherwise(F.col("piece_start") - F.col("start"))
    return cut.withColumn("piece_query", F.col("query_pos") + before)


def stable_of(pieces: DataFrame) -> DataFrame:
    """target_name, piece_start, piece_end and the query that stands for the piece: the first by name, then position. A minimum, so it is taken before the shuffle too."""
    first = pieces.groupBy("target_name", "piece_start").agg(F.min(F.struct("query_name", "piece_query", "is_reverse", "piece_end", "query_len")).alias("f"))
    return first.select("target_name", "piece_start", "f.piece_end", F.col("f.query_name").alias("s_name"), F.col("f.query_len").alias("s_len"), F.col("f.piece_query").alias("s_pos"), F.col("f.is_reverse").alias("s_reverse"))


def stable_mapping(blocks: DataFrame) -> DataFrame:
    """stable_of the pieces of blocks."""
    return stable_of(pieces_of(blocks.drop(*[c for c in blocks.columns if c not in BLOCK]).distinct(), list(BLOCK)))


def _by_place(paf: DataFrame, *columns: str) -> DataFrame:
    """paf's rows with start and end of their cigars on the target, and b: their runs of paired bases in short numbers, from start and the query's start."""
    back = F.col("strand") == "-"
    along = F.when(back, cigar.flip(F.col("cigar"))).otherwise(F.col("cigar"))
    at = lambda b: F.when(back, F.col("target_end") - b["t1"]).otherwise(F.col("target_start") + b["t0"])
    rows = paf.withColumn("__b", F.transform(cigar.match_blocks(cigar.placed(along)), lambda b: F.struct(at(b).alias("s"), b["len"].alias("n"), b["q0"].alias("q"))))
    # not by the runs, so that the longest range is found without placing cigars
    span = cigar.target_span(F.col("cigar"))
    start = F.when(back, F.col("target_end") - span).otherwise(F.col("target_start"))
    end = start + F.greatest(span, F.lit(1))
    rows = rows.select(*columns, "target_name", "query_name", "query_len", "query_start", back.alias("is_reverse"), start.alias("start"), end.alias("end"), "__b")
    return rows.withColumn("b", F.transform("__b", lambda b: F.struct((b["s"] - F.col("start")).alias("s"), b["n"].alias("n"), b["q"].alias("q")))).drop("__b")


#: Rows of a place from which its target is cut by joins, and pieces that are looked at together.
CROWDED, PIECES = 1 << 15, 1 << 22


class _Tiles:
    """The runs of paired bases of whole places, points (all their ends), and stable: the run that stands for the piece from each point, -1 where none is."""

    def __init__(self, near: places.Near, most: int) -> None:
        self.most = most
        flat, sizes = near.lists("b")
        s, n, q = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "snq")
        self.row = row = np.repeat(np.arange(len(sizes)), sizes)
        self.lo = near.start[row] + s
        self.hi, self.first_query, self.back = self.lo + n, near.long("query_start")[row] + q, near.flag("is_reverse")[row]
        keep = near.live[row]
        # empty runs cut the others too
        self.points = np.unique(np.concatenate([self.lo[keep], self.hi[keep]]))
        self.first = np.searchsorted(self.points, self.lo)
        self.count = np.where(keep, np.searchsorted(self.points, self.hi) - self.first, 0)
        self.name = places.ranks(near.table.column("query_name"))[row]
        length = near.long("query_len")[row]
        self.stable = np.full(len(self.points), -1)
        for some in self.shares(np.arange(len(row)), np.arange(len(row))):
            run, at = self.pieces(some)
            met = np.unique(at)
            met = met[self.stable[met] >= 0]
            run, at = np.append(run, self.stable[met]), np.append(at, met)
            # the first by name, position, strand and length: what is not the least by one is out
            for value in (lambda r, x: self.name[r], self.query, lambda r, x: self.back[r].astype(np.int64), lambda r, x: length[r]):
                least, own = np.full(len(self.points), np.iinfo(np.int64).max), value(run, at)
                np.minimum.at(least, at, own)
                best = own == least[at]
                run, at = run[best], at[best]
            self.stable[at] = run

    def shares(self, runs: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        """runs in shares of some most pieces; those with equal numbers in whole, which do not fall, stay together."""
        share = (np.cumsum(self.count[runs]) - self.count[runs]) // self.most
        head = np.maximum.accumulate(np.where(np.append(True, whole[runs][1:] != whole[runs][:-1])[: len(runs)], np.arange(len(runs)), 0))
        return np.split(runs, np.flatnonzero(np.diff(share[head])) + 1) if len(runs) else []

    def pieces(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run and the first point of each piece."""
        n = self.count[runs]
        run = np.repeat(runs, n)
        return run, self.first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)

    def query(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first query base of a piece."""
        return self.first_query[run] + np.where(self.back[run], self.hi[run] - self.points[np.minimum(at + 1, len(self.points) - 1)], self.points[at] - self.lo[run])


def _stable_at_home(near: places.Near, pieces: int = PIECES) -> pa.Table:
    t = _Tiles(near, pieces)
    at = np.flatnonzero(t.stable >= 0)
    run = t.stable[at]
    base, bin_ = near.base[t.row[run]], near.bin[t.row[run]]
    here = np.flatnonzero((t.points[at] - base) // near.width == bin_)
    at, run, base = at[here], run[here], base[here]
    rows = pa.array(t.row[run])
    text = lambda c: near.table.column(c).take(rows).combine_chunks()
    return pa.table({
        "target_name": text("target_name"), "piece_start": t.points[at] - base, "piece_end": t.points[np.minimum(at + 1, len(t.points) - 1)] - base, "s_name": text("query_name"), "s_len": text("query_len"),
        "s_pos": t.query(run, at), "s_reverse": t.back[run],
    })


_STABLE = "target_name string, piece_start bigint, piece_end bigint, s_name string, s_len bigint, s_pos bigint, s_reverse boolean"


def stable_pieces(paf: DataFrame, row: str, most: int = CROWDED, pieces: int = PIECES) -> DataFrame:
    """stable_mapping of the target_blocks of paf, whose rows go once to their place on the target; targets with over most rows in one place are cut by joins."""
    found, crowded = places.near(_by_place(paf), ["target_name"], lambda near: _stable_at_home(near, pieces), _STABLE, (), most)
    if crowded is None:
        return found
    rest = paf.join(crowded.select("target_name").distinct(), "target_name", "left_semi")
    return found.unionByName(stable_mapping(target_blocks(rest, row)))


def _runs_at_home(row: str, cigars: bool, pieces: int = PIECES) -> Callable[[places.Near], Iterator[pa.Table]]:
    def f(near: places.Near) -> Iterator[pa.Table]:
        t = _Tiles(near, pieces)
        for some in t.shares(np.flatnonzero(near.home[t.row]), t.row):
            yield of_runs(near, t, some)

    def of_runs(near: places.Near, t: _Tiles, some: np.ndarray) -> pa.Table:
        own, at = t.pieces(some)
        order = np.lexsort((t.query(own, at), t.row[own]))
        own, at = own[order], at[order]
        of, by = t.row[own], t.stable[at]
        n, q0, t0 = t.points[np.minimum(at + 1, len(t.points) - 1)] - t.points[at], t.query(own, at), t.query(by, at)
        strand, name = t.back[own] != t.back[by], t.name[by]
        q1, t1 = q0 + n, t0 + n
        joins = np.zeros(len(own), bool)
        onward = np.where(strand[1:], t1[1:] <= t0[:-1], t0[1:] >= t1[:-1])
        joins[1:] = (of[1:] == of[:-1]) & (name[1:] == name[:-1]) & (name[1:] >= 0) & (strand[1:] == strand[:-1]) & (q0[1:] >= q1[:-1]) & onward
        begin = np.flatnonzero(~joins)
        run = np.cumsum(~joins) - 1
        # runs are numbered within a row
        fresh = np.ones(len(begin), bool)
        fresh[1:] = of[begin][1:] != of[begin][:-1]
        number = np.arange(len(begin)) - np.maximum.accumulate(np.where(fresh, np.arange(len(begin)), 0)) + 1
        total = lambda u, v: u.reduceat(v, begin) if len(begin) else np.zeros(0, np.int64)
        start, end = total(np.minimum, q0), total(np.maximum, q1)
        rows, stable = pa.array(of[begin]), pa.array(t.row[by][begin])
        text = lambda c, r: near.table.column(c).take(r).combine_chunks()
        out = {
            row: text(row, rows), "run": number, "query_name": text("query_name", rows), "query_len": text("query_len", rows), "query_start": start, "query_end": end,
            "strand": pa.array(np.where(strand[begin], "-", "+"), pa.string()), "target_name": text("query_name", stable), "target_len": text("query_len", stable),
            "target_start": total(np.minimum, t0), "target_end": total(np.maximum, t1), "num_matching": end - start, "num_bases": total(np.add, n),
        }
        if cigars:
            out["cigar"] = _cigars(run, begin, joins, strand, q0, q1, t0, t1, n)
        return pa.table(out)

    return f


def _cigars(run: np.ndarray, begin: np.ndarray, joins: np.ndarray, strand: np.ndarray, q0: np.ndarray, q1: np.ndarray, t0: np.ndarray, t1: np.ndarray, n: np.ndarray) -> pa.Array:
    """The cigar of each run: the bases before a piece as I and D, then its own as M; all the other way round on the reverse strand."""
    ins, gone = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    ins[1:], gone[1:] = q0[1:] - q1[:-1], np.where(strand[1:], t0[:-1] - t1[1:], t0[1:] - t1[:-1])
    sizes = np.stack([np.where(joins, ins, 0), np.where(joins, gone, 0), n], 1).ravel()
    of = np.repeat(run, 3)
    place = np.arange(len(sizes))
    first, last = begin * 3, np.append(begin[1:], len(n)) * 3 - 1
    place = np.where(np.repeat(strand, 3), first[of] + last[of] - place, place) if len(of) else place
    sizes, kinds = sizes[place], np.tile(np.array(["I", "D", "M"]), len(n))[place]
    some = sizes > 0
    ops = pa.StructArray.from_arrays([pa.array(kinds[some], pa.string()), pa.array(sizes[some])], ["op", "len"])
    return cigar.as_lists(ops, np.bincount(of[some], minlength=len(begin)), np.zeros(len(begin), bool))


def compose(paf: DataFrame, row: str, cigars: bool = True, most: int = CROWDED, pieces: int = PIECES) -> DataFrame:
    """PAF rows of each query against the queries that stand for its targets; the column cigar unless cigars is false.

    Every paired run is tiled by pieces; neighbours of one row on the same
    query and strand, in the same direction, join to one alignment, with the
    bases between as I and then D. num_matching is the query span and num_bases
    the paired bases. Rows go once to their place on the target; targets with
    over most rows in one place are cut by joins.
    """
    types = {f.name: f.dataType.simpleString() for f in paf.schema.fields}
    schema = f"`{row}` {types[row]}, run bigint, query_name string, query_len bigint, query_start bigint, query_end bigint, strand string, target_name string, target_len bigint, target_start bigint, target_end bigint, num_matching bigint, num_bases bigint"
    schema += f", cigar {cigar.CIGAR_TYPE}" if cigars else ""
    found, crowded = places.near(_by_place(paf, row), ["target_name"], _runs_at_home(row, cigars, pieces), schema, (row,), most)
    if crowded is None:
        return found
    rest = _compose_joined(paf.join(crowded.select("target_name").distinct(), "target_name", "left_semi"), row)
    return found.unionByName(rest.select(*found.columns))


def _compose_joined(paf: DataFrame, row: str) -> DataFrame:
    """As compose, by joins."""
    # pieces serve both sides, so they are made once
    pieces = Scratch(paf.sparkSession, "compose").save(pieces_of(target_blocks(paf, row), [row, "start"]), "pieces")
    tiles = pieces.join(stable_of(pieces), ["target_name", "piece_start", "piece_end"])
    n = F.col("piece_end") - F.col("piece_start")
    tiles = tiles.select(
        row, "query_name", "query_len", F.col("piece_query").alias("q0"), (F.col("piece_query") + n).alias("q1"), F.when(F.col("is_reverse") != F.col("s_reverse"), "-").otherwise("+").alias("strand"),
        "s_name", "s_len", F.col("s_pos").alias("t0"), (F.col("s_pos") + n).alias("t1"), n.alias("n"),
    )
    order = Window.partitionBy(row).orderBy("q0")
    was = {c: F.lag(c).over(order) for c in ("q1", "t0", "t1", "strand", "s_name")}
    onward = F.when(F.col("strand") == "+", F.col("t0") >= was["t1"]).otherwise(F.col("t1") <= was["t0"])
    joins = (was["s_name"] == F.col("s_name")) & (was["strand"] == F.col("strand")) & (F.col("q0") >= was["q1"]) & onward
    joins = F.coalesce(joins, F.lit(False))
    gap_t = F.when(F.col("strand") == "+", F.col("t0") - was["t1"]).otherwise(was["t0"] - F.col("t1"))
    marked = tiles.withColumn("ins", F.when(joins, F.col("q0") - was["q1"]).otherwise(0)).withColumn("del", F.when(joins, gap_t).otherwise(0)).withColumn("new", (~joins).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(row, "run", "query_name", "query_len", "strand", "s_name", "s_len").agg(
        F.min("q0").alias("query_start"), F.max("q1").alias("query_end"), F.min("t0").alias("target_start"), F.max("t1").alias("target_end"), F.sum("n").alias("paired"),
        F.array_sort(F.collect_list(F.struct("q0", "ins", "del", "n"))).alias("x"),
    )
    op = lambda o, v: F.struct(F.lit(o).alias("op"), v.alias("len"))
    ops = F.filter(F.flatten(F.transform("x", lambda x: F.array(op("I", x["ins"].cast("bigint")), op("D", x["del"].cast("bigint")), op("M", x["n"])))), lambda c: c["len"] > 0)
    back = F.flatten(F.transform(F.reverse("x"), lambda x: F.array(op("M", x["n"]), op("D", x["del"].cast("bigint")), op("I", x["ins"].cast("bigint")))))
    out = F.when(F.col("strand") == "-", F.filter(back, lambda c: c["len"] > 0)).otherwise(ops)
    return runs.select(
        row, "run", "query_name", "query_len", "query_start", "query_end", "strand", F.col("s_name").alias("target_name"), F.col("s_len").alias("target_len"), "target_start", "target_end",
        (F.col("query_end") - F.col("query_start")).alias("num_matching"), F.col("paired").alias("num_bases"), out.alias("cigar"),
    )
