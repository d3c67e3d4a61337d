"""Table functions for SQL, called with lateral joins: a row's cigar goes in, the rows that it becomes come out.

    select a.*, c.* from alignments a, lateral paf_clip(a.cg, a.strand, a.query_start, a.target_start, a.target_end, a.from_base, a.to_base) c

The operators alignments.clip_query and alignments.gaf_to_paf do the same for
whole tables without Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_OP = re.compile(r"([0-9]+)([MIDNSHPX=])")
ON_QUERY, ON_TARGET, PAIRED = frozenset("MIS=X"), frozenset("MDN=X"), frozenset("M=X")
CLIPPED = "query_start: bigint, query_end: bigint, target_start: bigint, target_end: bigint, num_matching: bigint, num_bases: bigint, cg: string"
STEPS = "step: int, query_start: bigint, query_end: bigint, strand: string, target_name: string, target_start: bigint, target_end: bigint, num_matching: bigint, num_bases: bigint, cg: string"


def cut(ops: list[tuple[str, int]], start: int, end: int, by_target: bool) -> tuple[list[tuple[str, int]], int, int]:
    """Operations within a window of query or target, and the query and target bases before the first: those on the side that is cut are cut, others stay inside it (on the target, at its start as well)."""
    out, q, t, first = [], 0, 0, None
    for op, n in ops:
        at = t if by_target else q
        if op in (ON_TARGET if by_target else ON_QUERY):
            skip = max(0, start - at)
            held = min(n, end - at) - skip
            both = op in ON_QUERY and op in ON_TARGET
            where = (q + (skip if both or not by_target else 0), t + (skip if both or by_target else 0))
        else:
            held = n if (start <= at if by_target else start < at) and at < end else 0
            where = (q, t)
        if held > 0:
            out.append((op, held))
            first = first or where
        q, t = q + n * (op in ON_QUERY), t + n * (op in ON_TARGET)
    return out, *(first or (0, 0))


def _parsed(cg: str) -> list[tuple[str, int]]:
    return [(op, int(n)) for n, op in _OP.findall(cg)]


def _text(ops: list[tuple[str, int]]) -> str:
    return "".join(f"{n}{op}" for op, n in ops)


def _sum(ops: list[tuple[str, int]], kinds: frozenset[str]) -> int:
    return sum(n for op, n in ops if op in kinds)


@udtf(returnType=CLIPPED)
class PafClip:
    """A PAF row cut to the query window [start, end), as alignments.clip_query does; no row where a value is null."""

    def eval(self, cg: str, strand: str, query_start: int, target_start: int, target_end: int, start: int, end: int) -> Iterator[tuple]:
        if None in (cg, strand, query_start, target_start, target_end, start, end):
            return
        back = strand == "-"
        ops = _parsed(cg)
        kept, _, before = cut(ops[::-1] if back else ops, start - query_start, end - query_start, False)
        span = _sum(kept, ON_TARGET)
        at = target_end - before - span if back else target_start + before
        yield start, end, at, at + span, _sum(kept, PAIRED), _sum(kept, PAIRED | {"I"}), _text(kept[::-1] if back else kept)


@udtf(returnType=STEPS)
class GafSteps:
    """A row for each step of a GAF row's path that pairs bases, as alignments.gaf_to_paf gives for rows on the forward strand. steps are structs of name, is_reverse, start and end; no row where a value is null."""

    def eval(self, cg: str, query_start: int, path_start: int, path_end: int, steps: list) -> Iterator[tuple]:
        if None in (cg, query_start, path_start, path_end, steps):
            return
        ops, before = _parsed(cg), 0
        for i, s in enumerate(steps):
            size = s["end"] - s["start"]
            head = path_start if i == 0 else 0
            tail = before + size - path_end if i == len(steps) - 1 else 0
            kept, q, _ = cut(ops, before + head - path_start, before + size - tail - path_start, True)
            before += size
            if _sum(kept, frozenset("M=")):
                if s["is_reverse"]:
                    kept, head, tail = kept[::-1], tail, head
                at = query_start + q
                yield (
                    i, at, at + _sum(kept, ON_QUERY), "-" if s["is_reverse"] else "+", s["name"], s["start"] + head, s["end"] - tail,
                    _sum(kept, frozenset("M=")), sum(n for _, n in kept), _text(kept),
                )


def register(spark: SparkSession) -> None:
    spark.udtf.register("paf_clip", PafClip)
    spark.udtf.register("gaf_steps", GafSteps)
