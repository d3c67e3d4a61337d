"""Chunks of queries against a plain version, one query after the other."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import partition, scan


def smooth(runs: list[dict], length: int, masked: int, least: float, chunk: int, softclip: bool) -> list[dict]:
    """Chunks of one query from its runs (contig, start, end, cover) in order of start; none if the best contig covers too little."""
    cover: dict[str, int] = {}
    for r in runs:
        cover[r["contig"]] = cover.get(r["contig"], 0) + r["cover"]
    best = min(cover, key=lambda c: (-cover[c], c))
    kept, clipped = [], 0
    for i, r in enumerate(runs):
        if r["contig"] == best:
            kept.append(r | {"clip": False})
            continue
        # a run of another contig is cut out if it is long and dense enough; ends of the query belong to it
        start, end = (0 if i == 0 else r["start"]), (length if i == len(runs) - 1 else r["end"])
        if r["end"] - r["start"] > chunk and r["cover"] / max(1, end - start) >= least:
            kept.append({"contig": r["contig"], "start": start, "end": end, "cover": r["cover"], "clip": True})
            clipped += end - start
    fused: list[dict] = []
    for r in kept:
        if fused and not r["clip"] and not fused[-1]["clip"] and r["start"] - fused[-1]["end"] < chunk:
            fused[-1] |= {"end": max(r["end"], fused[-1]["end"]), "cover": r["cover"] + fused[-1]["cover"]}
        else:
            fused.append(dict(r))
    top, out = cover[best], []
    for r in fused:
        if r["clip"] or r["end"] - r["start"] > min(chunk, int(length * least)):
            out.append(r)
        else:
            top -= r["cover"]
    if not out:
        return []
    soft = 0
    for side, first in (("start", True), ("end", False)):
        r = out[0] if first else out[-1]
        rest = r["start"] if first else length - r["end"]
        if r["clip"] or not softclip or rest <= chunk:
            r[side] = 0 if first else length
        else:
            soft += rest
    for a, b in zip(out, out[1:], strict=False):
        # pieces of the best contig reach to their neighbours
        if not b["clip"] and (a["clip"] or b["start"] > a["end"]):
            b["start"] = a["end"]
        elif not a["clip"]:
            a["end"] = b["start"]
    merged = [out[0]]
    for r in out[1:]:
        if r["contig"] == merged[-1]["contig"] and r["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(r["end"], merged[-1]["end"])
        else:
            merged.append(r)
    whole = max(length - max(masked, soft) - clipped, top)
    return merged if whole > 0 and top / whole > least else []


def some_runs(rnd):
    """Disjoint runs of each contig, as coverage gives them; those of two contigs may overlap."""
    rows = []
    for q in range(25):
        length = rnd.choice([3000, 10_000])
        for contig in "abc"[: rnd.randint(1, 3)]:
            at = rnd.choice([0, rnd.randint(1, 900)])
            while True:
                n = rnd.choice([5, 20, 60, 150, 400, 900])
                if at + n > length or rnd.random() < 0.1:
                    break
                rows.append((f"q{q}", length, contig, at, at + n, rnd.randint(0, n)))
                at += n + rnd.choice([1, 10, 80, 500])
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("softclip", [False, True])
def test_against_plain(spark, seed, softclip):
    rnd = random.Random(seed)
    rows, chunk = some_runs(rnd), 100
    masks = {f"q{q}": rnd.choice([0, 100, 1400, 9000]) for q in range(0, 25, 2)}
    thresholds, last = [(5000, 0.3)], 0.1
    exp = []
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        left = [r for r in mine if not any(o[3] < r[4] and r[3] < o[4] and o[4] - o[3] > r[4] - r[3] for o in mine)]
        runs = [dict(zip(("contig", "start", "end", "cover"), r[2:], strict=True)) for r in sorted(left, key=lambda r: (r[3], r[4], r[2]))]
        length = mine[0][1]
        hidden = masks.get(q, 0) if masks.get(q, 0) < length / 2 else 0
        least = 0.3 if length < 5000 else 0.1
        exp += [(q, length, r["contig"], r["start"], r["end"]) for r in smooth(runs, length, hidden, least, chunk, softclip)]
    coverage = spark.createDataFrame(rows, "query_name string, query_len long, contig string, start long, end long, cover long")
    masked = spark.createDataFrame(list(masks.items()), "name string, masked long")
    got = partition.smooth_chunks(coverage, masked, thresholds, last, chunk, softclip).collect()
    assert sorted(map(tuple, got)) == sorted(exp) and exp


def test_no_runs(spark):
    none = spark.createDataFrame([], "query_name string, query_len long, contig string, start long, end long, cover long")
    assert partition.smooth_chunks(none).count() == 0


def test_scans_over_ranges(spark):
    """Neighbours and carried values over ranges, some of them of one key alone."""
    rnd = random.Random(5)
    rows = sorted({(rnd.choice("aaaab"), rnd.randint(0, 3000)) for _ in range(1500)})
    df = spark.createDataFrame(rows, "k string, at long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scan.laid_out(df, ["k", "at"])
        assert out.select("__part").distinct().count() > 5
        out = scan.beside(scan.beside(out, ["k", "at"], ["k", "at"], "p"), ["k", "at"], ["at"], "n", ahead=True)
        out = scan.carried(out, ["k", "at"], F.when(F.col("at") % 500 == 0, F.col("at")), "c").orderBy("k", "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last = None
    for i, r in enumerate(out):
        last = r["at"] if r["at"] % 500 == 0 else last
        assert (r["k"], r["at"]) == rows[i] and r["c"] == last
        assert (tuple(r["p"]) if i else None) == (rows[i - 1] if i else None)
        assert (r["n"].at if r["n"] else None) == (rows[i + 1][1] if i + 1 < len(rows) else None)
