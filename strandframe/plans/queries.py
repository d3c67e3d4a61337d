"""Queries over the alignments, masks and graphs that derived.py makes from the given tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar, names
from strandframe.operators import alignments as al
from strandframe.operators import compose, graph, intervals, minimizers, partition
from strandframe.plans import derived
from strandframe.plans.derived import WITH
from strandframe.sources import alignments as sources
from strandframe.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _islands(table: str, keys: str, gap: int, sums: str = "count(*) as n") -> str:
    """SQL of merged ranges: keys, s, e and sums from table with columns s, e."""
    return f"""(select {keys}, min(s) as s, max(e) as e, {sums} from (
        select *, sum(new) over (partition by {keys} order by s, e rows unbounded preceding) as g from (
        select *, case when s <= max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) + {gap} then 0 else 1 end as new from {table}))
        group by {keys}, g)"""


_BLOCKS = """, blk as (
    select query_name, query_start as s, query_start + a as e from aln where strand = '+'
    union all select query_name, query_start + a + b, query_start + a + b + c from aln where strand = '+'
    union all select query_name, query_start + a + b + c, query_end from aln where strand = '+'
    union all select query_name, query_start, query_start + e + c from aln where strand = '-'
    union all select query_name, query_start + e + c + b, query_end from aln where strand = '-')"""
_RUNS = _BLOCKS + f", runs as (select * from {_islands('blk', 'query_name', 0)})"
_GAPS = _RUNS + """, gaps as (
    select query_name, coalesce(lag(e) over (partition by query_name order by s), 0) as s, s as e from runs
    union all select query_name, max(e), 1000000 from runs group by query_name)"""


@query(WITH + _GAPS + """
    select r.query_name, cast(1000000 as bigint) as length, cast(r.covered as bigint) as covered, r.covered / 1000000.0::double as coverage, cast(g.max_gap as bigint) as max_gap,
        cast(g.gap_sum // g.n_gaps as bigint) as avg_gap, g.n_gaps
    from (select query_name, sum(e - s) as covered from runs group by query_name) r
    join (select query_name, max(e - s) as max_gap, sum(e - s) as gap_sum, count(*) as n_gaps from gaps where e > s group by query_name) g using (query_name)""")  # fmt: skip
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.coverage_summary(derived.alignments(spark, sf_dir))


@query(WITH + _GAPS + " select query_name, cast(s as bigint) as start, cast(e as bigint) as \"end\", 'coverage-gap-m50' as label from gaps where e - s >= 50")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.coverage_gaps(derived.alignments(spark, sf_dir), 50)


@query(WITH + """
    select aln_id, tp = 'S' as secondary, concat('cigar: ', query_name, ' ', case when strand = '-' then query_end else query_start end, ' ', case when strand = '-' then query_start else query_end end, ' ', strand, ' ',
        target_name, ' ', target_start, ' ', target_end, ' + ', mapq, ' M ', a, ' I ', b, ' M ', c, ' D ', d, ' M ', e) as value from aln""")  # fmt: skip
def paf_to_lastz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.to_lastz(derived.alignments(spark, sf_dir)).select("aln_id", "secondary", "value")


@query(WITH + """
    select op, count(*) as n_ops, cast(sum(len) as bigint) as bases from (
        select 'M' as op, a as len from aln union all select 'I', b from aln union all select 'M', c from aln union all select 'D', d from aln union all select 'M', e from aln) group by op""")  # fmt: skip
def cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = derived.alignments(spark, sf_dir).select(F.explode(cigar.parse(F.col("cg"))).alias("c"))
    return ops.groupBy(F.col("c.op").alias("op")).agg(F.count(F.lit(1)).alias("n_ops"), F.sum("c.len").alias("bases"))


@query(WITH + """
    select query_name, cast(sum(a + b + c + e) as bigint) as query_bases, cast(sum(a + c + d + e) as bigint) as target_bases, cast(sum(a + c + e) as bigint) as matches,
        cast(sum(case when b < 5 then b else 0 end) as bigint) as small_gaps from aln group by query_name""")  # fmt: skip
def cigar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    each = derived.alignments(spark, sf_dir).select("query_name", cigar.query_span(c).alias("q"), cigar.target_span(c).alias("t"), cigar.total(c, "M", "=", "X").alias("m"), cigar.small_gap_bases(c, 5).alias("g"))
    return each.groupBy("query_name").agg(F.sum("q").alias("query_bases"), F.sum("t").alias("target_bases"), F.sum("m").alias("matches"), F.sum("g").alias("small_gaps"))


_RANGES = ", rng as (select query_name, query_start as s, query_end as e from aln)"


@query(WITH + _RANGES + f" select query_name, s as start, e as \"end\", n from {_islands('rng', 'query_name', 100)}")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.alignments(spark, sf_dir).select("query_name", F.col("query_start").alias("start"), F.col("query_end").alias("end"))
    return intervals.merge(rows, ["query_name"], 100, {"n": F.lit(1)})


def _flat(pad: int) -> str:
    return f", rawm as (select query_name, m_start as s, m_end as e from mask), flat as (select * from {_islands('rawm', 'query_name', pad)})"


_PIECES = """, met as (select a.aln_id, a.query_start as qs, a.query_end as qe, f.s as ms, f.e as me from aln a join flat f on a.query_name = f.query_name and a.query_start < f.e and f.s < a.query_end),
    raw as (select aln_id, coalesce(lag(me) over (partition by aln_id order by ms), qs) as s, ms as e from met union all select aln_id, max(me), max(qe) from met group by aln_id),
    pieces as (select aln_id, s, e, true as masked from raw where e - s >= {least}
        union all select aln_id, query_start, query_end, false from aln where aln_id not in (select aln_id from met) and query_end - query_start >= {least})"""


@query(WITH + _flat(0) + _PIECES.format(least=1) + ' select aln_id, s as start, e as "end", masked from pieces')
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.alignments(spark, sf_dir).select("aln_id", "query_name", F.col("query_start").alias("start"), F.col("query_end").alias("end"))
    return intervals.subtract(rows, derived.masks(spark, sf_dir), ["query_name"], "aln_id").select("aln_id", "start", "end", "masked")


_OPS = """, ops as (
    select aln_id, 'M' as op, 0 as q0, a as q1, 0 as t0, a as t1 from aln where strand = '+'
    union all select aln_id, 'I', a, a + b, a, a from aln where strand = '+'
    union all select aln_id, 'M', a + b, a + b + c, a, a + c from aln where strand = '+'
    union all select aln_id, 'D', a + b + c, a + b + c, a + c, a + c + d from aln where strand = '+'
    union all select aln_id, 'M', a + b + c, a + b + c + e, a + c + d, a + c + d + e from aln where strand = '+'
    union all select aln_id, 'M', 0, e, 0, e from aln where strand = '-'
    union all select aln_id, 'D', e, e, e, e + d from aln where strand = '-'
    union all select aln_id, 'M', e, e + c, e + d, e + d + c from aln where strand = '-'
    union all select aln_id, 'I', e + c, e + c + b, e + d + c, e + d + c from aln where strand = '-'
    union all select aln_id, 'M', e + c + b, e + c + b + a, e + d + c, e + d + c + a from aln where strand = '-')"""


@query(WITH + _flat(100) + _PIECES.format(least=20) + _OPS + """, win as (
        select p.*, a.query_start as qs, a.target_start as ts, a.target_end as te, a.strand, p.s - a.query_start as ws, p.e - a.query_start as we from pieces p join aln a using (aln_id)),
    cut as (select w.aln_id, w.s, w.e, o.op, case when o.op = 'D' then o.t1 - o.t0 else least(o.q1, w.we) - greatest(o.q0, w.ws) end as len,
            case when o.op = 'M' then o.t0 + greatest(o.q0, w.ws) - o.q0 else o.t0 end as pos
        from win w join ops o on w.aln_id = o.aln_id and (case when o.op = 'D' then w.ws < o.q0 and o.q0 < w.we else least(o.q1, w.we) > greatest(o.q0, w.ws) end)),
    agg as (select aln_id, s, e, min(pos) as before, sum(case when op in ('M', 'D') then len else 0 end) as span, sum(case when op = 'M' then len else 0 end) as m, sum(case when op = 'I' then len else 0 end) as i from cut group by all)
    select w.aln_id, w.s as query_start, w.e as query_end, w.strand,
        cast(case when not w.masked then w.ts when w.strand = '-' then w.te - g.before - g.span else w.ts + g.before end as bigint) as target_start,
        cast(case when not w.masked then w.te when w.strand = '-' then w.te - g.before else w.ts + g.before + g.span end as bigint) as target_end,
        cast(g.m as bigint) as num_matching, cast(g.m + g.i as bigint) as num_bases, w.masked from win w join agg g on w.aln_id = g.aln_id and w.s = g.s and w.e = g.e""")  # fmt: skip
def mask_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = derived.masks(spark, sf_dir).withColumnRenamed("query_name", "name")
    out = al.mask_queries(derived.alignments(spark, sf_dir), bed, "aln_id", padding=100, least=20)
    return out.select("aln_id", "query_start", "query_end", "strand", "target_start", "target_end", "num_matching", "num_bases", "masked")


def _dominance(bad: str, extra: str = "") -> str:
    return WITH + f"""
    select aln_id, query_name from aln x where not exists (select 1 from aln y where x.query_name = y.query_name and x.aln_id <> y.aln_id
        and y.query_start < x.query_end and x.query_start < y.query_end {extra} and ({bad}))"""


#: x dominates y by a ratio of 2.
_WINS = """case when x.tp = 'P' and y.tp = 'S' then true when y.tp = 'P' and x.tp = 'S' then false
    when x.mapq / (y.mapq + 1e-6) >= 2 then true when y.mapq / (x.mapq + 1e-6) >= 2 then false when x.block_len / (y.block_len + 1e-6) >= 2 then true else false end"""


def _dominance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    paf = derived.alignments(spark, sf_dir)
    return paf.withColumns({"matches": F.col("num_matching"), "rc": F.lit(None).cast("string"), "identity": F.col("num_matching") / F.col("block_len")})


@query(_dominance(f"not {_WINS}"))
def dominance_filter_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.dominance_filter(_dominance_rows(spark, sf_dir), "aln_id", ratio=2.0).select("aln_id", "query_name")


@query(_dominance("y.block_len >= 600"))
def dominance_filter_minlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.dominance_filter(_dominance_rows(spark, sf_dir), "aln_id", min_overlap_len=600).select("aln_id", "query_name")


@query(_dominance(f"not {_WINS} or y.block_len >= 900", """and y.mapq >= 10 and (y.query_len <= 100 or y.block_len >= 100) and (y.num_matching / y.block_len::double) >= 0.98
    and least(x.query_end, y.query_end) - greatest(x.query_start, y.query_start) >= 0.25 * x.block_len"""))  # fmt: skip
def dominance_filter_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dominance_rows(spark, sf_dir)
    return al.dominance_filter(rows, "aln_id", 2.0, 900, 0.25, 10, 100, 0.98).select("aln_id", "query_name")


def _aln_mask(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    left = derived.alignments(spark, sf_dir).select("query_name", F.col("query_start").alias("start"), F.col("query_end").alias("end"))
    right = derived.masks(spark, sf_dir).withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    met = intervals.overlap_join(left, right, ["query_name"], how)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return met.groupBy("query_name").agg(F.count(F.lit(1)).alias("pairs"), F.sum(shared).alias("bases"))


_PAIRS = WITH + """ select query_name, count(*) as pairs, cast(sum(least(query_end, m_end) - greatest(query_start, m_start)) as bigint) as bases from aln join mask using (query_name) where {} group by query_name"""


@query(_PAIRS.format("query_start < m_end and m_start < query_end"))
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aln_mask(spark, sf_dir, "overlap")


@query(_PAIRS.format("query_start <= m_start and m_end <= query_end"))
def interval_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aln_mask(spark, sf_dir, "contains")


@query(_PAIRS.format("m_start <= query_start and query_start < m_end"))
def point_stab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aln_mask(spark, sf_dir, "stab")


@query(WITH + """ select aln_id, query_start as start, query_end as "end" from aln x where not exists (select 1 from aln y where x.query_name = y.query_name
    and y.query_start < x.query_end and x.query_start < y.query_end and y.query_end - y.query_start > x.query_end - x.query_start)""")  # fmt: skip
def drop_shorter_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.alignments(spark, sf_dir).select("aln_id", "query_name", F.col("query_start").alias("start"), F.col("query_end").alias("end"))
    return intervals.drop_shorter(rows, ["query_name"]).select("aln_id", "start", "end")


@query(WITH + """, ev as (select query_name, p, sum(d) as d from (select query_name, query_start as p, 1 as d from aln where block_len >= 200 union all select query_name, query_end, -1 from aln where block_len >= 200) group by all),
    run as (select query_name, p as s, lead(p) over (partition by query_name order by p) as e, sum(d) over (partition by query_name order by p) as k from ev)
    select query_name, s as start, e as "end", cast(least(k, 3) as bigint) as depth from run where k > 0""")  # fmt: skip
def query_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.query_depth(derived.alignments(spark, sf_dir), 200)


@query(WITH + """, r as (select aln_id, concat('chr', cast(cast(floor(cast(substr(target_name, 2) as bigint) / 10) as bigint) as varchar)) as contig, query_start % 900 as s, query_start % 900 + 150 as e from aln)
    select aln_id, contig, count(*) as n_nodes, min(node_id) as first_node, max(node_id) as last_node from r join seg on contig = sn and so < e and s < so + length group by all""")  # fmt: skip
def asof_node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    contig = F.concat(F.lit("chr"), F.floor(F.substring("target_name", 2, 20).cast("bigint") / 10).cast("string"))
    at = F.col("query_start") % 900
    ranges = derived.alignments(spark, sf_dir).select("aln_id", contig.alias("contig"), at.alias("start"), (at + 150).alias("end"))
    met = graph.node_lookup(ranges, graph.stable_index(derived.segments(spark, sf_dir)))
    return met.groupBy("aln_id", "contig").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))


@query(WITH + """
    select aln_id, cast(0 as bigint) as step, query_start, query_start + a + b + c as query_end, '+' as strand, target_name, cast(0 as bigint) as target_start, a + c as target_end, a + c as num_matching, a + b + c as num_bases, concat(a, 'M', b, 'I', c, 'M') as cg from aln
    union all select aln_id, 1, query_start + a + b + c, query_end, '-', concat(target_name, 'x'), 10, 10 + d + e, e, d + e, concat(e, 'M', d, 'D') from aln""")  # fmt: skip
def path_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    paf = derived.alignments(spark, sf_dir)
    step = lambda name, back, lo, hi: F.struct(name.alias("name"), F.lit(back).alias("is_reverse"), F.lit(True).alias("is_stable"), F.lit(True).alias("is_interval"), lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end"))
    first, second = F.col("a") + F.col("c"), F.col("d") + F.col("e")
    path = F.array(step(F.col("target_name"), False, F.lit(0), first), step(F.concat("target_name", F.lit("x")), True, F.lit(10), second + 10))
    gaf = paf.withColumns({"path": path, "strand": F.lit("+"), "path_len": first + second, "path_start": F.lit(0).cast("bigint"), "path_end": first + second, "matches": F.col("num_matching")})
    targets = paf.select("target_name").distinct()
    lengths = targets.select(F.explode(F.array("target_name", F.concat("target_name", F.lit("x")))).alias("name"), F.lit(1000000).cast("bigint").alias("length"))
    out = al.gaf_to_paf(gaf, lengths, "aln_id")
    return out.select("aln_id", F.col("step").cast("bigint").alias("step"), "query_start", "query_end", "strand", "target_name", "target_start", "target_end", "num_matching", "num_bases", cigar.to_text(F.col("cigar")).alias("cg"))


_TBLK = """, tb as (select aln_id, target_name, query_name, 1000000 as query_len, strand = '-' as rev, target_start + t0 as s, target_start + t1 as e, case when strand = '-' then query_end - q1 else query_start + q0 end as qp from (
        select aln.*, 0 as q0, a as q1, 0 as t0, a as t1 from aln union all select aln.*, a + b, a + b + c, a, a + c from aln union all select aln.*, a + b + c, a + b + c + aln.e, a + c + d, a + c + d + aln.e from aln)),
    ub as (select distinct target_name, s, e, query_name, rev, qp from tb),
    pts as (select distinct target_name, p from (select target_name, s as p from ub union all select target_name, e from ub)),
    pc as (select *, coalesce(lead(ps) over (partition by target_name, s, e, query_name, rev, qp order by ps), e) as pe from (select ub.*, p as ps from ub join pts using (target_name) where p >= s and p < e)),
    pq as (select *, qp + case when rev then e - pe else ps - s end as pqry from pc),
    sm as (select target_name, ps, pe, query_name as s_name, pqry as s_pos, rev as s_rev from (select *, row_number() over (partition by target_name, ps order by query_name, pqry, rev) as r from pq) where r = 1)"""


@query(WITH + _TBLK + " select target_name, cast(ps as bigint) as piece_start, cast(pe as bigint) as piece_end, s_name, cast(s_pos as bigint) as s_pos, s_rev as s_reverse from sm")
def stable_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.stable_pieces(derived.alignments(spark, sf_dir), "aln_id").drop("s_len")


@query(WITH + _TBLK + """, tl as (select p.aln_id, p.query_name, p.qp + case when p.rev then p.e - s2.pe else s2.ps - p.s end as q0, s2.pe - s2.ps as n, case when p.rev <> s2.s_rev then '-' else '+' end as strand, s2.s_name, s2.s_pos as t0
        from tb p join sm s2 on p.target_name = s2.target_name and s2.ps >= p.s and s2.ps < p.e),
    w as (select *, lag(q0 + n) over o as lq, lag(t0) over o as lt0, lag(t0 + n) over o as lt1, lag(strand) over o as ls, lag(s_name) over o as ln from tl window o as (partition by aln_id order by q0)),
    g as (select *, sum(case when ln = s_name and ls = strand and q0 >= lq and (case when strand = '+' then t0 >= lt1 else t0 + n <= lt0 end) then 0 else 1 end) over (partition by aln_id order by q0) as run from w)
    select aln_id, cast(run as bigint) as run, query_name, strand, s_name as target_name, cast(min(q0) as bigint) as query_start, cast(max(q0 + n) as bigint) as query_end, cast(min(t0) as bigint) as target_start, cast(max(t0 + n) as bigint) as target_end, cast(sum(n) as bigint) as num_bases
    from g group by all""")  # fmt: skip
def alignment_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compose.compose(derived.alignments(spark, sf_dir), "aln_id", cigars=False)
    return out.select("aln_id", F.col("run").cast("bigint").alias("run"), "query_name", "strand", "target_name", "query_start", "query_end", "target_start", "target_end", "num_bases")


_CONTIG = "concat('chr', cast(cast(substr(target_name, 2) as bigint) % 7 as varchar))"
_COVER = f""", cv as (select query_name, {_CONTIG} as contig, query_start as s, query_end as e, num_matching as v, query_end - query_start as n0 from aln),
    cover as (select query_name, contig, s, e, cast(floor((e - s) * v / n::double) as bigint) as cover from {_islands('cv', 'query_name, contig', 50, 'sum(v) as v, sum(n0) as n')})"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    contig = F.concat(F.lit("chr"), (F.substring("target_name", 2, 20).cast("bigint") % 7).cast("string"))
    return partition.contig_coverage(derived.alignments(spark, sf_dir).withColumn("contig", contig), gap=50)


@query(WITH + _COVER + ' select query_name, contig, s as start, e as "end", cover from cover')
def contig_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("query_name", "contig", "start", "end", "cover")


@query(WITH + _COVER + """, t as (select query_name, contig, cast(sum(cover) as bigint) as cover from cover group by all),
    m as (select query_name, sum(m_end - m_start) as masked from mask group by all),
    r as (select *, row_number() over (partition by query_name order by cover desc, contig) as r, coalesce(lead(cover) over (partition by query_name order by cover desc, contig), 0) as nxt from t),
    l as (select r.*, 1000000 - case when coalesce(m.masked, 0) < 500000 then coalesce(m.masked, 0) else 0 end as len from r left join m using (query_name) where r.r = 1)
    select query_name, case when cover / len::double < (case when len < 980000 then 0.03 else 0.06 end) or (nxt > 0 and cover < nxt * 1.05) then 'ambiguous' else contig end as contig, cast(cover as bigint) as cover, cast(nxt as bigint) as next from l""")  # fmt: skip
def contig_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = derived.masks(spark, sf_dir).groupBy(F.col("query_name").alias("name")).agg(F.sum(F.col("end") - F.col("start")).alias("masked"))
    out = partition.assign(_coverage(spark, sf_dir), masked, [(980000, 0.03)], 0.06, 1.05)
    return out.select("query_name", "contig", "cover", "next")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.smooth_chunks(_coverage(spark, sf_dir), None, [], 0.001, 2000)


@query(WITH + _COVER + """, runs as (select c.* from cover c where not exists (select 1 from cover d where d.query_name = c.query_name and d.s < c.e and c.s < d.e and d.e - d.s > c.e - c.s)),
    best as (select query_name, first(contig order by c desc, contig) as best, max(c) as top from (select query_name, contig, sum(cover) as c from runs group by all) group by all),
    r1 as (select r.*, best, top, row_number() over w as k, count(*) over (partition by query_name) as n from runs r join best using (query_name) window w as (partition by query_name order by s, e, contig)),
    r2 as (select *, contig <> best as clip, case when contig <> best and k = 1 then 0 else s end as s2, case when contig <> best and k = n then 1000000 else e end as e2 from r1),
    kept as (select query_name, contig, s2 as s, e2 as e, cover, clip, top from r2 where not clip or (e - s > 2000 and cover / greatest(1, e2 - s2)::double >= 0.001)),
    isl as (select *, sum(nw) over (partition by query_name order by s, e, contig) as g from (
        select *, case when not clip and not lag(clip) over w and s - lag(e) over w < 2000 then 0 else 1 end as nw from kept window w as (partition by query_name order by s, e, contig))),
    fus as (select query_name, g, min(contig) as contig, min(s) as s, max(e) as e, sum(cover) as cover, bool_or(clip) as clip, max(top) as top from isl group by query_name, g),
    fin as (select *, clip or e - s > 1000 as fine from fus),
    adj as (select query_name, max(top) - coalesce(sum(cover) filter (not fine), 0) as top, coalesce(sum(e - s) filter (clip), 0) as clipped from fin group by query_name),
    o1 as (select query_name, contig, clip, case when lag(s) over w is null then 0 else s end as s, case when lead(s) over w is null then 1000000 else e end as e from fin where fine window w as (partition by query_name order by s, e, contig)),
    o2 as (select *, lag(clip) over w as pc, lag(e) over w as pe, lead(clip) over w as nc, lead(s) over w as ns from o1 window w as (partition by query_name order by s, e, contig)),
    o3 as (select query_name, contig, s as o, case when not clip and (pc or s > pe) then pe else s end as s, case when ns is not null and not (not nc and (clip or ns > e)) and not clip then ns else e end as e from o2),
    o4 as (select *, sum(nw) over (partition by query_name order by o, e, contig) as g from (
        select *, case when lag(contig) over w = contig and s <= lag(e) over w then 0 else 1 end as nw from o3 window w as (partition by query_name order by o, e, contig)))
    select query_name, cast(1000000 as bigint) as query_len, min(contig) as contig, cast(min(s) as bigint) as start, cast(max(e) as bigint) as "end" from o4 join adj using (query_name)
    where greatest(1000000 - clipped, top) > 0 and top / greatest(1000000 - clipped, top)::double > 0.001 group by query_name, g""")  # fmt: skip
def smooth_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(WITH + """, ch as (select query_name, 'k' || i as contig, i * 250000 as cs, (i + 1) * 250000 as ce from (select distinct query_name from aln), range(4) t(i)),
    m as (select aln_id, count(*) as n, min(cs) as cs, min(ce) as ce, min(contig) as contig from aln join ch using (query_name) where query_start < ce and cs < query_end group by all)
    select aln_id, m.contig, concat(query_name, ':', m.cs + 1, '-', m.ce) as query_name, cast(250000 as bigint) as query_len, query_start - m.cs as query_start, query_end - m.cs as query_end from aln join m using (aln_id) where n = 1""")  # fmt: skip
def faidx_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    paf = derived.alignments(spark, sf_dir)
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    chunks = paf.select("query_name", "query_len").distinct().select("query_name", "query_len", i.alias("i"))
    chunks = chunks.select("query_name", "query_len", F.concat(F.lit("k"), F.col("i").cast("string")).alias("contig"), (F.col("i") * 250000).alias("start"), ((F.col("i") + 1) * 250000).alias("end"))
    return partition.rebase(partition.route(paf, chunks, "aln_id")).select("aln_id", "contig", "query_name", "query_len", "query_start", "query_end")


@query("with recursive " + WITH[5:] + """, ed as (select p_partkey as u, p_partkey + k as v from part, (values (1), (3)) t(k) where floor(p_partkey / 10) = floor((p_partkey + k) / 10) and p_partkey + k in (select p_partkey from part)),
    bo as (select u, v from ed union select v, u from ed), ways as (select u, v from bo join seg x on u = x.node_id join seg y on v = y.node_id where y.sr > 0 and x.sr <= y.sr),
    lab as (select node_id, sn as contig from seg where sr = 0 union select w.v, l.contig from lab l join ways w on l.node_id = w.u)
    select cast(node_id as bigint) as node_id, contig from lab""")  # fmt: skip
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived.segments(spark, sf_dir).select("node_id", F.col("sr").alias("rank"), F.col("sn").alias("contig"))
    return graph.label_nodes(nodes, derived.graph_edges(spark, sf_dir), strict=False)


@query(WITH + """, q as (select sn, cast(sum(length) as bigint) as query_len from seg where sr <= 1 group by sn)
    select sn as query_name, query_len, so as query_start, so + length as query_end, concat('t_', name) as target_name, length as target_len, concat(length, 'M') as cg from seg join q using (sn) where sr <= 1 and sn not in ('chr1', 'chr3')""")  # fmt: skip
def rank_filter_to_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = derived.segments(spark, sf_dir)
    ignore = seg.where(F.col("sn").isin("chr1", "chr3")).select(F.col("sn").alias("name"))
    out = graph.rgfa_to_paf(seg, None, 1, ignore, "t_")
    return out.select("query_name", "query_len", "query_start", "query_end", "target_name", "target_len", "cg")


@query(WITH + """, r as (select length, row_number() over (order by length desc, name) as k, sum(length) over (order by length desc, name) as s, sum(length) over () as t from seg)
    select (select count(*) from seg) as n, (select cast(sum(length) as bigint) from seg) as total, max(case when s >= t * 0.5 then length end) as n50, max(case when s >= t * 0.9 then length end) as n90,
        min(case when s >= t * 0.5 then k end) as l50, min(case when s >= t * 0.9 then k end) as l90 from r""")  # fmt: skip
def segment_stats_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.assembly_stats(derived.segments(spark, sf_dir).select("length"))


@query(WITH + """ select name, sn as contig from seg where sn in (select concat('chr', cast(s_suppkey as varchar)) from supplier)""")
def select_contigs_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("name"))
    return graph.select_contigs(derived.segments(spark, sf_dir).select("name", F.col("sn").alias("contig")), chosen)


@query(WITH + """ select name, case when sn in (select concat('chr', cast(s_suppkey as varchar)) from supplier) then sn else 'other' end as contig from seg""")
def relabel_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("contig"))
    return graph.relabel(derived.segments(spark, sf_dir).select("name", F.col("sn").alias("contig")), chosen, "other")


@query(WITH + " select query_name as name, cast(sum(m_end - m_start) as bigint) as masked from mask group by all")
def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandframe.sources.text import mask_totals as totals

    return totals(derived.masks(spark, sf_dir).withColumnRenamed("query_name", "name"))


@query(WITH + """ select aln_id, case when block_len < 200 then 0.9 when block_len < 600 then 0.5 else 0.25 end::double as least, concat(query_name, ':', query_start + 1, '-', query_end) as region,
    cast(substr(target_name, 2) as bigint) as node_id from aln""")  # fmt: skip
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paf = derived.alignments(spark, sf_dir)
    p = names.parse_subpath(names.make_subpath(F.col("query_name"), F.col("query_start"), F.col("query_end")))
    least = names.step(F.col("block_len"), [(200, 0.9), (600, 0.5)], 0.25)
    return paf.select("aln_id", least.alias("least"), names.make_subpath(p["name"], p["start"], p["end"]).alias("region"), names.node_id(F.col("target_name")).alias("node_id"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four minimizers for each alignment, 5, 7 and 9 bases apart, of 15 bases."""
    off = F.array(*[F.lit(x) for x in (5, 7, 9)])
    paf = derived.alignments(spark, sf_dir)
    t = F.col("target_start") % 2000
    return paf.select(
        "aln_id", "query_name", "query_len", "block_len", "mapq", (F.col("b") % 2).cast("int").alias("file_ord"), "target_name", (F.col("strand") == "-").alias("is_reverse"), F.lit(3000).cast("bigint").alias("target_len"),
        t.alias("t_start"), (t + 36).alias("t_end"), off.alias("t_off"), F.col("query_start").alias("q_start"), off.alias("q_off"), F.lit(15).cast("bigint").alias("kmer"),
    )


_HITS = """, h as (select aln_id, target_name, b % 2 as file_ord, strand = '-' as rev, target_start % 2000 as ts, mapq >= 20 as keep from aln),
    st as (select target_name, file_ord, keep, case when rev then 3000 - (ts + o) - 15 else ts + o end as pos from h, (values (0), (5), (12), (21)) v(o)),
    rg as (select target_name, file_ord, case when rev then 3000 - ts - 36 else ts end as s from h)"""


@query(WITH + _HITS + """, p as (select target_name, pos, sum(keep::int) as hits from st group by all)
    select target_name, pos, cast(hits as bigint) as hits, count(*) as cover from p join rg using (target_name) where s <= pos and pos < s + 36 group by all""")  # fmt: skip
def minimizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.counts_by_place(_hits(spark, sf_dir), F.col("mapq") >= 20)


@query(WITH + _HITS + """, p as (select target_name, file_ord, pos, sum(keep::int) as hits from st group by all),
    c as (select target_name, file_ord, pos, hits, count(*) as cover from p join rg using (target_name, file_ord) where s <= pos and pos < s + 36 group by all)
    select target_name, cast(file_ord as int) as file_ord, pos, cast(sum(hits) over o as bigint) as hits, cast(sum(cover) over o as bigint) as cover from c window o as (partition by target_name, pos order by file_ord)""")  # fmt: skip
def minimizer_counts_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.counts_by_place(_hits(spark, sf_dir), F.col("mapq") >= 20, by_file=True)


@query(WITH + """ select aln_id, cast(query_start as bigint) as query_start, cast(query_start + 36 as bigint) as query_end, strand,
    cast(case when strand = '-' then 3000 - target_start % 2000 - 36 else target_start % 2000 end as bigint) as target_start, cast(36 as bigint) as num_matching, '36M' as cg from aln""")  # fmt: skip
def chain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.struct("query_name", "query_len", F.col("mapq").cast("int").alias("mapq"), "aln_id")
    out = minimizers.to_paf(_hits(spark, sf_dir).withColumn("parent", parent).withColumn("query_name_", F.col("query_name")).withColumn("target_name", F.col("aln_id")))
    return out.select(F.col("target_name").alias("aln_id"), "query_start", "query_end", "strand", "target_start", "num_matching", cigar.to_text(F.col("cigar")).alias("cg"))


@query(WITH + """, h as (select aln_id, query_start as q, target_start % 2000 as t, strand, case when b % 3 = 1 then 79 when b % 3 = 2 then 32 else 36 end as te, b % 3 as kind from aln)
    select aln_id, cast(q + case when kind = 2 then 21 else 0 end as bigint) as query_start, cast(q + case when kind = 1 then 69 else 36 end as bigint) as query_end, strand,
        cast(case when strand = '-' then 3000 - t - te else t + case when kind = 2 then 17 else 0 end end as bigint) as target_start, cast(case kind when 1 then 44 when 2 then 15 else 36 end as bigint) as num_matching,
        case kind when 1 then case when strand = '-' then '24M35D25I20M' else '20M25I35D24M' end when 2 then '15M' else '36M' end as cg from h""")  # fmt: skip
def chain_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that go on, that have a gap on both sides, and whose block is taken away by a step back."""
    kind = F.col("b") % 3
    offs = lambda plain, gap, back: F.when(kind == 1, F.array(*map(F.lit, gap))).when(kind == 2, F.array(*map(F.lit, back))).otherwise(F.array(*map(F.lit, plain)))
    paf = derived.alignments(spark, sf_dir)
    t = F.col("target_start") % 2000
    hits = paf.select(
        F.struct("query_name", "query_len", F.col("mapq").cast("int").alias("mapq")).alias("parent"), F.col("aln_id").alias("target_name"), (F.col("strand") == "-").alias("is_reverse"), F.lit(3000).cast("bigint").alias("target_len"),
        t.alias("t_start"), offs((5, 7, 9), (5, 50, 9), (5, 3, 9)).alias("t_off"), F.col("query_start").alias("q_start"), offs((5, 7, 9), (5, 40, 9), (5, 7, 9)).alias("q_off"), F.lit(15).cast("bigint").alias("kmer"),
    )
    out = minimizers.to_paf(hits)
    return out.select(F.col("target_name").alias("aln_id"), "query_start", "query_end", "strand", "target_start", "num_matching", cigar.to_text(F.col("cigar")).alias("cg"))


@query(WITH + _HITS + """, p as (select target_name, pos, sum(keep::int) as hits from st group by all),
    c as (select target_name, pos, hits, count(*) as cover from p join rg using (target_name) where s <= pos and pos < s + 36 group by all),
    m as (select aln_id, target_name, i, case when rev then 3000 - (ts + o) - 15 else ts + o end as pos from h, (values (0, 0), (1, 5), (2, 12), (3, 21)) v(i, o))
    select aln_id, string_agg(case when hits / cover::double >= 0.5 and hits <= cover then '1' else '0' end, '' order by i) as ok from m left join c using (target_name, pos) group by aln_id""")  # fmt: skip
def universal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers at positions that at least half of the alignments over them have."""
    out = minimizers.universal_marks(_hits(spark, sf_dir), F.col("mapq") >= 20, "aln_id", 0.5)
    return out.select("aln_id", F.array_join(F.transform("ok", lambda x: x.cast("int").cast("string")), "").alias("ok"))


@query(WITH + """, ev as (select query_name, p, sum(d) as d from (select query_name, query_start as p, 1 as d from aln where block_len >= 200 union all select query_name, query_end, -1 from aln where block_len >= 200) group by all),
    run as (select query_name, p as s, lead(p) over (partition by query_name order by p) as e, sum(d) over (partition by query_name order by p) as k from ev),
    m as (select aln_id, query_name, block_len, i, query_start + o as ms from aln, (values (0, 0), (1, 5), (2, 12), (3, 21)) v(i, o)),
    bad as (select distinct aln_id, i from m join run using (query_name) where s < ms + 15 and ms < e and k > case when block_len >= 200 then 1 else 0 end)
    select m.aln_id, string_agg(case when bad.i is null then '1' else '0' end, '' order by m.i) as ok from m left join bad on m.aln_id = bad.aln_id and m.i = bad.i group by m.aln_id""")  # fmt: skip
def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers whose query bases no other alignment of 200 bases or more covers."""
    paf = derived.alignments(spark, sf_dir)
    out = minimizers.single_marks(_hits(spark, sf_dir), paf, "aln_id", 200)
    return out.select("aln_id", F.array_join(F.transform("ok", lambda x: x.cast("int").cast("string")), "").alias("ok"))


@query(ORACLE["path_explode"])
def path_explode_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of path_explode from GAF rows that are written on the reverse strand."""
    paf = derived.alignments(spark, sf_dir)
    step = lambda name, back, lo, hi: F.struct(name.alias("name"), F.lit(back).alias("is_reverse"), F.lit(True).alias("is_stable"), F.lit(True).alias("is_interval"), lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end"))
    first, second = F.col("a") + F.col("c"), F.col("d") + F.col("e")
    path = F.array(step(F.concat("target_name", F.lit("x")), False, F.lit(10), second + 10), step(F.col("target_name"), True, F.lit(0), first))
    gaf = paf.withColumns({"path": path, "cigar": F.reverse("cigar"), "strand": F.lit("-"), "path_len": first + second, "path_start": F.lit(0).cast("bigint"), "path_end": first + second, "matches": F.col("num_matching")})
    lengths = paf.select("target_name").distinct().select(F.explode(F.array("target_name", F.concat("target_name", F.lit("x")))).alias("name"), F.lit(1000000).cast("bigint").alias("length"))
    out = al.gaf_to_paf(gaf, lengths, "aln_id")
    return out.select("aln_id", F.col("step").cast("bigint").alias("step"), "query_start", "query_end", "strand", "target_name", "target_start", "target_end", "num_matching", "num_bases", cigar.to_text(F.col("cigar")).alias("cg"))


@query(WITH + """ select aln_id, query_name, query_len, query_start, query_end, strand, target_name, target_len, target_start, target_end, num_matching, num_bases, mapq, tp, cg, cast(a + b + c + e as bigint) as query_bases from aln""")
def paf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments printed as PAF and parsed again."""
    paf = derived.alignments(spark, sf_dir)
    lines = paf.withColumn("tags", F.concat("tags", F.array(sources.make_tag("id", "Z", F.col("aln_id"))))).select(sources.paf_line().alias("value"))
    rows = sources.parse_paf(lines)
    t = F.col("tags")
    return rows.select(sources.tag(t, "id").alias("aln_id"), *sources.PAF, sources.tag(t, "tp").alias("tp"), cigar.to_text(F.col("cigar")).alias("cg"), cigar.query_span(F.col("cigar")).alias("query_bases"))


@query(WITH + """ select aln_id, query_name, query_start, query_end, strand, concat('>', target_name, ':0-', a + c, '<', target_name, 'x:10-', 10 + d + e) as path, cast(2 as int) as steps, a + c + d + e as path_len,
    num_matching as matches, block_len, cast(mapq as int) as mapq, cg from aln""")  # fmt: skip
def gaf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments to paths printed as GAF and parsed again."""
    step = lambda name, back, lo, hi: F.struct(name.alias("name"), F.lit(back).alias("is_reverse"), F.lit(True).alias("is_stable"), F.lit(True).alias("is_interval"), lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end"))
    first, second = F.col("a") + F.col("c"), F.col("d") + F.col("e")
    path = F.array(step(F.col("target_name"), False, F.lit(0), first), step(F.concat("target_name", F.lit("x")), True, F.lit(10), second + 10))
    paf = derived.alignments(spark, sf_dir)
    gaf = paf.withColumns({"path": path, "path_len": first + second, "path_start": F.lit(0).cast("bigint"), "path_end": first + second, "matches": F.col("num_matching"), "tags": F.concat("tags", F.array(sources.make_tag("id", "Z", F.col("aln_id"))))})
    rows = sources.parse_gaf(gaf.select(sources.gaf_line().alias("value")))
    return rows.select(
        sources.tag(F.col("tags"), "id").alias("aln_id"), "query_name", "query_start", "query_end", "strand", sources.path_text(F.col("path")).alias("path"), F.size("path").alias("steps"), "path_len", "matches", "block_len", "mapq",
        cigar.to_text(F.col("cigar")).alias("cg"),
    )


@query(WITH + """ select count(*) as rows, cast(sum(num_matching) as bigint) as matches, cast(sum(num_bases) as bigint) as bases, count(distinct query_name) as queries, count(distinct target_name) as targets from aln""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_totals(derived.alignments(spark, sf_dir))


@query(WITH + """, t as (select count(*) as rows, sum(query_end - query_start) as bases, count(*) filter (where mapq >= 20) as rows_left, sum(query_end - query_start) filter (where mapq >= 20) as bases_left from aln)
    select rows, cast(bases as bigint) as bases, rows_left, cast(bases_left as bigint) as bases_left, cast(bases - bases_left as bigint) as bases_lost from t""")  # fmt: skip
def loss_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and query bases that a filter on mapq leaves and takes."""
    return sinks.loss_totals(derived.alignments(spark, sf_dir), F.col("mapq") >= 20)


@query(WITH + """ select name, case when node_id % 2 = 0 then length else length + 1 end as length from seg where node_id % 2 = 0 or node_id % 3 = 0""")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs that share some segments, of which those of the first count."""
    seg = derived.segments(spark, sf_dir).select("name", "node_id", "length")
    other = seg.where("node_id % 3 = 0").withColumn("length", F.col("length") + 1)
    return graph.merge_graphs(seg.where("node_id % 2 = 0"), other).select("name", "length")


@query(WITH + """, ch as (select query_name, min(query_start) as s, min(query_end) as e from aln where mapq >= 20 group by all),
    q as (select distinct query_name from aln)
    select query_name, cast(0 as bigint) as start, coalesce(s, 1000000) as "end", 'ambiguous' as contig from q left join ch using (query_name) where coalesce(s, 1000000) > 0
    union all select query_name, e, 1000000, 'ambiguous' from ch where e < 1000000""")  # fmt: skip
def unassigned_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one chunk of each query, where it has one, leaves free."""
    paf = derived.alignments(spark, sf_dir)
    chunks = paf.where("mapq >= 20").groupBy("query_name").agg(F.min("query_start").alias("start"), F.min("query_end").alias("end"))
    lengths = paf.groupBy("query_name").agg(F.max("query_len").alias("length"))
    return partition.unassigned(chunks, lengths)


@query(WITH + _flat(100) + _PIECES.format(least=20) + _OPS + """, win as (select p.*, p.s - a.query_start as ws, p.e - a.query_start as we from pieces p join aln a using (aln_id) where a.b = 3)
    select w.aln_id, cast(sum(least(o.q1, w.we) - greatest(o.q0, w.ws)) as bigint) as bases from win w join ops o on w.aln_id = o.aln_id and o.op = 'M' and least(o.q1, w.we) > greatest(o.q0, w.ws) group by w.aln_id""")  # fmt: skip
def fragment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bases of masked alignments that these did not have before: those of rows that are moved by one base on purpose."""
    paf = derived.alignments(spark, sf_dir)
    bed = derived.masks(spark, sf_dir).withColumnRenamed("query_name", "name")
    out = al.mask_queries(paf, bed, "aln_id", padding=100, least=20)
    moved = F.when(F.col("b") == 3, 1).otherwise(0)
    out = out.withColumns({"target_start": F.col("target_start") + moved, "target_end": F.col("target_end") + moved})
    return al.foreign_pairs(paf, out, "aln_id").groupBy("aln_id").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
