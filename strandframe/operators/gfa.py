"""GFA1 as GFA2 and back: edges with ranges and ids, paths and ordered groups, nested groups, and lines of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.names import is_number
from strandframe.operators import scan
from strandframe.scratch import Scratch
from strandframe.sources import graphs
from strandframe.sources.text import ORDER


def _spans(alignment: Column) -> tuple[Column, Column]:
    """Bases of source and sink under an alignment: source is the side that D consumes. Null where it is no cigar."""
    ops = F.when(alignment.rlike("^([0-9]+[MIDNSHPX=])+$"), cigar.parse(alignment))
    return cigar.target_span(ops), cigar.query_span(ops)


def base_id(segments: DataFrame) -> DataFrame:
    """base: one more than the largest number among the names of segments, or their count where no name is a number. New edges are numbered behind it."""
    number = F.max(F.when(is_number(F.col("name")), F.col("name").try_cast("bigint")))
    return segments.agg((number + 1).alias("n"), F.count(F.lit(1)).alias("c")).select(F.coalesce("n", "c").alias("base"))


def numbered_edges(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """edges whose id is * with numbers behind base_id, in order of their lines: counted within ranges of lines, from the rows of the ranges before."""
    laid = scan.laid_out(edges.withColumn("__new", (F.col("id") == "*").cast("int")), ORDER)
    within = Window.partitionBy("__part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("__part").agg(F.sum("__new").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    base = base_id(segments).first().base
    out = laid.withColumn("__k", F.sum("__new").over(within)).join(F.broadcast(sizes), "__part")
    new = (F.lit(base) + F.col("__before") + F.col("__k")).cast("string")
    return out.withColumn("id", F.when(F.col("id") == "*", new).otherwise(F.col("id"))).select(*edges.columns)


def to_gfa2(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (of graphs.edges) with id, ranges and ends as GFA2 has them.

    A link lies at the end of its source and the start of its sink, a
    containment at its position in the source and over the sink; how far, the
    alignment tells (nothing where it is no cigar). Edges that have ranges keep
    them. An edge whose segment has no known length gets no $ there.
    """
    length = lambda c, name: segments.groupBy(F.col("name").alias(c)).agg(F.max("length").alias(name))
    both = edges.join(length("source", "__s"), "source", "left").join(length("sink", "__t"), "sink", "left")
    on_source, on_sink = (F.coalesce(c, F.lit(0).cast("bigint")) for c in _spans(F.col("alignment")))
    bare, link, inside = F.col("source_end").isNull(), F.col("type") == 1, F.col("type") == 2
    ranges = {
        "source_begin": F.when(bare & link, F.col("__s") - on_source).otherwise(F.col("source_begin")),
        "source_end": F.when(bare & link, F.col("__s")).when(bare & inside, F.col("source_begin") + on_source).otherwise(F.col("source_end")),
        "sink_begin": F.when(bare & (link | inside), F.lit(0).cast("bigint")).otherwise(F.col("sink_begin")),
        "sink_end": F.when(bare & (link | inside), on_sink).otherwise(F.col("sink_end")),
    }
    out = both.withColumn("__bare", bare).withColumns(ranges)
    at = [("source_begin", "__s"), ("source_end", "__s"), ("sink_begin", "__t"), ("sink_end", "__t")]
    ends = F.struct(*[F.coalesce(F.col(c) == F.col(n), F.lit(False)).alias(f"b{i}") for i, (c, n) in enumerate(at)])
    out = out.withColumn("ends", F.when(F.col("__bare"), ends).otherwise(F.col("ends"))).select(*edges.columns)
    return numbered_edges(out, segments)


def to_gfa1(edges: DataFrame) -> DataFrame:
    """Edges with their type by their ranges: 1 (link) if the source's range reaches its end and the sink's begins at 0 and does not fill it, 2 (containment) if the sink is filled from 0 to its end, else 3, which GFA1 cannot tell and graphs.edge_lines leaves out. Links and containments keep theirs."""
    starts = F.coalesce(F.col("sink_begin") == 0, F.lit(False))
    fills = starts & F.col("ends.b3") & ~F.col("ends.b2")
    kind = F.when(F.col("ends.b1") & starts & ~fills, 1).when(fills, 2).otherwise(3)
    return edges.withColumn("type", F.when(F.col("type") == 3, kind).otherwise(F.col("type")))


def paths_as_groups(paths: DataFrame) -> DataFrame:
    return paths.select(*ORDER, F.col("name").alias("id"), F.lit(True).alias("ordered"), F.col("segments").alias("items"), "forwards", "tags")


def flat_groups(groups: DataFrame) -> DataFrame:
    """groups whose items that are ordered groups themselves are replaced by these groups' items, in reverse and turned round where the item is, until none is left.

    A row for each item travels, so no long group stands in one task before the
    end. Each round opens one level. Groups that hold themselves raise.
    """
    scratch = Scratch(groups.sparkSession, "groups")
    items = lambda df: df.select("id", F.posexplode(F.arrays_zip("items", "forwards")).alias("rank", "x")).select("id", "rank", F.col("x.items").alias("item"), F.col("x.forwards").alias("forward"))
    ordered = scratch.save(groups.where("ordered").select(F.col("id").alias("item"), "items", "forwards"), "ordered")
    most = ordered.count()
    rows = scratch.save(items(groups).select("id", F.array("rank").alias("place"), "item", "forward"), "items")
    for _ in range(most + 1):
        if rows.join(ordered.select("item").distinct(), "item", "left_semi").isEmpty():
            break
        met = rows.join(ordered, "item", "left")
        open_ = F.when(F.col("items").isNull(), F.array(F.struct(F.lit(-1).alias("rank"), F.col("item").alias("item"), F.col("forward").alias("forward"))))
        # a turned item opens from its end
        n = F.size("items")
        sub = F.transform(F.arrays_zip("items", "forwards"), lambda x, i: F.struct(F.when(F.col("forward"), i).otherwise(n - 1 - i).alias("rank"), x["items"].alias("item"), (x["forwards"] == F.col("forward")).alias("forward")))
        each = met.select("id", "place", F.explode(open_.otherwise(sub)).alias("x"))
        place = F.when(F.col("x.rank") < 0, F.col("place")).otherwise(F.concat("place", F.array("x.rank")))
        rows = scratch.save(each.select("id", place.alias("place"), "x.item", "x.forward"), "items")
    else:
        raise ValueError("a group holds itself")
    held = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "item", "forward"))).alias("x"))
    out = groups.drop("items", "forwards").join(held, "id", "left")
    part = lambda name, kind: F.coalesce(F.transform("x", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    return out.withColumn("items", part("item", "string")).withColumn("forwards", part("forward", "boolean")).select(*groups.columns)


def groups_as_paths(groups: DataFrame, segments: DataFrame) -> DataFrame:
    """Paths of the ordered groups (of graphs.groups), nested ones opened; a step's overlap is as many M as its segment has bases, 0M where that is unknown. Unordered groups have no paths."""
    flat = flat_groups(groups).where("ordered")
    steps = flat.select("id", F.posexplode("items").alias("rank", "name"))
    own = segments.groupBy("name").agg(F.max(F.when(F.col("sequence") != "*", F.length("sequence"))).alias("n"))
    held = steps.join(own, "name", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    overlaps = F.coalesce(F.transform("x", lambda x: F.concat(x["n"].cast("string"), F.lit("M"))), F.array().cast("array<string>"))
    out = flat.join(held, "id", "left")
    return out.select(*ORDER, F.col("id").alias("name"), F.col("items").alias("segments"), "forwards", overlaps.alias("overlaps"), "tags")


def _signed(name: str, forward: str) -> Column:
    return F.concat(name, F.when(F.col(forward), "+").otherwise("-"))


def group_lines(groups: DataFrame) -> DataFrame:
    """O and U lines; the items of unordered groups have no signs."""
    signed = F.zip_with("items", "forwards", lambda s, f: F.concat(s, F.when(f, "+").otherwise("-")))
    items = F.array_join(F.when(F.col("ordered"), signed).otherwise(F.col("items")), " ")
    return groups.select(*ORDER, F.concat_ws("\t", F.when(F.col("ordered"), "O").otherwise("U"), "id", items, graphs._tag_text()).alias("value"))


def gap_lines(gaps: DataFrame) -> DataFrame:
    return gaps.select(*ORDER, F.concat_ws("\t", F.lit("G"), "id", "source", "sink", F.col("distance").cast("string"), F.coalesce("variance", F.lit("*")), graphs._tag_text()).alias("value"))


def fragment_lines(fragments: DataFrame) -> DataFrame:
    ranges = [F.col(c).cast("string") for c in ("seg_begin", "seg_end", "frag_begin", "frag_end")]
    return fragments.select(*ORDER, F.concat_ws("\t", F.lit("F"), "id", _signed("ref", "forward"), *ranges, F.coalesce("alignment", F.lit("*")), graphs._tag_text()).alias("value"))


def header_lines(headers: DataFrame, gfa: int) -> DataFrame:
    """An H line for each tag of the headers; the version is that of gfa."""
    val = F.when(F.col("key") == "VN", F.lit(f"{gfa}.0")).otherwise(F.col("val"))
    return headers.select(*ORDER, F.concat(F.lit("H\t"), F.concat_ws(":", "key", "type", val)).alias("value"))


def convert(graph: DataFrame, gfa: int) -> DataFrame:
    """block, file_ord, pos, value: the lines of a graph (of graphs.read_graph or format gfa) as GFA1 or GFA2. Sort by the first three.

    GFA1 has no gaps, fragments, unordered groups and edges of type 3; these
    are left out. What GFA2 calls ordered groups are GFA1's paths.
    """
    segments, edges, groups = graphs.segments(graph), graphs.edges(graph), graphs.groups(graph)
    own_paths = graphs.paths(graph.where("kind = 'P'"))
    parts = [header_lines(graphs.headers(graph), gfa), graphs.segment_lines(segments, gfa)]
    if gfa == 1:
        parts += [graphs.edge_lines(to_gfa1(edges), 1), graphs.path_lines(own_paths.unionByName(groups_as_paths(groups, segments)), 1)]
    else:
        parts += [graphs.edge_lines(to_gfa2(segments, edges), 2), group_lines(paths_as_groups(own_paths).unionByName(groups)), gap_lines(graphs.gaps(graph)), fragment_lines(graphs.fragments(graph))]
    out = None
    for i, part in enumerate(parts):
        rows = part.select(F.lit(i).alias("block"), *ORDER, "value")
        out = rows if out is None else out.unionByName(rows)
    return out
