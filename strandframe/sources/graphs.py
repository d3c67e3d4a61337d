"""Sequence graphs: rGFA, GFA1 and GFA2 lines as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.names import is_number, node_id
from strandframe.sources.alignments import tag, tags
from strandframe.sources.text import ORDER, read_lines

KINDS = {"H": "header", "S": "segment", "E": "edge", "L": "link", "C": "containment", "P": "path", "W": "walk", "G": "gap", "F": "fragment", "O": "ordered group", "U": "unordered group", "#": "comment", "x": "annotation", "a": "alignment"}


def read_graph(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of a graph with kind, their first character, and t, their fields."""
    lines = read_lines(spark, paths).where(F.trim("value") != "")
    return lines.select("*", F.substring("value", 1, 1).alias("kind"), F.split(F.rtrim("value"), "\t").alias("t"))


def _at(i: int) -> Column:
    return F.get("t", F.lit(i))


def _rest(i: int) -> Column:
    return tags(F.slice("t", i + 1, F.greatest(F.size("t"), F.lit(1))))


def line_kind(value: Column) -> Column:
    out = F.lit("unknown")
    for k, name in KINDS.items():
        out = F.when(F.substring(value, 1, 1) == k, name).otherwise(out)
    return out


def headers(graph: DataFrame) -> DataFrame:
    return graph.where("kind = 'H'").select(*ORDER, F.explode(_rest(1)).alias("tag")).select(*ORDER, "tag.*")


def version(graph: DataFrame) -> DataFrame:
    """version: of the first VN tag of a header; no row if there is none."""
    first = headers(graph).where("key = 'VN'").groupBy().agg(F.min_by("val", F.struct(*ORDER)).alias("v"))
    return first.where("v is not null").select(F.col("v").try_cast("double").alias("version"))


def segments(graph: DataFrame) -> DataFrame:
    """name, sequence, length, tags, sn, so, sr, node_id of S lines. A number in the third field is GFA2's length; LN counts where the sequence is *."""
    two = is_number(_at(2))
    rows = graph.where("kind = 'S'").select(
        *ORDER, _at(1).alias("name"), F.when(two, F.coalesce(_at(3), F.lit("*"))).otherwise(_at(2)).alias("sequence"), F.when(two, _at(2).try_cast("bigint")).alias("__n"), _rest(3).alias("tags")
    )
    own = F.when(F.col("sequence") != "*", F.length("sequence").cast("bigint"))
    t = F.col("tags")
    return rows.select(
        *ORDER, "name", "sequence", F.coalesce("__n", own, tag(t, "LN").try_cast("bigint")).alias("length"), "tags",
        tag(t, "SN").alias("sn"), tag(t, "SO").try_cast("bigint").alias("so"), tag(t, "SR").try_cast("bigint").alias("sr"), node_id(F.col("name")).alias("node_id"),
    )


def edges(graph: DataFrame) -> DataFrame:
    """id, type (1 link, 2 containment, 3 other), source, sink, source_fwd, sink_fwd, their ranges, ends ($ marks), alignment, tags of L, C and E lines."""
    nul, yes = F.lit(None), lambda i: _at(i) == "+"
    name2 = lambda i: F.regexp_replace(_at(i), "[+-]$", "")
    big = lambda c: F.regexp_replace(c, r"\$$", "").try_cast("bigint")
    link, contained, edge = F.col("kind") == "L", F.col("kind") == "C", F.col("kind") == "E"
    pick = lambda old, new: F.when(edge, new).otherwise(old)
    ends = F.struct(*[F.when(edge, F.coalesce(_at(i).endswith("$"), F.lit(False))).otherwise(F.lit(False)).alias(f"b{i - 4}") for i in (4, 5, 6, 7)])
    exact = F.when(edge, (_at(5).endswith("$")) & big(_at(6)).eqNullSafe(F.lit(0)))
    return graph.where("kind in ('L', 'C', 'E')").select(
        *ORDER,
        F.when(edge, _at(1)).otherwise("*").alias("id"),
        F.when(link, 1).when(contained, 2).when(exact, 1).otherwise(3).alias("type"),
        pick(_at(1), name2(2)).alias("source"), pick(_at(3), name2(3)).alias("sink"),
        pick(yes(2), ~_at(2).endswith("-")).alias("source_fwd"), pick(yes(4), ~_at(3).endswith("-")).alias("sink_fwd"),
        F.when(edge, big(_at(4))).otherwise(F.when(contained, _at(5).try_cast("bigint"))).alias("source_begin"), F.when(edge, big(_at(5))).alias("source_end"),
        F.when(edge, big(_at(6))).alias("sink_begin"), F.when(edge, big(_at(7))).alias("sink_end"), ends.alias("ends"),
        F.when(contained, _at(6)).when(edge, _at(8)).otherwise(F.coalesce(_at(5), nul)).alias("alignment"),
        F.when(link, _rest(6)).when(contained, _rest(7)).otherwise(_rest(9)).alias("tags"),
    )


def paths(graph: DataFrame) -> DataFrame:
    """name, segments, forwards, overlaps (* where none are given), tags of P lines, and of O lines as GFA2's paths."""
    cut = F.when(F.col("kind") == "P", F.split(_at(2), ",")).otherwise(F.split(_at(2), " "))
    rows = graph.where("kind in ('P', 'O')").select(*ORDER, _at(1).alias("name"), cut.alias("s"), F.when((F.col("kind") == "P") & (_at(3) != "*"), F.split(_at(3), ",")).alias("o"), F.when(F.col("kind") == "P", _rest(4)).otherwise(_rest(3)).alias("tags"))
    names = F.transform("s", lambda x: F.regexp_replace(x, "[+-]$", ""))
    return rows.select(
        *ORDER, "name", names.alias("segments"), F.transform("s", lambda x: ~x.endswith("-")).alias("forwards"),
        F.transform("s", lambda x, i: F.coalesce(F.get("o", i), F.lit("*"))).alias("overlaps"), "tags",
    )


def path_elements(paths_: DataFrame) -> DataFrame:
    """A row for each step: name, rank, segment, forward, overlap, and whether the path returns to its first segment."""
    at = paths_.select(*ORDER, "name", "segments", "forwards", "overlaps", F.posexplode("segments").alias("rank", "segment"))
    loop = (F.size("segments") > 1) & (F.col("segments")[0] == F.element_at("segments", -1))
    return at.select(*ORDER, "name", "rank", "segment", F.get("forwards", F.col("rank")).alias("forward"), F.get("overlaps", F.col("rank")).alias("overlap"), loop.alias("is_circular"))


def walks_to_paths(graph: DataFrame) -> DataFrame:
    """Paths put together from ranked walk lines (W name segment orientation rank overlap): one row for each, steps by rank."""
    w = graph.where("kind = 'W'").select(_at(1).alias("name"), F.struct(_at(4).try_cast("bigint").alias("rank"), _at(2).alias("segment"), (_at(3) == "+").alias("forward"), F.coalesce(_at(5), F.lit("*")).alias("overlap")).alias("s"))
    got = w.groupBy("name").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return got.select("name", F.transform("s", lambda s: s["segment"]).alias("segments"), F.transform("s", lambda s: s["forward"]).alias("forwards"), F.transform("s", lambda s: s["overlap"]).alias("overlaps"))


def gaps(graph: DataFrame) -> DataFrame:
    return graph.where("kind = 'G'").select(*ORDER, _at(1).alias("id"), _at(2).alias("source"), _at(3).alias("sink"), _at(4).try_cast("bigint").alias("distance"), _at(5).alias("variance"), _rest(6).alias("tags"))


def fragments(graph: DataFrame) -> DataFrame:
    big = lambda i: F.regexp_replace(_at(i), r"\$$", "").try_cast("bigint")
    return graph.where("kind = 'F'").select(
        *ORDER, _at(1).alias("id"), F.regexp_replace(_at(2), "[+-]$", "").alias("ref"), (~_at(2).endswith("-")).alias("forward"),
        big(3).alias("seg_begin"), big(4).alias("seg_end"), big(5).alias("frag_begin"), big(6).alias("frag_end"), _at(7).alias("alignment"), _rest(8).alias("tags"),
    )


def groups(graph: DataFrame) -> DataFrame:
    """id, ordered, items, forwards, tags of O and U lines."""
    items = F.split(_at(2), " ")
    return graph.where("kind in ('O', 'U')").select(
        *ORDER, _at(1).alias("id"), (F.col("kind") == "O").alias("ordered"), F.transform(items, lambda x: F.regexp_replace(x, "[+-]$", "")).alias("items"),
        F.transform(items, lambda x: ~x.endswith("-")).alias("forwards"), _rest(3).alias("tags"),
    )


def _tag_text(t: str = "tags") -> Column:
    return F.transform(F.col(t), lambda x: F.concat_ws(":", x["key"], x["type"], x["val"]))


def _sign(c: str) -> Column:
    return F.when(F.col(c), "+").otherwise("-")


def segment_lines(segments_: DataFrame, gfa: int = 1) -> DataFrame:
    name = [F.lit("S"), F.col("name")]
    cols = [F.col("sequence")] if gfa == 1 else [F.col("length").cast("string"), F.col("sequence")]
    return segments_.select(*ORDER, F.concat_ws("\t", *name, *cols, _tag_text()).alias("value"))


def edge_lines(edges_: DataFrame, gfa: int = 1) -> DataFrame:
    """L and C lines of GFA1 (other edges have none), or E lines of GFA2."""
    if gfa == 1:
        link = F.concat_ws("\t", F.lit("L"), "source", _sign("source_fwd"), "sink", _sign("sink_fwd"), F.coalesce("alignment", F.lit("*")), _tag_text())
        inside = F.concat_ws("\t", F.lit("C"), "source", _sign("source_fwd"), "sink", _sign("sink_fwd"), F.coalesce(F.col("source_begin"), F.lit(0)).cast("string"), F.coalesce("alignment", F.lit("*")), _tag_text())
        return edges_.where("type in (1, 2)").select(*ORDER, F.when(F.col("type") == 1, link).otherwise(inside).alias("value"))
    at = lambda c, b: F.concat(F.coalesce(F.col(c), F.lit(0)).cast("string"), F.when(F.col(f"ends.{b}"), "$").otherwise(""))
    return edges_.select(
        *ORDER,
        F.concat_ws(
            "\t", F.lit("E"), "id", F.concat("source", _sign("source_fwd")), F.concat("sink", _sign("sink_fwd")), at("source_begin", "b0"), at("source_end", "b1"), at("sink_begin", "b2"), at("sink_end", "b3"), F.coalesce("alignment", F.lit("*")), _tag_text()
        ).alias("value"),
    )


def path_lines(paths_: DataFrame, gfa: int = 1) -> DataFrame:
    """P lines of GFA1, or O lines of GFA2."""
    steps = F.zip_with("segments", "forwards", lambda s, f: F.concat(s, F.when(f, "+").otherwise("-")))
    one = F.concat_ws("\t", F.lit("P"), "name", F.array_join(steps, ","), F.array_join("overlaps", ","), _tag_text())
    two = F.concat_ws("\t", F.lit("O"), "name", F.array_join(steps, " "), _tag_text())
    return paths_.select(*ORDER, (one if gfa == 1 else two).alias("value"))


def walk_lines(paths_: DataFrame) -> DataFrame:
    """A W line for each step of each path."""
    e = path_elements(paths_)
    return e.select(*ORDER, F.concat_ws("\t", F.lit("W"), "name", "segment", _sign("forward"), (F.col("rank") + 1).cast("string"), "overlap").alias("value"))


def graph_lines(segments_: DataFrame, edges_: DataFrame, paths_: DataFrame, gfa: int = 1) -> DataFrame:
    """block, file_ord, pos, value of a whole graph: header, segments, edges, paths. Sort by the first three."""
    head = segments_.sparkSession.range(1).select(F.lit(0).alias("block"), F.lit(0).alias("file_ord"), F.lit(None).cast(segments_.schema["pos"].dataType).alias("pos"), F.lit(f"H\tVN:Z:{gfa}.0").alias("value"))
    for i, part in enumerate((segment_lines(segments_, gfa), edge_lines(edges_, gfa), path_lines(paths_, gfa)), 1):
        head = head.unionByName(part.withColumn("block", F.lit(i)))
    return head
