"""Graph operators: contig labels of nodes, path rewriting, rGFA alignments, graph edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.names import node_id, with_prefix
from strandframe.operators import intervals, scan, sequences
from strandframe.operators.components import component_of
from strandframe.scratch import Scratch


def label_nodes(nodes: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """node_id, contig: rank 0 nodes have their own contig; others take it from neighbours of lower rank, or of equal rank once these have one.

    nodes: node_id, rank, contig (of rank 0). edges: source, sink (ids), either
    way. Labels flow along edges towards equal or higher rank. Nodes of equal
    rank that edges connect have the same labels, so these are made one first;
    then a round of joins for each step upwards in rank, until none is new. So
    rounds grow with the number of ranks and the logarithm of a chain's length.
    strict raises if a node gets two labels or none, or an edge names an
    unknown node; otherwise nodes with two labels have a row for each and nodes
    without have none.
    """
    scratch = Scratch(nodes.sparkSession, "labels")
    ranks = scratch.save(nodes.select("node_id", "rank"), "ranks")
    both = edges.select(F.col("source").alias("u"), F.col("sink").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    ru, rv = ranks.select(F.col("node_id").alias("u"), F.col("rank").alias("ru")), ranks.select(F.col("node_id").alias("v"), F.col("rank").alias("rv"))
    ways = both.join(ru, "u", "left").join(rv, "v", "left")
    if strict and not ways.where("ru is null or rv is null").isEmpty():
        raise ValueError("an edge names a node that has no segment")
    ways = scratch.save(ways.where("rv > 0 and ru <= rv").select("u", "v", (F.col("ru") == F.col("rv")).alias("level")), "ways")
    level = scratch.save(component_of(ways.where("level").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch), "level")
    of = lambda c, as_: level.select(F.col("node").alias(c), F.col("component").alias(as_))
    up = ways.where("not level").join(of("u", "cu"), "u", "left").join(of("v", "cv"), "v", "left")
    up = scratch.save(up.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).distinct(), "up")
    named = scratch.save(nodes.where("rank = 0").select("node_id", "contig").distinct(), "named")
    known = fresh = named
    while not fresh.isEmpty():
        reached = fresh.select(F.col("node_id").alias("u"), "contig").join(up, "u").select(F.col("v").alias("node_id"), "contig").distinct()
        fresh = scratch.save(reached.join(known, ["node_id", "contig"], "left_anti"), "fresh")
        known = scratch.save(known.unionByName(fresh), "known")
    members = known.withColumnRenamed("node_id", "component").join(level, "component").select(F.col("node").alias("node_id"), "contig")
    known = known.join(level.select(F.col("node").alias("node_id")), "node_id", "left_anti").unionByName(members)
    if strict:
        if not known.groupBy("node_id").count().where("count > 1").isEmpty():
            raise ValueError("a node is reached from two contigs")
        if not ranks.join(known, "node_id", "left_anti").isEmpty():
            raise ValueError("a node is reached from no contig")
    return known


def contig_ids(targets: DataFrame, order: list[str]) -> DataFrame:
    """contig, contig_id: names by first appearance. The table has a row for each contig and is small."""
    first = targets.groupBy("contig").agg(F.min(F.struct(*order)).alias("__o"))
    return first.select("contig", (F.row_number().over(Window.orderBy("__o")) - 1).cast("bigint").alias("contig_id"))


def relabel(labels: DataFrame, selected: DataFrame, other: str) -> DataFrame:
    """labels with contigs that aren't in selected (contig) named other."""
    known = selected.select("contig").distinct().withColumn("__in", F.lit(True))
    out = labels.join(known, "contig", "left")
    return out.withColumn("contig", F.when(F.col("__in"), F.col("contig")).otherwise(F.lit(other))).drop("__in")


def select_contigs(labels: DataFrame, names: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Rows whose contig is in names, or, without names, starts with prefix."""
    if names is not None:
        return labels.join(names.select(F.col("name").alias("contig")).distinct(), "contig", "left_semi")
    return labels.where(F.col("contig").startswith(prefix))


def split_graph(segments: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, edges) with contig; raises if an edge joins two contigs."""
    by_name = segments.join(labels, "node_id").select(F.col("name").alias("__n"), "contig")
    out = segments.join(labels, "node_id")
    a = edges.join(by_name.withColumnRenamed("contig", "__a"), F.col("source") == F.col("__n")).drop("__n")
    b = a.join(by_name.withColumnRenamed("contig", "__b"), F.col("sink") == F.col("__n")).drop("__n")
    same = F.when(F.col("__a") != F.col("__b"), F.raise_error(F.concat(F.lit("an edge joins two contigs: "), F.col("source"), F.lit(" "), F.col("sink"))).cast("string")).otherwise(F.col("__a"))
    return out, b.withColumn("contig", same).drop("__a", "__b")


def split_lines(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """contig, file_ord, pos, value: the S and L lines of a graph (kind, t, value) with the contig of their nodes, for contig_files.write. A node without contig (labels: node_id, contig) and a link between two raise; other lines are left out."""
    rows = graph.where("kind in ('S', 'L')").withColumns({"__a": node_id(F.col("t")[1]), "__b": F.when(F.col("kind") == "L", node_id(F.get("t", F.lit(3))))})
    of = lambda c: labels.select(F.col("node_id").alias(c), F.col("contig").alias(f"{c}_contig"))
    both = rows.join(of("__a"), "__a", "left").join(of("__b"), "__b", "left")
    fine = F.col("__a_contig").isNotNull() & ((F.col("kind") == "S") | F.col("__a_contig").eqNullSafe(F.col("__b_contig")))
    contig = F.when(fine, F.col("__a_contig")).otherwise(F.raise_error(F.concat(F.lit("not of one contig: "), F.substring("value", 1, 100))).cast("string"))
    return both.select(contig.alias("contig"), "file_ord", "pos", "value")


def stable_index(segments: DataFrame) -> DataFrame:
    """contig, n_start, n_end, node, node_id: segments on their stable contig; the first of several at one offset counts."""
    rows = segments.where("sn is not null and so is not null")
    first = Window.partitionBy("sn", "so").orderBy("file_ord", "pos")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return rows.select(F.col("sn").alias("contig"), F.col("so").alias("n_start"), (F.col("so") + F.col("length")).alias("n_end"), F.col("name").alias("node"), "node_id")


def node_lookup(ranges: DataFrame, index: DataFrame) -> DataFrame:
    """ranges (contig, start, end, others) with each node that they meet: node, node_id, n_start, n_end."""
    right = index.withColumnRenamed("n_start", "r_start").withColumnRenamed("n_end", "r_end")
    met = intervals.overlap_join(ranges, right, ["contig"])
    return met.withColumnRenamed("r_start", "n_start").withColumnRenamed("r_end", "n_end")


def to_nodes(gaf: DataFrame, segments: DataFrame, labels: DataFrame, row: str) -> DataFrame:
    """GAF rows whose stable paths are rewritten to nodes, with rc: the contig of all their nodes if it is one.

    A bare contig is looked up by the row's path range, whose offsets then count
    from the first node; an interval step by its own range. A reverse step has
    its nodes in reverse. Rows that meet no node are left out.
    """
    index = stable_index(segments)
    steps = gaf.select(row, "path_start", "path_end", F.posexplode("path").alias("step", "s"))
    bare = ~F.col("s.is_interval")
    ranges = steps.select(
        row, "step", F.col("s.name").alias("contig"), F.col("s.is_reverse").alias("back"), bare.alias("bare"),
        F.when(bare, F.col("path_start")).otherwise(F.col("s.start")).alias("start"), F.when(bare, F.col("path_end")).otherwise(F.col("s.end")).alias("end"),
    )
    met = node_lookup(ranges, index).join(labels.select("node_id", F.col("contig").alias("rc")), "node_id", "left")
    at = F.when(F.col("back"), -F.col("n_start")).otherwise(F.col("n_start"))
    one = F.struct("step", at.alias("at"), F.col("node").alias("name"), "back", (F.col("n_end") - F.col("n_start")).alias("len"), "n_start", "bare")
    got = met.groupBy(row).agg(F.array_sort(F.collect_list(one)).alias("ns"), F.collect_set("rc").alias("rcs"))
    out = gaf.join(got, row)
    no = F.lit(None).cast("bigint")
    path = F.transform("ns", lambda x: F.struct(x["name"].alias("name"), x["back"].alias("is_reverse"), F.lit(False).alias("is_stable"), F.lit(False).alias("is_interval"), no.alias("start"), no.alias("end")))
    whole = F.aggregate("ns", F.lit(0).cast("bigint"), lambda s, x: s + x["len"])
    first = F.col("ns")[0]
    start = F.when(first["bare"], F.col("path_start") - first["n_start"]).otherwise(F.col("path_start"))
    return out.withColumns(
        {"path": path, "path_end": F.when(first["bare"], start + F.col("path_end") - F.col("path_start")).otherwise(F.col("path_end")), "path_start": start, "path_len": whole, "rc": F.when(F.size("rcs") == 1, F.col("rcs")[0])}
    ).drop("ns", "rcs")


def rgfa_to_paf(segments: DataFrame, lengths: DataFrame | None = None, max_rank: int = 0, ignore: DataFrame | None = None, target_prefix: str = "", query_prefix: str = "") -> DataFrame:
    """Exact-match PAF rows of nodes against their contigs, for ranks up to max_rank. Query lengths come from lengths, or else are the summed nodes of rank up to max_rank.

    ignore (name): contigs that are left out.
    """
    rows = segments.where((F.col("sr") <= max_rank) & F.col("sn").isNotNull()).withColumn("query_name", with_prefix(F.col("sn"), query_prefix) if query_prefix else F.col("sn"))
    if ignore is not None:
        rows = rows.join(ignore.select(F.col("name").alias("query_name")).distinct(), "query_name", "left_anti")
    own = lengths.select(F.col("name").alias("query_name"), F.col("length").alias("query_len")) if lengths is not None else rows.groupBy("query_name").agg(F.sum("length").alias("query_len"))
    out = rows.join(own, "query_name")
    target = F.concat(F.lit(target_prefix), F.col("name"))
    return out.select(
        "query_name", "query_len", F.col("so").alias("query_start"), (F.col("so") + F.col("length")).alias("query_end"), F.lit("+").alias("strand"), target.alias("target_name"),
        F.col("length").alias("target_len"), F.lit(0).cast("bigint").alias("target_start"), F.col("length").alias("target_end"), F.col("length").alias("num_matching"), F.col("length").alias("num_bases"),
        F.lit(60).cast("bigint").alias("mapq"), F.concat(F.col("length").cast("string"), F.lit("M")).alias("cg"),
    )


def assembly_stats(segments: DataFrame) -> DataFrame:
    """n, total, n50, n90, l50, l90 of column length: the length at which the longest sequences together reach 50 and 90 % of all bases, and how many these are.

    Equal lengths are counted first; running sums go by ranges of lengths, each
    from the sums of the ranges of longer ones.
    """
    counts = segments.where("length is not null").groupBy("length").agg(F.count(F.lit(1)).alias("c")).withColumn("__o", -F.col("length"))
    laid = scan.laid_out(counts, ["__o"])
    down = Window.partitionBy("__part").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.col("c") * F.col("length")
    # one row for each range
    sizes = laid.groupBy("__part").agg(F.sum(bases).alias("s"), F.sum("c").alias("k"))
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    sizes = sizes.select("__part", F.coalesce(F.sum("s").over(before), zero).alias("s0"), F.coalesce(F.sum("k").over(before), zero).alias("k0"), F.sum("s").over(every).alias("total"), F.sum("k").over(every).alias("n"))
    run = laid.join(F.broadcast(sizes), "__part")
    run = run.select("length", "c", (F.sum(bases).over(down) + F.col("s0")).alias("s"), (F.sum("c").over(down) + F.col("k0")).alias("k"), "total", "n")

    def at(share: float):
        ok = F.col("s") >= F.col("total") * share
        # sequences of one length are passed one by one
        need = F.ceil((F.col("total") * share - (F.col("s") - F.col("c") * F.col("length"))) / F.col("length"))
        return F.max(F.when(ok, F.col("length"))), F.min(F.when(ok, F.col("k") - F.col("c") + F.greatest(need, F.lit(1))))

    (n50, l50), (n90, l90) = at(0.5), at(0.9)
    return run.agg(F.max("n").alias("n"), F.max("total").alias("total"), n50.alias("n50"), n90.alias("n90"), l50.cast("bigint").alias("l50"), l90.cast("bigint").alias("l90"))


def merge_graphs(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Rows of a, and those of b whose key a does not have."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def trim_segments(segments: DataFrame, edges: DataFrame, least: int = 0, no_ambiguous: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments of least bases or more (and without other letters than A, C, G and T), and the edges between them."""
    fine = F.col("length").isNotNull() & (F.col("length") >= least)
    if no_ambiguous:
        fine = fine & F.col("sequence").rlike("^[ACGTacgt]*$")
    gone = segments.where(~fine | F.col("length").isNull()).select("name")
    left = edges.join(gone.withColumnRenamed("name", "source"), "source", "left_anti").join(gone.withColumnRenamed("name", "sink"), "sink", "left_anti")
    return segments.where(fine), left


def fill_sequences(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """segments with * sequences taken from chunks of sequences (name, chunk, bases) where these have them."""
    found = sequences.whole(chunks, segments.where("sequence = '*'"))
    both = segments.join(found.select("name", F.col("seq").alias("__s")), "name", "left")
    seq = F.when(F.col("sequence") == "*", F.coalesce("__s", F.lit("*"))).otherwise(F.col("sequence"))
    return both.withColumn("sequence", seq).withColumn("length", F.when(seq != "*", F.length(seq).cast("bigint")).otherwise(F.col("length"))).drop("__s").select(*segments.columns)


def renumber(segments: DataFrame, edges: DataFrame, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """Segments named by base + 1, base + 2, ... in order of their lines, and edges with the new names.

    Numbers are given by partition of a range sort and the rows before it, so no task orders the whole table.
    """
    ordered = segments.orderBy("file_ord", "pos").withColumn("__part", F.spark_partition_id())
    scratch = Scratch(segments.sparkSession, "renumber")
    ordered = scratch.save(ordered, "ordered")
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("__part", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("file_ord", "pos"))
    named = ordered.join(F.broadcast(before), "__part").withColumn("new", (F.col("b") + inside + base).cast("string"))
    names = named.select(F.col("name").alias("old"), "new")
    out = named.withColumn("name", F.col("new")).select(*segments.columns)
    e = edges.join(names.select(F.col("old").alias("source"), F.col("new").alias("__a")), "source").join(names.select(F.col("old").alias("sink"), F.col("new").alias("__b")), "sink")
    return out, e.withColumn("source", F.col("__a")).withColumn("sink", F.col("__b")).select(*edges.columns)


def max_ids(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """max_node, max_edge: the largest numeric names."""
    both = segments.select(F.col("name").try_cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("e"))
    both = both.unionByName(edges.select(F.lit(None).cast("bigint").alias("n"), F.col("id").try_cast("bigint").alias("e")))
    return both.agg(F.max("n").alias("max_node"), F.max("e").alias("max_edge"))
