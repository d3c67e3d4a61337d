"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its K nearest neighbours of the same label. Lists
start from buckets of random hyperplanes, and improve by local joins: the
neighbours of a vector are compared with each other, as neighbours of
neighbours are likely neighbours. A list is saturated when even its last entry
links (cosine at least the threshold): it may miss links, so its vector gets a
list twice as long, up to LIST_MOST. Links are kept as they are met, whether or
not they stay in a list, so dense groups that border each other become one
component. Components with a vector whose list is still saturated are compared
in blocks, all with all. An audit compares a bounded sample of all vectors with
all vectors; while it finds less than RECALL of their links, lists start again
from further buckets, and after TRIES all vectors of a label are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import connected_components, small
from strandframe.scratch import Scratch

THRESHOLD = 0.98
#: Neighbours a list holds at first and at most.
LIST, LIST_MOST = 12, 24
#: Neighbours by either direction that take part in a local join.
JOIN = 16
#: Sets of hyperplanes, rounds of local joins at most, and the share of new links among all links below which they end.
TABLES, ROUNDS, SETTLED = 8, 4, 0.01
#: Vectors of the audit, and the share of their links that must be found.
AUDIT_ROWS, RECALL = 1024, 0.95
#: Times that lists start from further buckets before all vectors of a label are compared in blocks.
TRIES = 4
#: Members of a block of a dense component.
BLOCK = 1024


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label_key, x of every row: x scaled to length 1 in double precision, null for rows that can't link."""
    link = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label_key"), F.when(link, F.col("embedding").cast("array<double>")).alias("x"))

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("x"):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)  # nulls within are nan here
                most = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
                out.append(x / most / np.sqrt(((x / most) ** 2).sum()) if most > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "label_key", "x"])

    return rows.mapInArrow(run, "vec_id long, label_key string, x array<double>")


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of hit (symmetric) that connect what its entries connect."""
    left, i, j = np.arange(len(hit)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = hit[np.ix_(front, left)]
            met = near.any(0)
            i.append(front[near.argmax(0)[met]])
            j.append(left[met])
            front, left = left[met], left[~met]
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def _matrix(lists) -> np.ndarray:
    """A column of equally long lists as rows."""
    return np.stack([np.asarray(v, np.float64) for v in lists])


def _codes(vectors: DataFrame, bits: int, first: int, tables: int) -> DataFrame:
    """node, label_key, dims, table, code: the signs against the hyperplanes of each table, as bits."""

    def run(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            xs, node, label = batch.column("x").to_numpy(zero_copy_only=False), batch.column("node").to_numpy(zero_copy_only=False), np.array(batch.column("label_key").to_pylist(), object)
            dims = np.array([len(v) for v in xs], np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(xs[at])
                for t in range(first, first + tables):
                    planes = np.random.default_rng([t, d]).standard_normal((d, bits))
                    code = ((x @ planes) > 0) @ weights
                    cols = [pa.array(node[at]), pa.array(label[at].tolist(), pa.string()), pa.array(np.full(len(at), d)), pa.array(np.full(len(at), t)), pa.array(code, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "label_key", "dims", "table", "code"])

    return vectors.select("node", "label_key", "x").mapInArrow(run, "node long, label_key string, dims long, table long, code long")


def _scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b, cos for pairs (a, b), exact in double precision."""
    va = vectors.select(F.col("node").alias("a"), F.col("x").alias("xa"))
    vb = vectors.select(F.col("node").alias("b"), F.col("x").alias("xb"))
    dot = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(va, "a").join(vb, "b").select("a", "b", dot.alias("cos"))


def _top(edges: DataFrame, wanted: DataFrame | None, k: int) -> DataFrame:
    """The k (or wanted: node, k) best entries of each a; new marks entries that no list had before."""
    # dealt by a once, which serves the grouping and the window
    best = edges.repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    ranked = best.withColumn("r", F.row_number().over(order))
    if wanted is not None:
        ranked = ranked.join(wanted.withColumnRenamed("node", "a"), "a", "left")
        return ranked.where(F.col("r") <= F.coalesce("k", F.lit(k))).drop("k")
    return ranked.where(F.col("r") <= k)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos", "new"))


def _local_join(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b, cos of vectors that share a neighbour, where at least one of the two entries is new and the pair would enter a list; and pairs that connect what links among them connect."""
    # a bounded number of members from either direction meet at a vector, new ones first; hubs are thinned, since their members meet elsewhere too
    ends = lists.select(F.col("a").alias("at"), F.col("b").alias("node"), "new", "cos").unionByName(lists.select(F.col("b").alias("at"), F.col("a").alias("node"), "new", "cos"))
    ends = ends.repartition("at").groupBy("at", "node").agg(F.max("new").alias("new"), F.max("cos").alias("cos"))
    order = Window.partitionBy("at").orderBy(F.desc("new"), F.desc("cos"), "node")
    members = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * JOIN).drop("r")
    last = lists.groupBy("a").agg(F.min("cos").alias("bar"), F.count(F.lit(1)).alias("held")).withColumnRenamed("a", "node")
    own = vectors.join(last, "node", "left").select("node", "x", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    met = members.join(own, "node").groupBy("at").agg(F.collect_list(F.struct("node", "new", "bar", "x")).alias("m"))

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for row in batch.column("m"):
                s = row.values
                x = _matrix(s.field("x").to_numpy(zero_copy_only=False))
                node, new, bar = (s.field(c).to_numpy(zero_copy_only=False) for c in ("node", "new", "bar"))
                cos = x @ x.T
                want = np.triu((new[:, None] | new[None, :]) > 0, 1) & ((cos > bar[:, None]) | (cos > bar[None, :]))
                if new.any():
                    i, j = _spanning(cos >= threshold)
                    want[np.minimum(i, j), np.maximum(i, j)] = True
                i, j = np.nonzero(want)
                for o, v in zip(out, (node[i], node[j], cos[i, j]), strict=True):
                    o.append(v)
            cols = [np.concatenate(o) if o else np.empty(0) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["a", "b", "cos"])

    return met.select("m").mapInArrow(run, "a long, b long, cos double")


def neighbour_lists(vectors: DataFrame, n: int, scratch: Scratch, threshold: float, first_table: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lists (a, b, cos) by NN-descent, of which saturated ones are enlarged up to LIST_MOST, and links (a, b): all pairs met at the threshold, with repeats."""
    bits = max(4, min(48, math.ceil(math.log2(max(n, 2) / 8))))
    bucket = ["label_key", "dims", "table", "code"]
    # a bucket is dealt into parts, so that a large one isn't one group; members of a part and the firsts of the parts are linked in a row, each with the next three
    part = F.pmod(F.xxhash64("node", "table"), F.lit(max(16, n // 4096)))
    dealt = scratch.save(_codes(vectors, bits, first_table, TABLES).withColumn("part", part), "codes")
    order = {c: Window.partitionBy(*bucket, *(["part"] if c == "node" else [])).orderBy(c if c == "part" else F.xxhash64("node")) for c in ("node", "part")}
    heads = dealt.groupBy(*bucket, "part").agg(F.min("node").alias("node"))
    start = None
    for rows, window in ((dealt, order["node"]), (heads, order["part"])):
        near = rows.select("node", F.array(*[F.lead("node", k).over(window) for k in (1, 2, 3)]).alias("next"))
        near = near.select("node", F.explode("next").alias("b"))
        pairs = near.select(F.col("node").alias("a"), "b").where("b is not null")
        start = pairs if start is None else start.unionByName(pairs)
    pairs = scratch.save(start.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    scored = scratch.save(_scored(pairs, vectors), "scored")
    links = scored.where(F.col("cos") >= threshold).select("a", "b")
    lists = scratch.save(_top(_both(scored.withColumn("new", F.lit(1))), None, LIST), "lists")
    k, wanted = LIST, None
    while True:
        for _ in range(ROUNDS):
            met = scratch.save(_local_join(lists, vectors, threshold), "met")
            links = links.unionByName(met.where(F.col("cos") >= threshold).select("a", "b"))
            found = met.withColumn("new", F.lit(1))
            held = lists.select("a", "b", "cos", F.lit(0).alias("new"))
            after = scratch.save(_top(held.unionByName(_both(found)), wanted, LIST), "lists")
            fresh, total = after.where(F.col("cos") >= threshold).agg(F.coalesce(F.sum("new"), F.lit(0)), F.count(F.lit(1))).first()
            scratch.free(lists)
            lists = after
            if fresh <= SETTLED * total:
                break
        if k >= LIST_MOST:
            return lists, links
        # saturated lists, and those of the vectors around them
        full = lists.groupBy("a").agg(F.min("cos").alias("bar"), F.count(F.lit(1)).alias("held")).where((F.col("bar") >= threshold) & (F.col("held") >= k))
        k *= 2
        wanted = scratch.save(full.select(F.col("a").alias("node"), F.lit(k).alias("k")), "wanted")
        if wanted.isEmpty():
            return lists, links
        lists = scratch.save(lists.join(wanted.select(F.col("node").alias("a"), F.lit(1).alias("grow")), "a", "left").select("a", "b", "cos", F.coalesce("grow", F.lit(0)).alias("new"), "r"), "lists")


def audit(vectors: DataFrame, edges: DataFrame, members: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> tuple[int, int]:
    """(found, all) links of a sample of at most rows vectors, compared with all vectors. edges holds each link in both directions; members (node, component) those of components in which all are compared."""
    sample = vectors.orderBy(F.xxhash64("node")).limit(rows).select("node", "label_key", "x").toArrow()
    if not sample.num_rows:
        return 0, 0
    ids, labels = sample.column("node").to_numpy(), np.array(sample.column("label_key").to_pylist(), object)
    xs = [np.asarray(v) for v in sample.column("x").to_numpy()]

    def run(batches):
        for batch in batches:
            out = []
            keys, nodes = np.array(batch.column("label_key").to_pylist(), object), batch.column("node").to_numpy(zero_copy_only=False)
            rows_in = batch.column("x").to_numpy(zero_copy_only=False)
            for q, (label, x) in enumerate(zip(labels, xs, strict=True)):
                same = np.flatnonzero((keys == label) & (nodes != ids[q]))
                same = [i for i in same if len(rows_in[i]) == len(x)]
                if same:
                    hit = _matrix([rows_in[i] for i in same]) @ x >= threshold
                    out += [(int(ids[q]), int(nodes[i])) for i, h in zip(same, hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    true = vectors.select("node", "label_key", "x").mapInArrow(run, "a long, b long")
    seen = true.join(edges.select("a", "b").withColumn("seen", F.lit(1)), ["a", "b"], "left")
    for c in ("a", "b"):
        seen = seen.join(members.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    hit = F.col("seen").isNotNull() | F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    total, found = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(hit.cast("int")), F.lit(0))).first()
    return found, total


def _dense_links(members: DataFrame, vectors: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) among members (component, node) of one component, each compared with all: node and its exact number of links, weighed by copies; a, b that connect what links connect."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = members.join(small(sizes), "component").join(vectors, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "copies", "x")

    def run(key, table):
        part = table.column("part").to_numpy()
        x = _matrix(table.column("x").to_numpy())
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        a, b = _spanning(hit)
        if key[1].as_py() != key[2].as_py():
            hit &= part[:, None] != part[None, :]  # pairs within a part are counted by its own task
        links = pa.array((hit * copies).sum(1).astype(np.int64))
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"node": pa.concat_arrays([pa.array(node, pa.int64()), none]), "links": pa.concat_arrays([links, none]), "a": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(node[a], pa.int64())]), "b": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(node[b], pa.int64())])})

    out = scratch.save(met.groupBy("component", "i", "j").applyInArrow(run, "node long, links long, a long, b long"), "blocks")
    return out.where("node is not null").groupBy("node").agg(F.sum("links").alias("links")), out.where("a is not null").select("a", "b")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tries: int = TRIES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings (vec_id, embedding, label).

    Vectors of one label (not null) link if their cosine is at least threshold.
    Null, empty and zero vectors, ones with null or non-finite components and
    rows without label or vec_id have no links and are components of their own;
    vectors of different length do not link. Equal vectors are compared once,
    as a class, and counted as often as they occur, so copies never become
    pairs. Repeated rows are vectors of their own that share a vec_id. An empty
    table gives an empty result. If tries starts do not reach recall, all
    vectors of a label are compared in blocks, which is exact.
    """
    scratch = Scratch(embeddings.sparkSession, "nndescent")
    rows = scratch.save(usable(embeddings), "rows")
    # a class is known by its smallest vec_id
    classes = rows.where("x is not null").groupBy("label_key", "x").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    # vectors that share a vec_id are nodes of their own; the first keeps it
    order = Window.partitionBy("node").orderBy("label_key", "x")
    classes = classes.withColumn("at", F.row_number().over(order)).withColumn("vec", F.col("node"))
    vectors = scratch.save(classes.withColumn("node", F.when(F.col("at") == 1, F.col("node")).otherwise(F.xxhash64("node", "label_key", "x"))).drop("at"), "classes")
    n = vectors.count()
    edges, tried, seen, total = None, 0, 0, 1
    while True:
        if tried == tries:
            members = scratch.save(vectors.select("node", F.xxhash64("label_key", F.size("x")).alias("component")), "members")
            break
        lists, links = neighbour_lists(vectors, n, scratch, threshold, tried * TABLES)
        links = links.unionByName(lists.where(F.col("cos") >= threshold).select("a", "b"))
        found = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        edges = scratch.save((found if edges is None else edges.unionByName(found)).distinct(), "edges")
        parts = scratch.save(connected_components(edges, scratch), "components")
        # saturated at any length: there may be more links than the list holds
        full = lists.groupBy("a").agg(F.min("cos").alias("bar"), F.count(F.lit(1)).alias("held")).where((F.col("bar") >= threshold) & (F.col("held") >= LIST)).select(F.col("a").alias("node"))
        dense = scratch.save(parts.join(full, "node", "left_semi").select("component").distinct(), "dense")
        members = scratch.save(parts.join(small(dense), "component").select("node", "component"), "members")
        tried += 1
        seen, total = audit(vectors, edges, members, threshold)
        if seen >= recall * total:
            break
    exact, more = _dense_links(members, vectors.select("node", "copies", "x"), threshold, scratch)
    if seen < recall * total:
        edges = scratch.save(more.unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        parts = scratch.save(connected_components(edges, scratch), "components")
    weight = vectors.select(F.col("node").alias("b"), "copies")
    counted = edges.join(weight, "b").groupBy("a").agg(F.sum("copies").alias("links")).withColumnRenamed("a", "node")
    exact = scratch.save(exact.withColumnRenamed("links", "exact"), "exact")
    # a component is named by the smallest vec_id in it
    named = vectors.select("node", "vec").join(parts, "node").groupBy("component").agg(F.min("vec").alias("name"))
    per = (
        vectors.select("node", "vec", "copies", "label_key", "x")
        .join(counted, "node", "left")
        .join(exact, "node", "left")
        .join(parts, "node", "left")
        .join(named, "component", "left")
        .select("label_key", "x", (F.coalesce("exact", "links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "vec").alias("component_id"))
    )
    per = rows.where("x is not null").join(per, ["label_key", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = scratch.save(per.unionByName(alone), "linked")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_query(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)
