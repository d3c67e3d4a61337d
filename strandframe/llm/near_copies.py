"""Near-copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash as in simhash.py: fingerprints of two-word
shingles, which move by few bits where single words change, meet in the cells
of the popcount grid. A longer SimHash, of the distinct five-word shingles,
then tells how similar two texts in a cell seem. A task hands on edges that
connect what seems similar in its cells, never their pairs, and what these
connect is a cluster. All pairs of a cluster are then compared exactly, on the shingles of
both texts, within tasks that hold one block of the cluster or two, and again
edges that connect what is similar are all that is handed on. So rows grow with
the texts of a cluster, not with its pairs, and no order of looking loses a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import connected_components, small
from strandframe.llm.simhash import _cells, _counts, _once, part_masks, segment_counts, text_fingerprint, text_key
from strandframe.scratch import Scratch

WIDTH, LEAST = 5, 0.8
#: Words of the shingles of the fingerprint that finds candidates; the differing bits up to which two always meet in a cell, and up to which two that meet are looked at.
FINGER_WIDTH, RADIUS, NEAR = 2, 8, 12
#: Longs of the sketch, and the share of its bits up to which texts may be similar: a similarity of 0.8 means 0.151 on average, with a deviation of 0.016.
SKETCH_LONGS, REACH = 8, 0.18
#: Members of a cell (or of one block of a large cell) that a task compares, and those up to which the pairs of many cells are made at once.
CELL_ROWS, FEW = 1024, 128
#: Rows of an Arrow batch of texts, and of one of cells.
TEXT_ROWS, GROUP_ROWS = 500, 2000
#: Texts of a block of a cluster, and bytes of their shingles; a task compares two blocks at most.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
#: Shingles whose holders are counted at once by a matrix product; pairs of holders that are counted at once.
_COLUMNS, _PAIRS = 4096, 1 << 20
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of five words, in order; words as in simhash.text_fingerprint. A shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - WIDTH + 1)
    starts, stops = (ends - [len(w) + 1 for w in words])[:n].tolist(), (ends[min(WIDTH, len(words)) - 1 :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, stops, strict=True)), np.uint64, n))


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits of distinct hashes; none give zeros."""
    out = np.zeros(SKETCH_LONGS * 8, np.uint8)
    for k, m in enumerate(_MIX if len(hashes) else ()):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            mixed = hashes[at : at + (1 << 16)] * m
            mixed = (mixed ^ mixed >> np.uint64(31)) * m
            counts += np.unpackbits((mixed ^ mixed >> np.uint64(29)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[8 * k : 8 * k + 8] = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return out.tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (places in sets, of distinct hashes) that connect what pairs of a similarity of LEAST or more connect; all pairs are compared."""
    if len(sets) == 2:
        return [(0, 1)] if similarity(*sets) >= LEAST else []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a text most of whose shingles no other has is similar to none
    common = np.bincount(owner[held[which] > 1], minlength=len(sets))
    able = np.flatnonzero(common / np.maximum(sizes, 1) >= np.where(sizes > 0, LEAST, 0))
    place = np.full(len(sets), -1)
    place[able] = np.arange(len(able))
    taken = (held[which] > 1) & (place[owner] >= 0)
    both, total = _intersections(place[owner[taken]], which[taken], len(able)), sizes[able][:, None] + sizes[able]
    near = both >= total - both
    np.divide(both, total - both, out=both, where=total > 0)
    near = np.where(total > 0, both >= LEAST, near)

    edges, seen = [], np.zeros(len(able), bool)
    for first in range(len(able)):
        front = [] if seen[first] else [first]
        seen[first] = True
        while front:
            i = front.pop()
            more = np.flatnonzero(near[i] & ~seen).tolist()
            seen[more] = True
            edges += [(int(able[i]), int(able[j])) for j in more]
            front += more
    return edges


def _intersections(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each pair of n rows, how many columns hold both; (rows, columns) are what is held, each once, rows ascending."""
    out = np.zeros((n, n))
    held = np.bincount(columns) if len(columns) else np.zeros(0, np.int64)
    # many holders: a product of matrices; few: all pairs of holders
    often = held > max(8, n // 16)
    at = np.where(often, np.cumsum(often) - 1, -1)[columns] if len(columns) else columns
    for lo in range(0, int(often.sum()), _COLUMNS):
        now = (at >= lo) & (at < lo + _COLUMNS)
        m = np.zeros((n, _COLUMNS), np.float32)
        m[rows[now], at[now] - lo] = 1
        out += m @ m.T
    rows, columns = rows[at < 0], columns[at < 0]
    order = np.argsort(columns, kind="stable")
    rows, times = rows[order], held[columns[order]]
    for d in np.unique(times[times > 1]).tolist():
        holders, (i, j) = rows[times == d].reshape(-1, d), np.triu_indices(d, 1)
        step = max(1, _PAIRS // len(i))
        for lo in range(0, len(holders), step):
            part = holders[lo : lo + step]
            one = np.bincount((part[:, i] * n + part[:, j]).reshape(-1), minlength=n * n).reshape(n, n)
            out += one + one.T
    return out


def _first_shared(a: np.ndarray, b: np.ndarray, part: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a cell is the first of those in which points a and b (segment counts) meet, so that a pair counts in one cell only."""
    first, masks = np.ones(len(a), bool), [np.uint64(m) for m in part_masks(RADIUS)]
    for p, mask in enumerate(masks):
        differ = (a ^ b) & mask
        near = np.bitwise_count(differ) <= 2
        # beside or between them: the smaller one, or one step up from it where the other is two steps up
        shared = a & b & mask
        up = (np.bitwise_count(differ) == 2) & ((differ & a == 0) | (differ & b == 0))
        shared = np.where(up, shared | (differ & -differ), shared)
        first &= np.where(part == p, near & (shared == cell), ~near | (part < p))
    return first


def _spanning(part: int, cell: np.uint64, keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a large cell that connect what seems similar among the pairs that count in it."""
    n, group, counts = len(keys), np.arange(len(keys)), _counts(fps)
    for i in range(n - 1):
        others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        others = others[np.bitwise_count(fps[others] ^ fps[i]) <= NEAR]
        others = others[np.bitwise_count(sketches[others] ^ sketches[i]).sum(1) <= REACH * 64 * SKETCH_LONGS]
        others = others[_first_shared(counts[others], counts[i], np.full(len(others), part), np.full(len(others), cell))]
        # one edge for each group that is met
        for g, j in zip(*np.unique(group[others], return_index=True), strict=True):
            yield int(keys[i]), int(keys[others[j]])
            group[group == g] = group[i]


def _of_small(first: np.ndarray, size: int, part: np.ndarray, cell: np.ndarray, keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that seem similar and count in many cells of one size, which begin at first: few of their pairs are near."""
    i, j = np.triu_indices(size, 1)
    step = max(1, (1 << 17) // len(i))
    for at in range(0, len(first), step):
        a, b = ((first[at : at + step, None] + x).reshape(-1) for x in (i, j))
        of = np.repeat(np.arange(at, min(at + step, len(first))), len(i))
        near = np.bitwise_count(fps[a] ^ fps[b]) <= NEAR
        a, b, of = a[near], b[near], of[near]
        like = np.bitwise_count(sketches[a] ^ sketches[b]).sum(1) <= REACH * 64 * SKETCH_LONGS
        a, b, of = a[like], b[like], of[like]
        like = _first_shared(_counts(fps[a]), _counts(fps[b]), part[of], cell[of])
        yield from zip(keys[a[like]].tolist(), keys[b[like]].tolist(), strict=True)


def _joining(edges: Iterator[tuple[int, int]], up: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Those of edges that join what none before them has joined; up keeps what is joined."""
    for edge in edges:
        ends = []
        for x in edge:
            while (over := up.get(x, x)) != x:
                up[x] = x = up.get(over, over)
            ends.append(x)
        if ends[0] != ends[1]:
            up[ends[1]] = ends[0]
            yield edge


def _longs(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binary values, one after the other, as longs; nothing is copied."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint64)


def _dealt(rows: DataFrame, by: list[str], members: list[str]) -> DataFrame:
    """rows, which have the number of blocks of their group (by), dealt out to all pairs (i, j) of blocks; one block is a pair by itself."""
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.where("blocks = 1 or block <> other")
    return rows.select(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *members).repartition(*by, "i", "j")


def _in_cells(rows: DataFrame, by: list[str], members: list[str], scratch: Scratch, cell_rows: int) -> DataFrame:
    """m, a list of members, for each cell of rows (key, fp and more) or each pair of blocks of a large one that has several."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / 10_000))
    cells = rows.repartition(tasks, "key").withColumn("counts", segment_counts(F.col("fp")))
    cells = cells.select(*members, F.explode(_cells(F.col("counts"), RADIUS)).alias("c")).select(*members, "c.*")
    sizes = cells.groupBy(*by).count().withColumn("blocks", F.ceil(F.col("count") / cell_rows).cast("int")).where("blocks > 1")
    sizes = scratch.save(sizes.select(*by, "blocks"), "large")
    dealt = _dealt(cells.join(small(sizes), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), by, members)
    # lists are made behind the shuffle alone: before it, they would hold rows in memory and fold none
    return dealt.groupBy(*by, "i", "j").agg(F.collect_list(F.struct(*members)).alias("m")).where(F.size("m") > 1).select(*by, "m")


def meeting(texts: DataFrame, scratch: Scratch, cell_rows: int) -> DataFrame:
    """The texts (fp and more) whose fingerprint is another text's too, or meets one within NEAR bits in a cell. Only fingerprints are dealt to cells, so sketches need not travel for the others."""
    fps = scratch.save(texts.groupBy(F.col("fp").alias("key")).agg(F.count(F.lit(1)).alias("n")), "fps")
    groups = _in_cells(fps.select("key", F.col("key").alias("fp")), ["part", "cell"], ["key"], scratch, cell_rows)

    def near(batches):
        told: set[int] = set()
        for batch in batches:
            members = batch.column("m")
            keys, sizes, found = members.flatten().field("key").to_numpy(), members.value_lengths().to_numpy(), []
            fps, first = keys.view(np.uint64), np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                starts = first[sizes == size]
                if size <= FEW:
                    i, j = np.triu_indices(size, 1)
                    step = max(1, (1 << 17) // len(i))
                    for lo in range(0, len(starts), step):
                        a, b = ((starts[lo : lo + step, None] + x).reshape(-1) for x in (i, j))
                        hit = np.bitwise_count(fps[a] ^ fps[b]) <= NEAR
                        found += [keys[a[hit]], keys[b[hit]]]
                else:
                    for lo in starts.tolist():
                        own = fps[lo : lo + size]
                        hit = [np.count_nonzero(np.bitwise_count(own ^ x) <= NEAR) > 1 for x in own]
                        found.append(keys[lo : lo + size][hit])
            new = set(np.concatenate(found).tolist() if found else ()) - told
            told |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64())], ["fp"])

    wanted = groups.select("m").mapInArrow(near, "fp long").union(fps.where("n > 1").select("key")).distinct()
    return scratch.save(texts.join(small(scratch.save(wanted, "wanted")), "fp", "left_semi"), "meeting")


def candidates(texts: DataFrame, scratch: Scratch, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that connect the keys of distinct texts (key, fp, sketch) that seem similar; large cells are dealt into pairs of blocks."""
    groups = _in_cells(meeting(texts, scratch, cell_rows), ["part", "cell"], ["key", "fp", "sketch"], scratch, cell_rows)

    def compare(batches):
        up: dict[int, int] = {}
        for batch in batches:
            members = batch.column("m")
            part, cell = batch.column("part").to_numpy(), batch.column("cell").to_numpy().view(np.uint64)
            flat, edges = members.flatten(), []
            if len(flat):
                keys, fps = flat.field("key").to_numpy(), flat.field("fp").to_numpy().view(np.uint64)
                sketches = _longs(flat.field("sketch")).reshape(len(keys), SKETCH_LONGS)
                sizes = members.value_lengths().to_numpy()
                first = np.cumsum(sizes) - sizes
                for size in np.unique(sizes).tolist():
                    if size <= FEW:
                        of = sizes == size
                        edges += _joining(_of_small(first[of], size, part[of], cell[of], keys, fps, sketches), up)
                for g in np.flatnonzero(sizes > FEW).tolist():
                    at = slice(first[g], first[g] + sizes[g])
                    edges += _joining(_spanning(part[g], cell[g], keys[at], fps[at], sketches[at]), up)
            yield _edges(edges)

    return groups.mapInArrow(compare, "a long, b long").distinct()


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pick(e) for e in edges], pa.int64()) for pick in (min, max)], ["a", "b"])


def clusters(texts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """key, first, within and blocks of the texts (key, first, n: number of shingles) that edges connect: their cluster and into how many blocks it is dealt."""
    found = connected_components(edges, scratch).select(F.col("node").alias("key"), F.col("component").alias("within"))
    of = scratch.save(texts.select("key", "first", "n").join(found, "key"), "clusters")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES, F.lit(1))).cast("int")
    return scratch.save(of.join(of.groupBy("within").agg(blocks.alias("blocks")), "within").select("key", "first", "within", "blocks"), "members")


def links(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is similar within clusters; members has key, text, within and blocks."""

    def hashed(batches):
        for batch in batches:
            hashes = pa.array([shingle_hashes(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "within", "blocks")), hashes], ["key", "within", "blocks", "hashes"])

    def compare(batches):
        at, keys, sets = None, [], []
        for batch in batches:
            flat, ends, edges = _longs(batch.column("hashes")), np.cumsum([0, *pc.binary_length(batch.column("hashes")).to_pylist()]) // 8, []
            for k, (key, *place) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "within", "i", "j")), strict=True)):
                if place != at:
                    edges += _named(keys, sets)
                    at, keys, sets = place, [], []
                keys.append(key)
                sets.append(flat[ends[k] : ends[k + 1]])
            yield _edges(edges)
        yield _edges(_named(keys, sets))

    rows = members.select("key", "within", "blocks", "text").mapInArrow(hashed, "key long, within long, blocks int, hashes binary")
    dealt = _dealt(rows, ["within"], ["key", "hashes"]).sortWithinPartitions("within", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def _named(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    return [(keys[i], keys[j]) for i, j in linked(sets)] if len(keys) > 1 else []


@contextmanager
def arrow_rows(df: DataFrame, rows: int) -> Iterator[None]:
    """Jobs within it pass at most rows rows to Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        yield
    finally:
        conf.set(key, before)


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """key (of a text), first (its smallest doc_id) and component of the distinct texts of docs (doc_id, text). Rows without doc_id take no part."""
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))

    def marked(batches):
        for batch in batches:
            fps, sketches, sizes = [], [], []
            for t in batch.column("text"):  # one text at a time is in Python
                text = t.as_py()
                fps.append(text_fingerprint(text, FINGER_WIDTH))
                hashes = shingle_hashes(text)
                sketches.append(sketch(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], ["key", "doc_id", "fp", "sketch", "n"])

    each = rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(marked, "key long, doc_id long, fp long, sketch binary, n long")
    with arrow_rows(docs, TEXT_ROWS):
        texts = scratch.save(each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("fp").alias("fp"), F.max("sketch").alias("sketch"), F.max("n").alias("n")), "texts")
    with arrow_rows(docs, GROUP_ROWS):
        edges = scratch.save(candidates(texts.select("key", "fp", "sketch"), scratch), "candidates")
    members = clusters(texts, edges, scratch)
    named = small(members.select("key", F.col("first").alias("doc_id"), "within", "blocks"))
    with arrow_rows(docs, TEXT_ROWS):
        # the text of one row of each; equal rows repeat it
        held = scratch.save(links(rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, ["key", "doc_id"]).dropDuplicates(["key"])), "links")
    found = connected_components(held, scratch).withColumnRenamed("node", "key")
    return texts.select("key", "first").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group of near-copies: the one with the smallest doc_id stays, whole and unchanged.

    Groups are what links of a similarity of 0.8 or more connect. Null and
    blank texts are alike. Rows equal in doc_id and text are one document and
    give one row, the least in order of the other columns as text. Of rows that
    share a doc_id, the one with the smallest hash of its text stands for the
    group. Rows without doc_id stay. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "near_copies")
    found = scratch.save(groups(docs, scratch), "groups")
    named = found.groupBy("component").agg(F.min(F.struct("first", "key")).alias("f"))
    kept = named.select(F.col("f.first").alias("__id"), F.col("f.key").alias("__key"))
    key = text_key(F.coalesce(docs["text"].cast("string"), F.lit("")))
    # what stays is most of the table, so what goes is joined
    gone = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("__id"), key.alias("__key")).join(kept, ["__id", "__key"], "left_anti").distinct()
    gone = scratch.save(gone, "gone")
    same = (docs["doc_id"] == F.col("__id")) & (key == F.col("__key"))
    return _once(docs.join(small(gone), same, "left_anti").select(*docs.columns))
