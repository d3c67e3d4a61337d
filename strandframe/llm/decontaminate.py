"""Benchmark decontamination: SimHashes of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

An item of n words is looked for in windows of n words. Similarity s of
shingles a and b in number means that at least s (a + b) / (1 + s) of them are
shared, so windows are laid only where as many shingles are in items of that
size: this leaves out no similar window. The SimHash of each is cut into
RADIUS + 1 blocks, and one of them at least is equal in every item's SimHash
within RADIUS bits: the join on blocks finds all of these. The weighted Jaccard
similarity of the shingles (each weighs as often as it occurs) decides. RADIUS
is so wide that windows at the similarity lie within it: their distance is
some 9 bits with a deviation under 3. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import extended, simhash, small, word_array
from strandframe.scratch import Scratch

WIDTH = 5
SIMILARITY = 0.8
#: Bits in which the SimHashes of a window and an item differ at most.
RADIUS = 24


def _words(text: Column) -> Column:
    return word_array(F.lower(text.cast("string")))


def _shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of the shingles of width words, by position."""
    n = F.size(words) - (width - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _shingles(words: Column, width: Column) -> Column:
    """The shingles of width words as texts, by position; one of all words if there are fewer."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of shingles, each shingle weighing as often as it occurs."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    weighted = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    once = lambda xs: F.size(F.array_distinct(xs)) == F.size(xs)
    # where no shingle repeats on one side, each shared one counts once
    shared = F.when(once(a) | once(b), F.size(F.array_intersect(a, b))).otherwise(weighted)
    return shared / (F.size(a) + F.size(b) - shared)


def with_fingerprint(df: DataFrame, shingles: str, name: str) -> DataFrame:
    """df with the SimHash of an array of shingles, each counting as often as it occurs; the hashes are a column of their own, so that they are taken once."""
    return df.withColumn("__h", F.transform(shingles, lambda x: F.xxhash64(x))).withColumn(name, simhash(F.col("__h"), F.size("__h"))).drop("__h")


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """An array of (block, bits): radius + 1 blocks of a SimHash, of which one at least is the same within radius bits."""
    cut = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).cast("short").alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))])


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """The fewest shared of a and b shingles that give the similarity."""
    return F.greatest(F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-6).cast("int"), F.lit(1))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, item_id, start_word, n_words, similarity: the best window of each document for each item found in it.

    docs has doc_id and text, items has item_id and text; other columns are
    ignored. Texts are lower-cased and cut at ASCII white space. Items of fewer
    than width words are compared as one shingle of all their words; items
    without words, and null or blank documents, match nothing. text_key is a
    hash of the text, which tells rows that share a doc_id apart; repeated rows
    give one result. Items that repeat an item_id are each looked for.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    words = items.select("item_id", _words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    words = words.withColumn("n", F.size("item_words")).withColumn("width", F.least(F.lit(width), F.col("n")))
    bench = scratch.save(words.withColumn("item_key", F.xxhash64("item_words")), "items")
    widths = [r[0] for r in bench.select("width").distinct().collect()]  # at most `width` numbers

    key = [F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")]
    text = docs.select(*key, _words(F.col("text")).alias("words"))
    hits = None
    for w in widths:
        of_width = bench.where(F.col("width") == w)
        shingles = of_width.select("n", F.explode(_shingle_hashes(F.col("item_words"), w)).alias("h")).distinct()
        shingles = scratch.save(shingles.groupBy("h").agg(F.collect_set("n").alias("sizes")), "shingles")
        at = text.select("doc_id", "text_key", F.size("words").alias("total"), F.posexplode(_shingle_hashes(F.col("words"), w)).alias("pos", "h"))
        found = at.join(small(shingles), "h").select("doc_id", "text_key", "total", "pos", F.lit(w).alias("width"), F.explode("sizes").alias("n"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], extended(docs.select("doc_id"), ("text_key", "long"), ("item_id", items.schema["item_id"].dataType), ("start_word", "integer"), ("n_words", "integer"), ("similarity", "double")))

    places = hits.groupBy("doc_id", "text_key", "n", "width", "total").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    places = places.withColumn("held", F.least("n", "total") - F.col("width") + 1)
    places = places.withColumn("need", _needed(F.col("n") - F.col("width") + 1, F.col("held"), similarity)).where(F.size("places") >= F.col("need"))
    most = F.greatest(F.col("total") - F.col("n"), F.lit(0))

    def around(i: Column) -> Column:
        """The starts of windows that hold the places from i to the needed one."""
        lo = F.greatest(F.get("places", i + F.col("need") - 1) - F.col("held") + 1, F.lit(0))
        hi = F.least(F.get("places", i), most)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("places") - F.col("need")), around)))
    places = places.select("doc_id", "text_key", "n", "width", "need", starts.alias("starts")).where(F.size("starts") > 0)
    places = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("n", "width", "need", "starts")).alias("sizes"))
    places = scratch.save(places, "places")
    chosen = places.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    there = text.join(small(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    found = places.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "sizes")
    there = there.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))

    sized = there.select("doc_id", "text_key", "words", F.explode("sizes").alias("s")).select("doc_id", "text_key", "words", "s.n", "s.width", "s.starts")
    laid = sized.select("doc_id", "text_key", "n", "width", "words", F.explode("starts").alias("start_word"))
    windows = laid.select("doc_id", "text_key", "n", "width", "start_word", F.slice("words", F.col("start_word") + 1, F.col("n")).alias("window"))
    windows = windows.select("doc_id", "text_key", "n", "start_word", F.size("window").alias("n_words"), _shingles(F.col("window"), F.col("width")).alias("shingles"))
    windows = scratch.save(windows, "windows")
    item = scratch.save(bench.select("item_id", "item_key", "n", _shingles(F.col("item_words"), F.col("width")).alias("item_shingles")), "item")
    index = with_fingerprint(item, "item_shingles", "item_fp").select("item_id", "item_key", "n", "item_fp")
    index = index.select("*", F.explode(blocks(F.col("item_fp"))).alias("k")).select("item_id", "item_key", "n", "item_fp", "k.*")
    at = ["doc_id", "text_key", "n", "start_word"]
    keyed = with_fingerprint(windows, "shingles", "fp").select(*at, "fp", F.explode(blocks(F.col("fp"))).alias("k")).select(*at, "fp", "k.*")
    near = keyed.join(small(index), ["n", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.groupBy(*at, "item_key").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull().cast("int")).alias("no_id"))
    near = scratch.save(near.withColumn("doc", F.struct("doc_id")).drop("doc_id"), "near")
    held = windows.withColumn("doc", F.struct("doc_id")).join(near, ["doc", "text_key", "n", "start_word"])
    held = held.join(item.select("item_key", "item_shingles").dropDuplicates(["item_key"]), "item_key")
    ids = F.when(F.col("no_id") == 1, F.concat("ids", F.array(F.lit(None).cast(items.schema["item_id"].dataType)))).otherwise(F.col("ids"))
    near = held.select("doc_id", "text_key", "start_word", "n", "n_words", "item_key", "shingles", "item_shingles", F.explode(ids).alias("item_id"))
    # the shingles are columns behind a shuffle, so that no lambda of the similarity builds them again
    near = near.groupBy("doc_id", "text_key", "start_word", "n", "item_id", "item_key").agg(
        F.first("shingles").alias("shingles"), F.first("item_shingles").alias("item_shingles"), F.first("n_words").alias("n_words")
    )
    scored = near.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles")))
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(
        F.min_by(F.struct("start_word", "n_words", "similarity"), F.struct(-F.col("similarity"), F.col("start_word"))).alias("b")
    )
    return best.select("doc_id", "text_key", "item_id", "b.start_word", "b.n_words", "b.similarity").where(F.col("similarity") >= similarity)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; the others stay whole and unchanged."""
    found = contaminated(docs, items).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    found = Scratch(docs.sparkSession, "decontaminate").save(found, "found")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    return docs.join(small(found), same, "left_anti")


def op9_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))
