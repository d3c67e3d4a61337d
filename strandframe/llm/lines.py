"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line for each connected group.

The fingerprint has BLOCKS blocks, and every distinct word of a line votes in
one block only, the one that its hash names. A changed word therefore touches two blocks
at most (the old word's and the new one's), however short the line is, and the
others stay equal: lines that differ by one word share a key made of two
blocks. Lines with more changes share one if these fall into few blocks or
leave majorities as they are. Lines that are equal once normalised are one
class. A class is first compared with the first of its keys' members, then the
groups of a key with each other, and at last all members of different groups,
in pairs of blocks of bounded size. Edit similarity decides. All of it is
DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import LANE, connected_components, small
from strandframe.scratch import Scratch

SIMILARITY = 0.8
#: Blocks of a fingerprint, and how many of them make a key.
BLOCKS, KEYED = 4, 2
#: Words of a line that are counted in lanes of 16 bits (up to LANE in lanes of 8, more in lanes of 32), if all were of one letter.
MOST = 16_000
#: Words of a chunk whose edit distance is taken by itself, in long lines.
CHUNK_WORDS = 48
#: Edits over which long lines are taken in chunks.
CHUNK_EDITS = 192
#: Members of a key that one task compares.
KEY_ROWS = 512
#: Edits up to which a pair is compared letter by letter at once; of longer texts, words that agree are looked at first.
FEW_EDITS = 24
#: The bits of the first block; those of the others are next to them.
_BITS = 0x0303030303030303


def normalised(text: Column) -> Column:
    """Lower case, with one space for each run of characters that are neither letters nor digits; lines stay lines. What is left at a line's ends is a space."""
    # a letter costs one test of one class; a space by itself stays as it is
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n](?:[^\p{L}\p{N}\n]+|(?<! ))", " ")


def _lines(docs: DataFrame) -> DataFrame:
    """line_id, doc_id, text_key, line_no, h1, h2, n_bytes, norm: each line with a letter or digit, and for other first lines a row with null line_no and norm."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode_outer(F.split(normalised(text), "\n")).alias("line_no", "norm"))
    rows = rows.withColumn("norm", F.nullif(F.trim("norm"), F.lit(""))).where("norm is not null or line_no is null or line_no = 0")
    no = F.when(F.col("norm").isNotNull(), F.col("line_no"))
    return rows.select(F.monotonically_increasing_id().alias("line_id"), "doc_id", "text_key", no.alias("line_no"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), F.col("norm")).alias("h2"), F.octet_length("norm").alias("n_bytes"), "norm")


def block_of(h: Column) -> Column:
    """The block that a word of hash h votes in."""
    return F.shiftrightunsigned(h, 29).bitwiseXOR(h).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def _votes(h: Column) -> Column:
    """The bits of h in its own block: two of each byte."""
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(_BITS), block_of(h) * 2))


def _counted(words: DataFrame, lane: int) -> DataFrame:
    """line_id, h1, fp, counts (words of each block, 65,535 at most, in lanes of 16 bits) of lines (line_id, h1, hs: hashes of words) whose words fit lanes of so many bits, less one."""
    # outer, though no line is without words: for the other kind, Spark makes hs twice, first to see whether it is empty
    each = words.select("line_id", "h1", F.explode_outer("hs").alias("h"))
    each = each.select("line_id", "h1", _votes(F.col("h")).alias("v"), block_of(F.col("h")).alias("block"))
    ones = sum(1 << i for i in range(0, 64, lane))
    sums = [F.sum((F.shiftrightunsigned("v", s) if s else F.col("v")).bitwiseAND(F.lit(ones))).alias(f"c{s}") for s in range(lane)]
    if lane < 32:
        sizes = [F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block") * 16)).alias("counts")]
        n = [_words_of("counts", b) for b in range(BLOCKS)]
    else:
        sizes = [F.count_if(F.col("block") == b).alias(f"n{b}") for b in range(BLOCKS)]
        n = [F.col(f"n{b}") for b in range(BLOCKS)]
    counted = each.groupBy("line_id").agg(F.max("h1").alias("h1"), *sums, *sizes)
    fp = F.lit(0).cast("long")
    for s in range(lane):
        # a lane with a count over half of its block's words reaches the bit before its highest, and none reaches that
        half = F.floor(n[s % 8 // 2] / 2).cast("long")
        over = (F.col(f"c{s}") + (F.lit((1 << (lane - 2)) - 1).cast("long") - half) * F.lit(ones)).bitwiseAND(F.lit(ones << (lane - 2)))
        over = F.shiftrightunsigned(over, lane - 2)
        fp = fp.bitwiseOR(F.shiftleft(over, s) if s else over)
    counts = F.col("counts")
    if lane == 32:
        counts = F.lit(0).cast("long")
        for b in range(BLOCKS):
            counts = counts.bitwiseOR(F.shiftleft(F.least(n[b], F.lit(0xFFFF).cast("long")), 16 * b))
    return counted.select("line_id", "h1", fp.alias("fp"), counts.alias("counts"))


def _words_of(counts: str, block: int) -> Column:
    return F.shiftrightunsigned(counts, 16 * block).bitwiseAND(F.lit(0xFFFF))


def _fingerprints(lines: DataFrame) -> DataFrame:
    """line_id, h1, fp, counts of lines with norm."""
    # by the bytes that so many words have at least, not the distinct words: a filter on these would split each line once more; longs are cheaper to tell apart and to explode than words
    real, n = lines.where("norm is not null"), F.col("n_bytes")
    lane, most = 2 * LANE - 1, 2 * MOST - 1
    hashes = F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))
    of = lambda rows: rows.select("line_id", "h1", F.array_distinct(hashes).alias("hs"))
    out = _counted(of(real.where(n <= lane)), 8).unionByName(_counted(of(real.where((n > lane) & (n <= most))), 16))
    return out.unionByName(_counted(of(real.where(n > most)), 32))


def _choices(fp: Column, counts: str) -> Column:
    """The key of each choice of KEYED blocks of a fingerprint, null where these do not hold a quarter of its words, and at least three (two of up to five)."""
    n = [_words_of(counts, b) for b in range(BLOCKS)]
    all_ = n[0] + n[1] + n[2] + n[3]
    out = []
    for choice in combinations(range(BLOCKS), KEYED):
        mask = sum(_BITS << (2 * b) for b in choice)
        mask -= (mask >> 63) << 64
        held = sum((n[b] for b in choice[1:]), n[choice[0]])
        out.append(F.when((held >= F.when(all_ > 5, 3).otherwise(2)) & (held * 4 >= all_), F.xxhash64(F.lit(choice[0]), F.lit(choice[1]), fp.bitwiseAND(F.lit(mask)))))
    return F.array(*out)


def _keys(fp: Column, counts: str) -> Column:
    """The keys of a fingerprint."""
    return F.array_compact(_choices(fp, counts))


def _aligned(wa: Column, wb: Column) -> Column:
    """Letters that change if words are paired in order, where up to three words may be new or missing at a place: at least the edit distance."""
    at = lambda w, i: F.get(w, i)
    size = lambda w: F.length(w) + 1

    def step(s: Column, i: Column) -> Column:
        x, y = at(wa, i), at(wb, s["j"])
        j, cost = s["j"], s["cost"]
        to = lambda jump, more: F.struct((j + jump).alias("j"), (cost + more).alias("cost"))
        skipped = lambda k: sum((size(at(wb, j + m)) for m in range(1, k)), size(y))
        out = F.when(y.isNull(), to(0, size(x))).when(x == y, to(1, F.lit(0)))
        for k in (1, 2, 3):
            out = out.when(at(wb, j + k) == x, to(k + 1, skipped(k))).when(at(wa, i + k) == y, to(0, size(x)))
        return out.otherwise(to(1, F.greatest(F.length(x), F.length(y))))

    rest = lambda s: s["cost"] + F.aggregate(F.slice(wb, s["j"] + 1, F.size(wb)), F.lit(0), lambda n, w: n + size(w))
    return F.aggregate(F.sequence(F.lit(0), F.size(wa) - 1), F.struct(F.lit(0).alias("j"), F.lit(0).alias("cost")), step, rest)


def _in_chunks(wa: Column, wb: Column) -> Column:
    """The sum of the edit distances of chunks at the same share of both lists of words: at least the edit distance, near it where changes are spread evenly."""
    n = F.ceil(F.greatest(F.size(wa), F.size(wb)) / CHUNK_WORDS).cast("int")

    def part(w: Column, k: Column) -> Column:
        at = lambda i: F.floor(i.cast("long") * F.size(w) / n).cast("int")
        return F.array_join(F.slice(w, at(k) + 1, at(k + 1) - at(k)), " ")

    # an empty chunk has no space beside it
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.levenshtein(part(wa, k), part(wb, k)) + F.when((part(wa, k) == "") != (part(wb, k) == ""), 1).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def edit_similarity(pairs: DataFrame, a: str, b: str, least: float, exact: bool = True) -> DataFrame:
    """pairs with similarity: 1 - edit distance / length of the longer of columns a and b, or null if that is below least.

    Words that both texts start or end with are cut off first, which leaves the
    distance as it is and long texts with few changes short; texts too short for
    more than FEW_EDITS stay whole. With exact false,
    the value is one by _aligned or _in_chunks where that is least or more.
    """
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    cut = lambda w: F.slice(w, (F.col("head") + 1).cast("int"), (F.size(w) - F.col("head") - F.col("tail")).cast("int"))
    longer = F.greatest(F.length(a), F.length(b))
    whole = F.least(F.size("wa"), F.size("wb"))
    # 1 - least is rounded, so a little more is let in; the similarity below decides
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    long = most > FEW_EDITS
    # one step at a time, so that each is computed once; no words, nothing to compute in the steps that follow
    steps = pairs.withColumns({"wa": F.when(long, F.split(a, " ")), "wb": F.when(long, F.split(b, " "))})
    steps = steps.withColumns({"first": same(F.col("wa"), F.col("wb")), "last": same(F.reverse("wa"), F.reverse("wb"))})
    steps = steps.withColumn("head", F.when(F.col("first") == 0, whole).otherwise(F.col("first") - 1))
    steps = steps.withColumn("tail", F.least(F.when(F.col("last") == 0, whole).otherwise(F.col("last") - 1), whole - F.col("head")))
    steps = steps.withColumns({"ca": cut(F.col("wa")), "cb": cut(F.col("wb"))})
    steps = steps.withColumns({"ma": F.array_join("ca", " "), "mb": F.array_join("cb", " ")})
    # a narrow band is tried first, at little cost for the pairs that need the whole one
    within = lambda n: F.nullif(F.call_function("levenshtein", "ma", "mb", n), F.lit(-1))
    distance = F.coalesce(within(F.floor(most / 16).cast("int")), F.call_function("levenshtein", "ma", "mb", most))
    # a text that has no words left differs in one space more
    gap = F.when((F.size("ca") == 0) != (F.size("cb") == 0), 1).otherwise(0)
    if not exact:
        some = (F.size("ca") > 0) & (F.size("cb") > 0)
        steps = steps.withColumn("bound", F.when(some, _aligned(F.col("ca"), F.col("cb"))))
        chunked = F.when(some & (most > CHUNK_EDITS), _in_chunks(F.col("ca"), F.col("cb")))
        steps = steps.withColumn("chunked", F.when(F.col("bound") > most, chunked))
        distance = F.when(F.col("bound") <= most, F.col("bound")).when(F.col("chunked") <= most, F.col("chunked")).otherwise(distance)
    steps = steps.withColumn("distance", F.when(long, distance).otherwise(F.call_function("levenshtein", a, b, most))).withColumn("gap", gap)
    value = F.when(F.col("distance") >= 0, 1 - (F.col("distance") + F.col("gap")) / longer)
    return steps.withColumn("similarity", F.when(value >= least, value)).select(*pairs.columns, "similarity")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs that are similar. The similarity is written before it is filtered: a filter would be pushed into its steps and evaluate them many times over."""
    pairs = scratch.save(pairs, "pairs")
    # only the texts of pairs are shuffled
    used = small(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    of = texts.join(used, "h1", "left_semi")
    ta, tb = (of.select(F.col("h1").alias(c), F.col("norm").alias(f"t{c}")) for c in "ab")
    both = pairs.join(ta, "a").join(tb, "b")
    both = both.where(F.least(F.length("ta"), F.length("tb")) >= F.greatest(F.length("ta"), F.length("tb")) * (least - 1e-9))
    scored = scratch.save(edit_similarity(both, "ta", "tb", least, False).select("a", "b", "similarity"), "similarity")
    return scored.where("similarity is not null").select("a", "b")


def _open(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """key, h1, component for the members of keys that still lie in several groups."""
    at = members.join(small(groups.withColumnRenamed("node", "h1")), "h1", "left").select("key", "h1", F.coalesce("component", "h1").alias("component"))
    several = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return at.join(small(scratch.save(several, "several")), "key", "left_semi")


def _joined(groups: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component of groups and pairs (a, b) together. A component is the least of its nodes, so only those that pairs meet are looked at, each as one node."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    met = scratch.save(connected_components(ends, scratch), "met")
    to = small(met.select(F.col("node").alias("component"), F.col("component").alias("to")))
    old = groups.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.save(old.unionByName(met.join(groups, "node", "left_anti")), "groups")


def groups_of(members: DataFrame, texts: DataFrame, least: float, scratch: Scratch, key_rows: int = KEY_ROWS) -> DataFrame:
    """node, component of the classes that are similar to another; members has key, h1 and lo (the first of the key)."""
    star = members.where("h1 <> lo").groupBy(F.col("h1").alias("b")).agg(F.min("lo").alias("a")).select("a", "b")
    edges = scratch.save(_verified(star, texts, least, scratch), "star")
    groups = scratch.save(connected_components(edges, scratch), "groups")

    # the first members of a key's groups, compared with the first of all of them
    at = scratch.save(_open(members.select("key", "h1"), groups, scratch), "open")
    firsts = at.groupBy("key", "component").agg(F.min("h1").alias("b"))
    lead = firsts.groupBy("key").agg(F.min_by("b", "component").alias("a"))
    between = firsts.join(lead, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.save(_verified(between.join(star, ["a", "b"], "left_anti"), texts, least, scratch), "between")
    groups = _joined(groups, more, scratch)

    # all pairs of what is still apart; a key of many members is dealt into parts, and a task compares two of them
    at = scratch.save(_open(at.select("key", "h1"), groups, scratch).join(texts.select("h1", F.length("norm").alias("len")), "h1"), "apart")
    parts = at.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / key_rows).cast("int").alias("parts"))
    dealt = at.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "h1", "component", "len")
    left = dealt.where("part = i").select("key", "i", "j", F.col("h1").alias("a"), F.col("component").alias("ca"), F.col("len").alias("la"))
    right = dealt.where("part = j").select("key", "i", "j", F.col("h1").alias("b"), F.col("component").alias("cb"), F.col("len").alias("lb"))
    apart = left.join(right, ["key", "i", "j"]).where((F.col("ca") != F.col("cb")) & ((F.col("i") != F.col("j")) | (F.col("a") < F.col("b"))))
    apart = apart.where(F.least("la", "lb") >= F.greatest("la", "lb") * (least - 1e-9)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.save(_verified(apart, texts, least, scratch), "more")
    return groups if more.isEmpty() else _joined(groups, more, scratch)


def line_decisions(docs: DataFrame, similarity: float = SIMILARITY, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, text_key, line_no, first: each line with a letter or digit, and whether it is the first of its group and stays.

    Two lines are similar if their fingerprints share a key and their edit
    similarity, once normalised, is at least similarity; groups are connected
    by such pairs. The first line of a group by (doc_id, text_key, line_no),
    nulls first, stays. A document whose first line has no letter or digit
    (null and empty ones too) has a row with null line_no. Rows equal in doc_id
    and text are one document, so both keep their first lines. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(_lines(docs), "lines")
    classes = _fingerprints(lines).groupBy("h1").agg(F.min("fp").alias("fp"), F.min("counts").alias("counts"))
    classes = scratch.save(classes, "classes")
    keyed = classes.select("h1", F.explode_outer(_choices(F.col("fp"), "counts")).alias("key")).where("key is not null")
    shared = scratch.save(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key", "lo"), "shared")
    members = scratch.save(keyed.join(small(shared), "key"), "members")
    wanted = scratch.save(members.select("h1").distinct(), "wanted")
    found = lines.where("norm is not null").select("h1", "h2", "norm").join(small(wanted), "h1")
    texts = scratch.save(found.groupBy("h1").agg(F.min(F.struct("h2", "norm")).alias("x")).select("h1", "x.h2", "x.norm"), "texts")
    groups = groups_of(members, texts, similarity, scratch, key_rows)
    named = scratch.save(groups.select(F.col("node").alias("h1"), "component").join(texts.select("h1", F.col("h2").alias("own")), "h1"), "named")

    # a line that shares only one of its two hashes with a class is not of it
    of = lines.drop("norm", "line_id", "n_bytes").join(small(named), "h1", "left")
    grouped = F.col("component").isNotNull() & (F.col("own") == F.col("h2"))
    of = of.select("doc_id", "text_key", "line_no", F.when(grouped, F.col("component")).otherwise(F.col("h1")).alias("g1"), F.when(grouped, F.lit(None).cast("long")).otherwise(F.col("h2")).alias("g2"))
    place = F.struct("doc_id", "text_key", "line_no")
    # two longs group by hash; a struct of them would be sorted
    repeated = of.where("line_no is not null").groupBy("g1", "g2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("m")).where("m > 1")
    repeated = scratch.save(repeated.select(F.col("g1").alias("r1"), F.col("g2").alias("r2"), "place"), "repeated")
    marked = of.join(small(repeated), (F.col("g1") == F.col("r1")) & F.col("g2").eqNullSafe(F.col("r2")), "left")
    kept = F.col("line_no").isNull() | F.col("place").isNull() | (F.col("place") == place)
    return marked.select("doc_id", "text_key", "line_no", kept.alias("first"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines that repeat an earlier one taken from text; lines without a letter or digit stay."""
    gone = line_decisions(docs, **options).where(~F.col("first")).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__gone")
    text = docs["text"].cast("string")
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return out.select(*[F.when(F.col("__gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op5_query(docs: DataFrame) -> DataFrame:
    """A row for each document (rows equal in doc_id and text give one): its lines with a letter or digit, those kept, and the numbers of the others."""
    found = line_decisions(docs)
    # a row that repeats brings its lines again, and of each row there is just one first line, which may have no number
    gone = F.sort_array(F.collect_set(F.when(~F.col("first"), F.col("line_no"))))
    n_rows = F.count_if(F.coalesce("line_no", F.lit(0)) == 0)
    out = found.groupBy("doc_id", "text_key").agg(F.floor(F.count("line_no") / n_rows).cast("long").alias("n_lines"), gone.alias("removed"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")
