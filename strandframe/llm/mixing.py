"""Mixing sources to target weights by pivotal dependent rounding.

A source that must give r times its words gives each document floor(r) copies
and one more with probability r - floor(r). The additional copies are drawn
together: two documents meet, one passes probability to the other, at random
and weighted by their words, until one of them is settled at 0 or 1; the rest
goes on to the next. Each meeting keeps the words and the expected copies of
the pair. Meetings run in chunks of some tens of documents of like size, and
what a chunk leaves meets in chunks of chunks: a reduction tree over the whole
table without a large group. A few open documents of each size are left at its
top. There the largest is settled first and as many of the next as are needed
share what it leaves, and so on, so that the smallest are open to the end and a
source's words miss their target by no more than these, if they can make up for
the largest at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import WORD, small
from strandframe.scratch import Scratch

#: Each source's target is at most so many times its size.
MOST = 3.0
#: The weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Units that meet in one chunk, and those of each size that are left to the top of the tree.
FAN_IN, LEFT = 32, 8
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id, source and text; which of them are null counts too, as the hash skips nulls."""
    cols = [docs["doc_id"], docs["source"], docs["text"].cast("string")]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target from sizes (source, source_size, n_docs): a row for each source.

    Sources by code point, null last, take the weights in order, repeating.
    share of all words is dealt by weight; no target exceeds most times its
    source's size, and the excess is dealt to the others by weight until none
    does: target = least(cap, level * weight) with one level for all. The table
    of sources is small (a row for each), so one task may order it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    named = sizes.withColumn("rank", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    filled = (
        named.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    )
    # sources in the order in which they reach their cap; the first that stays below it sets the level
    below = F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))
    level = F.min_by("level", below).over(everything)
    return filled.select("source", "source_size", "n_docs", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


_UNIT = "struct<id:bigint,h:bigint,w:bigint,p:double>"


def _unit(u: Column, p: Column) -> Column:
    """The unit u with the probability p."""
    return F.struct(u["id"].alias("id"), u["h"].alias("h"), u["w"].alias("w"), p.alias("p")).cast(_UNIT)


def _draw(level: Column, *hashes: Column) -> Column:
    return F.pmod(F.xxhash64(level, *hashes), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pair(r: Column, x: Column, level: Column) -> tuple[Column, Column, Column]:
    """A meeting of two units: both with their new probabilities, and whether r is the one that is settled."""
    up, down = F.least(r["w"] * (1 - r["p"]), x["w"] * x["p"]), F.least(r["w"] * r["p"], x["w"] * (1 - x["p"]))
    gain = F.when(_draw(level, r["h"], x["h"]) * (up + down) < down, up).otherwise(-down)
    rp, xp = r["p"] + gain / r["w"], x["p"] - gain / x["w"]
    return _unit(r, rp), _unit(x, xp), (rp < _NEAR) | (rp > 1 - _NEAR)


def _meet(chunk: Column, level: Column) -> Column:
    """The fold of one chunk: rest is the unit that is not settled yet, done the settled ones."""

    def step(acc: Column, x: Column) -> Column:
        mine, other, settled = _pair(acc["rest"], x, level)
        return F.struct(
            F.when(settled, other).otherwise(mine).alias("rest"),
            F.concat(acc["done"], F.array(F.when(settled, mine).otherwise(other))).alias("done"),
        )

    first = F.struct(_unit(chunk[0], chunk[0]["p"]).alias("rest"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(F.slice(chunk, 2, F.size(chunk)), first, step)


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _close(units: Column, level: Column) -> Column:
    """The settled units of an array, largest first.

    The first is taken with its probability p, and the words by which this
    misses p are handed to those after it, each bearing such a share of them,
    the same whether it is taken or not, as it can take either way: their
    expectations stay, and only as many of the largest are touched as are
    needed. If all together cannot bear it and the next is of like size, the two
    meet as a pair instead. Every step settles one unit.
    """

    def room(head: Column, u: Column) -> Column:
        """The share of what head leaves that u can bear, either way."""
        loss, win = head["w"] * (1 - head["p"]), head["w"] * head["p"]
        return F.least(u["w"] * u["p"] / F.greatest(loss, F.lit(_NEAR)), u["w"] * (1 - u["p"]) / F.greatest(win, F.lit(_NEAR)))

    def step(acc: Column, _: Column) -> Column:
        head, tail = acc["open"][0], F.slice(acc["open"], 2, F.size(acc["open"]))
        able = F.aggregate(tail, F.lit(0.0), lambda t, u: t + room(head, u))
        taken = (_draw(level, head["h"]) < head["p"]).cast("double")
        met = _bound(F.struct(head.alias("head"), tail.alias("tail"), able.alias("able"), taken.alias("taken")), settle)
        return F.struct(met["open"].alias("open"), F.concat(acc["done"], F.array(met["done"])).alias("done"))

    def settle(m: Column) -> Column:
        head, tail = m["head"], m["tail"]

        def bear(acc: Column, u: Column) -> Column:
            part = F.least(acc["left"], room(head, u))
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u["p"] - part * head["w"] * (m["taken"] - head["p"]) / u["w"]))
            return F.when(acc["left"] > 0, F.struct((acc["left"] - part).alias("left"), F.concat(acc["touched"], F.array(_unit(u, p))).alias("touched"))).otherwise(acc)

        none = F.struct(F.lit(1.0).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("touched"))
        touched = F.aggregate(tail, none, bear, lambda acc: acc["touched"])
        pool = _bound(touched, lambda t: F.struct(F.concat(t, F.slice(tail, F.size(t) + 1, F.size(tail))).alias("open"), _unit(head, m["taken"]).alias("done")))
        after = F.get(tail, F.lit(0))
        one, two, settled = _pair(head, after, level)
        rest = F.slice(tail, 2, F.size(tail))
        pair = F.struct(F.concat(F.array(F.when(settled, two).otherwise(one)), rest).alias("open"), F.when(settled, one).otherwise(two).alias("done"))
        return F.when((F.size(tail) > 0) & (m["able"] < 1) & (after["w"] * 2 >= head["w"]), pair).otherwise(pool)

    first = F.struct(units.alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(units, first, step, lambda acc: acc["done"])


def round_copies(units: DataFrame, n_most: int, scratch: Scratch, seed: int = 42, fan_in: int = FAN_IN, left: int = LEFT) -> DataFrame:
    """id, extra (0 or 1) for units (source, id, h, w, p): w > 0 words, probability p, h a hash that orders and draws.

    n_most: the most units of a source. Units of like size meet first, in
    chunks, until some `left` of each size and source are open; these are
    closed together, largest first.
    """
    kind = F.floor(F.log(F.col("w").cast("double")) / math.log(1.25)).cast("int")
    rest = units.select("source", kind.alias("kind"), F.xxhash64("h", F.lit(seed)).alias("chunk"), F.struct("id", "h", "w", "p").alias("u"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("u.w")).alias("o"), F.col("u.h"), F.col("u.id"), F.col("u.w"), F.col("u.p"))))
    done, depth, most = None, 0, n_most
    while most > left:
        most = max(left, math.ceil(most / fan_in))
        dealt = rest.withColumn("chunk", F.pmod(F.col("chunk"), F.lit(most)).cast("long"))
        met = dealt.groupBy("source", "kind", "chunk").agg(ordered.alias("us")).select("source", "kind", "chunk", _meet(F.col("us"), F.lit(seed + depth)).alias("m"))
        met = scratch.save(met, "met")
        settled = met.select(F.explode("m.done").alias("u"))
        done = settled if done is None else done.unionByName(settled)
        rest, depth = met.select("source", "kind", "chunk", F.col("m.rest").alias("u")), depth + 1
    last = rest.groupBy("source").agg(F.transform(ordered, lambda u: _unit(u, u["p"])).alias("us"))
    last = scratch.save(last.select(F.explode(_close(F.col("us"), F.lit(seed + depth))).alias("u")), "last")
    done = last if done is None else done.unionByName(last)
    return done.select("u.id", (F.col("u.p") > 0.5).cast("int").alias("extra"))


def fitting(units: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """source, id, h, w, p of units (source, id, w, p, more, less): more are the words that the source gives in additional copies, less those of the copies that it does not give.

    A unit larger than more (or less, if that is fewer) could only be taken (or
    left) with more words than all that are meant. If smaller units make up
    for it, these share more by like probabilities, and the large one gets 0 (or 1).
    """
    short = F.least("more", "less")
    sums = units.groupBy("source").agg(F.sum(F.when(F.col("w") <= short, F.col("w"))).alias("small"), F.first(short).alias("short"))
    sums = scratch.save(sums.where(F.col("small") > F.col("short")).select(F.col("source").alias("s"), (F.col("short") / F.col("small")).alias("share")), "fitting")
    at = units.join(small(sums), F.col("source").eqNullSafe(F.col("s")), "left")
    few = F.col("more") <= F.col("less")
    fits = F.when(F.col("w") <= short, F.when(few, F.col("share")).otherwise(1 - F.col("share"))).otherwise(F.when(few, 0.0).otherwise(1.0))
    return at.select("source", "id", F.xxhash64("id", F.lit(seed)).alias("h"), "w", F.when(F.col("share").isNull(), F.col("p")).otherwise(fits).alias("p"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, source, text).

    copies is how often the mix takes the document, at most `most` times;
    taken = copies * size. Documents of a source have the same expected copies,
    but for those larger than all words that additional copies may add or miss. A null source is a source, and null, empty or blank
    texts have size 0 and take floor(target / source_size) copies (1 if their
    source has no words at all). Rows are told apart by doc_id, source and
    text; rows that are equal in these count as one document of all their words
    and are taken equally often. Reruns agree. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(docs).alias("id"))
    sized = scratch.save(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = scratch.save(targets(sums, weights, share, most), "targets")
    n_sources, n_most = goals.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    goal = goals.select(F.col("source").alias("s"), "source_size", "target")
    rated = sized.join(small(goal, n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(ratio + _NEAR)
    rated = rated.withColumn("base", whole.cast("int")).withColumn("p", ratio - whole)
    open_ = rated.where((F.col("p") > _NEAR) & (F.col("size") > 0))
    units = open_.groupBy("source", "id").agg(F.sum("size").alias("w"), F.first("p").alias("p"), F.first(F.col("p") * F.col("source_size")).alias("more"), F.first((1 - F.col("p")) * F.col("source_size")).alias("less"))
    drawn = round_copies(fitting(scratch.save(units, "units"), scratch, seed), n_most, scratch, seed)
    out = rated.join(drawn, "id", "left").withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("id").alias("row_key"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say, whole; rows with none are left out."""
    drawn = mix(docs, **options).select(F.col("row_key").alias("__key"), F.col("copies").alias("__copies")).dropDuplicates(["__key"])
    drawn = Scratch(docs.sparkSession, "mixing").save(drawn.where("__copies > 0"), "copies")
    taken = docs.join(small(drawn), row_key(docs) == F.col("__key"))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op2_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
