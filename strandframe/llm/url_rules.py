"""URL filters: host and path rules, and association rules over URL tokens mined by FP-growth.

Labelled URLs are baskets of tokens and a label. FP-growth finds the frequent
token combinations; those whose share of blocked URLs reaches the confidence
become rules. Only minimal ones are kept, as a rule whose tokens include those
of another adds nothing. A rule is indexed under its rarest token, so a URL
meets the rules of its own tokens only and is checked against their others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import small
from strandframe.scratch import Scratch

#: Rules of op3: host and the start of a path, and what they say.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A combination is in so large a share of the labelled URLs at least, and so large a share of those with it is blocked.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Labelled URLs that hold a combination, at least; fewer say nothing.
LEAST = 20
_BLOCKED = "\u0000blocked"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and where there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    rules: (host/start of the path, verdict), a list that people write. A rule
    fits its host and all subdomains.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host_: Column, path_: Column, url: Column) -> Column:
    """The distinct tokens of a URL: host:label, path:word and query:name of each, and scheme:name. Numbers count as one token."""
    words = lambda c, kind: F.transform(
        F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(kind), F.when(w.rlike("^[0-9]+$"), "#").otherwise(F.lower(w)))
    )
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    names = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query:"), F.lower(F.substring_index(q, "=", 1)))
    )
    all_ = F.concat(words(host_, "host:"), words(path_, "path:"), names, F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), F.lower(scheme)))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.array_distinct(all_), F.array().cast("array<string>"))


def token_classes(baskets: DataFrame, least: int = LEAST) -> DataFrame:
    """token, stands_for of the tokens that at least `least` baskets (id, tokens) hold: tokens of just the same baskets are one, the least of them.

    Where one of these is in a rule, each other would make a rule as good, so a
    URL with any of them meets it; and the many tokens of one long URL, which
    come together always, make one item and not all its combinations.
    """
    each = baskets.select("id", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *where).where(F.col("n") >= least)
    first = held.groupBy("n", "x0", "x1").agg(F.min("token").alias("stands_for"))
    return held.join(first, ["n", "x0", "x1"]).select("token", "stands_for")


def mine(baskets: DataFrame, scratch: Scratch, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """rule_id, tokens, anchor, support, confidence from baskets (tokens, blocked).

    Support is the share of all baskets (at least `least` of them), confidence
    the share of blocked ones among those with the tokens. anchor is the rarest token. The rules are as
    many as combinations pass support, however many baskets there are.
    """
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(_BLOCKED)))).otherwise(F.col("tokens"))
    # equal baskets are rare enough to be left as they are; the order of tokens is set by their frequency in FP-growth
    total = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / max(total, 1))), minConfidence=confidence).fit(baskets.select(items.alias("items")))
    frequent = scratch.save(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    plain = frequent.where(~F.array_contains("items", _BLOCKED)).select(F.col("items").alias("tokens"), F.col("freq").alias("n"))
    bad = frequent.where(F.array_contains("items", _BLOCKED) & (F.size("items") > 1))
    bad = bad.select(F.array_remove("items", _BLOCKED).alias("tokens"), F.col("freq").alias("n_blocked"))
    rules = bad.join(plain, "tokens").withColumn("confidence", F.col("n_blocked") / F.col("n")).where(F.col("confidence") >= confidence)
    rules = scratch.save(rules.withColumn("rule_id", F.xxhash64("tokens")), "candidates")
    # a rule goes if another one's tokens are among its own
    pairs = rules.select("rule_id", "tokens", F.explode("tokens").alias("anchor"))
    lone = plain.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("anchor"), F.col("n").alias("n_anchor"))
    anchors = pairs.join(lone, "anchor").groupBy("rule_id").agg(F.min_by("anchor", F.struct("n_anchor", "anchor")).alias("anchor"))
    rules = rules.join(anchors, "rule_id")
    shorter = rules.select(F.col("rule_id").alias("other"), F.col("tokens").alias("fewer"), "anchor")
    within = pairs.join(shorter, "anchor").where((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0))
    minimal = rules.join(within.select("rule_id").distinct(), "rule_id", "left_anti")
    return minimal.select("rule_id", "tokens", "anchor", (F.col("n") / F.lit(float(max(total, 1)))).alias("support"), "confidence")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); labels (doc_id, quality) speak for the page of that number.

    The longest rule that fits decides; otherwise a URL that holds all tokens of
    a mined rule is blocked, and others are allowed. A null url has no host, no
    path and no tokens and is allowed. Labels other than 0 (blocked) and 1 are
    left out, a page with both is blocked. Without labels nothing is mined.
    Repeated rows give repeated results; an empty table gives none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    cut = pages.select("page_id", url.alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    cut = cut.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg((F.min("quality") == 0).alias("blocked"))
    baskets = cut.join(small(known), cut["page_id"] == known["doc_id"]).select(F.monotonically_increasing_id().alias("id"), "tokens", "blocked")
    baskets = scratch.save(baskets, "baskets")
    ruled = cut.withColumn("curated", longest_rule(F.col("host"), F.col("path"), rules))
    if baskets.isEmpty():
        return ruled.select("page_id", "host", "path", "curated.rule", F.coalesce("curated.verdict", F.lit("allow")).alias("verdict"))
    classes = scratch.save(token_classes(baskets), "classes")
    of = lambda df, key: df.select(*key, F.explode("tokens").alias("token")).join(small(classes), "token").groupBy(*key).agg(F.collect_set("stands_for").alias("items"))
    bare = baskets.select("id", "blocked").join(of(baskets, ["id"]), "id", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "blocked")
    mined = scratch.save(mine(bare, scratch, support, confidence), "rules")
    index = mined.select("rule_id", F.col("tokens").alias("needs"), "anchor")
    # what the mined rules say of a URL depends on its tokens alone, so each set of tokens is matched once
    sets = of(ruled.where("curated is null").select("tokens").distinct().select("tokens", F.col("tokens").alias("set")), ["set"])
    matched = sets.select("set", "items", F.explode("items").alias("anchor")).join(small(index), "anchor").where(F.size(F.array_except("needs", "items")) == 0)
    blocked = scratch.save(matched.groupBy(F.col("set").alias("tokens")).agg(F.min("rule_id").alias("mined_rule")), "matched")
    out = ruled.join(small(blocked), "tokens", "left")
    verdict = F.when(F.col("curated").isNotNull(), F.col("curated.verdict")).when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "curated.rule", verdict.alias("verdict"))


def op3_query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, labels)
