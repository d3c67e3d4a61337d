"""Operators and the pipeline against brute force over the smallest tables, planted cases and held-out labels."""

import math
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import common, decontaminate, lines, mixing, nndescent, quality, simhash, token_counts, tokens, toxicity, url_rules
from strandframe.scratch import Scratch
from tests.llm import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return common.load(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in common.load(spark, SF, "benchmark").collect()}


def test_simhash(docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_query(docs).collect()}
    exp = brute.simhash_groups(texts, 4, 4)
    assert got == {d: (f"{brute.fingerprint(t, 4):016x}", exp[d]) for d, t in texts.items()}


def test_large_cells(spark):
    """Groups of near fingerprints whose cells are dealt into blocks give the groups of all pairs."""
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(150)} | {rnd.getrandbits(64) for _ in range(100)}
    signed = [f - (f >> 63 << 64) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    groups, exp = brute.Union(), brute.Union()
    for e in simhash.links(df, 4, Scratch(spark, "t"), cell_rows=16).collect():
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4
        groups.join(e.a, e.b)
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                exp.join(a, b)
    assert {f: groups.find(f) for f in signed} == {f: exp.find(f) for f in signed}


def test_manhattan_bound(spark):
    """The Manhattan distance of segment counts never exceeds the Hamming distance, leaves out most pairs that meet, and pairs within reach meet in a cell."""
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << x for x in rnd.sample(range(64), k % 7)) for k, f in enumerate(fps * 3)]
    rows = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long").withColumn("counts", simhash.segment_counts(F.col("fp")))
    counts = [sum((f >> 2 * s & 3).bit_count() << 2 * s for s in range(32)) for f in fps]
    for radius in (2, 4, 6, 8):
        got = [(r.counts & (2**64 - 1), {(k.part, k.cell) for k in r.k}) for r in rows.select("counts", simhash._cells(F.col("counts"), radius).alias("k")).collect()]
        met = far = 0
        for i, a in enumerate(fps):
            for j in range(i):
                manhattan = sum(abs((counts[i] >> 2 * s & 3) - (counts[j] >> 2 * s & 3)) for s in range(32))
                hamming = (a ^ fps[j]).bit_count()
                assert manhattan == (got[i][0] ^ got[j][0]).bit_count() <= hamming
                both = bool(got[i][1] & got[j][1])
                assert both or manhattan > radius
                met, far = met + both, far + (both and manhattan > radius)
        assert met and (radius != 8 or far)


def test_repeated_documents(spark):
    """Rows equal in doc_id and text give one; a text that shares its doc_id with a copy of another is judged by itself."""
    other = "quite another text of which no copy is here at all"
    rows = [(1, "one two three four five six seven", "a"), (7, "one two three four five six seven", "b"), (7, other, "c"), (7, other, "d"), (8, "the last text is alone", "e"), (None, other, "f"), (None, other, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)] + [(5, 5)]
    u = brute.Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: u.find(x) for e in edges for x in e if e[0] != e[1]}


def test_native_simhash(spark):
    rnd = random.Random(2)
    rows = [(n, [rnd.getrandbits(64) - (1 << 63) for _ in range(n)]) for n in (0, 1, 2, 63, 126, 127, 128, 300)]
    got = spark.createDataFrame(rows, "n int, h array<long>").select("n", common.simhash(F.col("h"), F.col("n")).alias("s")).collect()
    exp = {n: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n) for n, h in rows}
    assert {r.n: r.s & (2**64 - 1) for r in got} == exp


def test_decontamination(spark, docs, texts, items):
    bench = common.load(spark, SF, "benchmark")
    planted = spark.createDataFrame([(10_000, "x " + items[0] + " y", "", "", 0), (10_001, " ".join(items[1].split()[1:]) + " end", "", "", 0), (10_002, " ".join(items[2].split()[:10]), "", "", 0)], docs.schema)
    all_ = docs.unionByName(planted)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op9_query(all_, bench).collect()}
    exp = brute.contaminated({r.doc_id: r.text for r in all_.collect()}, items)
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-6 for k in got)
    assert (10_000, 0) in got and (10_001, 1) in got and not any(d == 10_002 for d, _ in got)


def test_edited_passages(spark, items):
    """Items with one word replaced, short ones too, are found wherever their similarity says so, and nowhere else."""
    rnd, texts, items = random.Random(9), {}, {i: t for i, t in items.items() if i < 10}
    for i, item in items.items():
        words = (item or "").split()
        for n in (len(words), 14, 20):
            if len(words) >= n > 0:
                for at in {0, n - 1, n // 2, rnd.randrange(n)}:
                    texts[len(texts)] = " ".join(["before", *words[:at], "zzz", *words[at + 1 : n], "after"])
    bench = {**items, **{1000 + i: " ".join((t or "").split()[:n]) for i, t in items.items() for n in (14 + 6 * (i % 2),)}, 5000: "and so and so and so and so and so and so", 5001: "one two three"}
    texts |= {len(texts): "and so and so and so and so and so and so and", len(texts) + 1: "one two", len(texts) + 2: "zero one two three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = decontaminate.op9_query(docs, spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()
    got, exp = {(r.doc_id, r.item_id): r.similarity for r in found}, brute.contaminated(texts, bench)
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-6 for k in got) and len(found) == len(got)
    assert min(exp.values()) < 0.85


def test_lines(docs, texts):
    few = {d: t for d, t in texts.items() if d % 3 == 0}
    found = lines.line_decisions(docs.where("doc_id % 3 = 0")).where("line_no is not null").collect()
    assert {(r.doc_id, r.line_no): r.first for r in found} == brute.line_firsts(few)


def test_fuzzy_lines(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long + "\nthe of the"), (2, long.replace("word30", "word3O") + "\nthe and the"), (3, "Word0, " + long[6:] + "!\nthe, OF the"), (4, "nothing alike here")]
    got = {(r.doc_id, r.line_no): r.first for r in lines.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.line_firsts(dict(rows))
    assert not got[2, 0] and not got[3, 0] and not got[3, 1] and got[2, 1]


@pytest.fixture(scope="module")
def edited():
    """(number, original, line with one word replaced, inserted or dropped) of lines from 8 to 300 words, at an edit similarity of 0.8 or more."""
    rnd, out = random.Random(12), []
    words = ["".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    common = words[:20]
    for k in range(240):
        n = rnd.choice([8, 10, 14, 20, 30, 50, 126, 140, 300])
        a = [rnd.choice(common if rnd.random() < 0.4 else words) for _ in range(n)]
        at, new = rnd.randrange(n), rnd.choice(words)
        b = [a[:at] + [new] + a[at + 1 :], a[:at] + [new] + a[at:], a[:at] + a[at + 1 :]][k % 3]
        a, b = " ".join(a), " ".join(b)
        if 1 - brute.edit_distance(a, b) / max(len(a), len(b)) >= 0.8:
            out.append((k, a, b))
    return out


def test_recall_of_lines(spark, edited):
    """Lines that differ by one word are found by edit similarity alone, whatever their length; no other lines are taken for them."""
    df = spark.createDataFrame([(d, t) for k, a, b in edited for d, t in ((2 * k, a), (2 * k + 1, b))], "doc_id long, text string")
    gone = {r.doc_id for r in lines.line_decisions(df).where("not first").collect()}
    assert gone <= {2 * k + 1 for k, *_ in edited} and len(gone) >= 0.97 * len(edited)


def test_hot_keys(spark):
    """Lines of one key that are all different, dealt into parts, give the groups of all pairs."""
    rnd = random.Random(13)
    base = [f"{x}{i}" for i, x in enumerate("abcdefghijkl")]
    blocks = {w: (xxhash.xxh64_intdigest(w.encode(), 42) >> 29 ^ xxhash.xxh64_intdigest(w.encode(), 42)) & 3 for w in base}
    same = [w for w in base if blocks[w] in (0, 1)]
    texts = {}
    for d in range(60):
        other = ["".join(rnd.choice("mnopqrst") for _ in range(12)) for _ in range(40)]
        texts[d] = " ".join(same + [w for w in other if (xxhash.xxh64_intdigest(w.encode(), 42) >> 29 ^ xxhash.xxh64_intdigest(w.encode(), 42)) & 3 > 1][: 3 + d % 3])
        if d % 7 == 1:
            texts[d] = texts[d - 1][:-1]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.first for r in lines.line_decisions(df, key_rows=8).collect()}
    assert got == brute.line_firsts(texts) and not all(got.values())


def test_long_lines(spark, edited):
    """Lines of any length have the fingerprints of the plain version; bounds of the edit distance are none below it."""
    rnd = random.Random(14)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for n in (1, 5, 126, 127, 128, 400, 16_100)]
    rows = lines._lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = rows.join(lines._fingerprints(rows), "line_id").select("norm", F.size(lines._keys(F.col("fp"), "counts")).alias("n"), "fp", F.xxhash64("norm").alias("h")).collect()
    assert len(got) == len(texts)
    for r in got:
        bits = {(i, x): 2 * sum(h >> s & 1 for h in hs) > len(hs) for i, hs in enumerate(brute.blocks_of(r.norm)) for x, s in enumerate(s for s in range(64) if s % 8 // 2 == i)}
        fp = sum(1 << [s for s in range(64) if s % 8 // 2 == i][x] for (i, x), on in bits.items() if on)
        assert r.fp & (2**64 - 1) == fp and r.n == len(brute.line_keys(r.norm))
    pairs = spark.createDataFrame(edited[:80] + [(1000, "a b c d", "x y"), (1001, "a", "b c d e f g"), (1002, "a b c", "c b a")], "k int, a string, b string")
    pairs = pairs.select("k", "a", "b", F.split("a", " ").alias("wa"), F.split("b", " ").alias("wb"))
    for r in pairs.select("k", F.levenshtein("a", "b").alias("d"), lines._aligned(F.col("wa"), F.col("wb")).alias("x"), lines._in_chunks(F.col("wa"), F.col("wb")).alias("y")).collect():
        assert r.x >= r.d and r.y >= r.d


def test_unicode_punctuation(spark):
    """Lines that differ in quotes, dashes, spaces and punctuation of any script are one class."""
    rows = [(1, "she said \"so it is\" - and left\n你好,世界.再见"), (2, "she\u00a0said \u201cso it is\u201d \u2014 and left\n你好，世界。再见"), (3, "she said so it is, and he left for good")]
    got = {(r.doc_id, r.line_no): r.first for r in lines.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): False, (3, 0): True}


def test_exactly_similar(spark):
    """An edit similarity of exactly 0.8 is enough, whatever the length."""
    rows = [(n, "a" * n, "a" * (n - n // 5 - 1) + "b" * (n // 5) + "a") for n in (5, 10, 15, 20, 50, 100)]
    rows += [(-n, a, b.replace("b", "bb", 1)[: n - 1] + "b") for n, a, b in rows]
    got = {r.n: r.similarity for r in lines.edit_similarity(spark.createDataFrame(rows, "n int, a string, b string"), "a", "b", 0.8).collect()}
    exp = {n: 1 - brute.edit_distance(a, b) / max(len(a), len(b)) for n, a, b in rows}
    assert all(got[n] == (exp[n] if exp[n] >= 0.8 else None) for n in exp) and exp[5] == exp[100] == 0.8 and exp[-5] < 0.8


def test_mixing(docs, texts):
    got = mixing.op2_query(docs).collect()
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").encode().split()) and r.taken == r.copies * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    exp = brute.targets(sizes)
    for r in got:
        assert abs(r.target - exp[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - exp[s]) <= largest[s] for s in sizes)
    again = mixing.op2_query(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_mixing_is_near(spark):
    """The largest documents are settled before the small ones, at few and at many documents of a source: the words taken miss the target by less than a median document."""
    rnd = random.Random(5)
    for per_source in (50, 700):
        rows = [(i, f"s{i % 4}", " ".join("w" * math.ceil(rnd.lognormvariate(3.5, 1.3)))) for i in range(4 * per_source)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = mixing.op2_query(df).collect()
        for source in ("s0", "s1", "s2", "s3"):
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) < np.median([r.size for r in mine])
            assert all(r.taken in (r.size * math.floor(r.target / r.source_size), r.size * math.ceil(r.target / r.source_size)) for r in mine)


def test_mixing_is_fair_to_large_documents(spark):
    """A document that holds a fifth of its source's words is drawn as often as its probability says."""
    rows = [(i, "s" if i < 30 else "t", " ".join("w" * (60 if i % 30 == 0 else 1 + i % 19))) for i in range(60)]
    units = spark.createDataFrame([(s, 100 * seed + i, 1000 * seed + i, len(t.split()), 0.3) for seed in range(400) for i, s, t in [(i, f"{s}{seed}", t) for i, s, t in rows if s == "s"]], "source string, id long, h long, w long, p double")
    got = {r.id: r.extra for r in mixing.round_copies(units, 30, Scratch(spark, "t")).collect()}
    large = np.mean([got[100 * seed] for seed in range(400)])
    small = np.mean([[got[100 * seed + i] for i in range(1, 30)] for seed in range(400)], axis=0)
    assert len(got) == 12_000 and abs(large - 0.3) < 0.08 and np.abs(small - 0.3).max() < 0.1


def test_mixing_is_fair(spark):
    """Over many draws, a document is taken as often as its source's ratio says."""
    rows = [(i, "s" if i < 40 else "t", " ".join("w" * (1 + i % 7))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = np.mean([[r.copies for r in sorted(mixing.mix(df, seed=s).collect(), key=lambda r: r.doc_id)] for s in range(12)], axis=0)
    ratio = np.array([r.target / r.source_size for r in sorted(mixing.mix(df).collect(), key=lambda r: r.doc_id)])
    assert abs((copies - ratio).mean()) < 0.1 and np.abs(copies - ratio).max() < 0.6


def test_capped_targets(spark):
    for sizes in ({"a": 10, "b": 0, "c": 1000, None: 5}, {"a": 1}, {"a": 5, "b": 5, "c": 5, "d": 100000}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        exp = brute.targets(sizes)
        assert got.keys() == exp.keys() and all(abs(got[s] - exp[s]) < 1e-6 for s in exp)


def test_mined_rules(spark):
    """Combinations that labels speak for are found with their exact figures, and only minimal ones."""
    rnd = random.Random(3)
    pages, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        pages.append((i, f"http://{'casino.' if bad else ''}site{rnd.randint(0, 3)}.example.com/{'win' if bad or i % 7 == 0 else 'news'}/{i}"))
        if i < 400:
            labels.append((i, 0 if bad else 1))
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_rules.op3_query(p, q).collect()}
    assert got == {i: "block" if i % 5 == 0 else "allow" for i in range(600)}
    long = "http://long.example.com/" + "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    more = p.unionByName(spark.createDataFrame([(1000 + i, long) for i in range(40)], "page_id long, url string"))
    found = url_rules.op3_query(more, q.unionByName(spark.createDataFrame([(1000 + i, 0) for i in range(30)], "doc_id long, quality int"))).collect()
    assert {r.page_id: r.verdict for r in found} == got | {1000 + i: "block" for i in range(40)}
    few = url_rules.op3_query(p, q.where("doc_id < 60")).where("verdict = 'block'")
    assert few.isEmpty()  # twelve blocked URLs are too few
    cut = p.join(q, p.page_id == q.doc_id).select(url_rules.tokens(url_rules.host(F.col("url")), url_rules.path(F.col("url")), F.col("url")).alias("tokens"), (F.col("quality") == 0).alias("blocked"))
    baskets = [(set(r.tokens), r.blocked) for r in cut.collect()]
    rules = url_rules.mine(cut, Scratch(spark, "t")).collect()
    assert rules
    for r in rules:
        held = [b for t, b in baskets if set(r.tokens) <= t]
        assert abs(r.confidence - np.mean(held)) < 1e-9 and abs(r.support - len(held) / len(baskets)) < 1e-9
        assert not any(set(o.tokens) < set(r.tokens) for o in rules)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label, spread, n in ((0, 0.002, 150), (0, 0.03, 60), (1, 0.02, 40), (0, None, 300), (1, None, 300)):
        centre = rng.normal(size=24)
        for _ in range(n):
            v = rng.normal(size=24) if spread is None else centre + spread * rng.normal(size=24) * np.linalg.norm(centre)
            rows.append((i, [float(x) for x in v], label))
            i += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    found = sum(min(got[k][0], int(n)) for k, n in enumerate(hit.sum(1)))
    assert found >= 0.95 * hit.sum() and all(got[k][0] <= n for k, n in enumerate(hit.sum(1)))


def _vector_truth(rows):
    """vec position to (number of links, smallest vec_id reachable)."""
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(hit, False)
    groups = brute.Union()
    for i, j in zip(*np.nonzero(hit), strict=True):
        groups.join(int(i), int(j))
    return [(int(hit[i].sum()), rows[groups.find(i)][0]) for i in range(len(rows))]


def test_bordering_groups(spark):
    """Two dense groups, all of whose vectors link across, are one component with all its links."""
    rng = np.random.default_rng(3)
    centre, aside = rng.normal(size=32), rng.normal(size=32)
    centre /= np.linalg.norm(centre)
    aside -= aside @ centre * centre
    aside *= np.tan(np.arccos(0.984)) / np.linalg.norm(aside)
    rows = [(i, (centre + (i % 2) * aside + 0.0004 * rng.normal(size=32)).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rng.normal(size=32).tolist(), 0) for i in range(400)]
    truth = _vector_truth(rows)
    assert truth[0] == (299, 0)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[r[0]] for r in rows] == truth


def test_exact_way_and_shared_ids(spark):
    """Without a start all vectors are compared; rows that share a vec_id keep a row each."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 12))
    rows = [(i, (centre[i % 3] + 0.05 * rng.normal(size=12)).tolist(), i % 2) for i in range(90)]
    df = spark.createDataFrame([*rows, (5, None, 0), (5, rows[4][1], 0)], "vec_id long, embedding array<double>, label int")
    got = nndescent.near_vectors(df, tries=0).collect()
    assert len(got) == 92 and sorted((r.n_links, r.component_id) for r in got if r.vec_id == 5)[0] == (0, 5)
    exact = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_vectors(df.where("vec_id <> 5"), tries=0).collect()}
    few = [r for r in rows if r[0] != 5]
    assert [exact[r[0]] for r in few] == _vector_truth(few)


def test_toxicity(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = common.load(spark, sf, "documents"), common.load(spark, sf, "labels")
    got = toxicity.op8_query(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    clean = [r.predicted for r in held if not r.toxic]
    assert right >= 0.85 and sum(clean) <= 0.05 * len(clean)


def test_scores(spark):
    """Scores are the noisy-or of the sentences, as a plain version has it."""
    model = toxicity.Model(0.02, -1.0, {zlib.crc32(w) % toxicity.BUCKETS: x for w, x in ((b"bad", 3.0), (b"worse", 4.0), (b"terribl-", 0.7), (b"fine", -2.0))})
    texts = ["Bad day. All is fine\nworse, BAD!", "terribly terrible", "", None, "nothing here. at all", "bad " * 5000, "fine? bad"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        clear, scores = 1 - model.leak, []
        for sentence in "".join("." if c in ".!?\n" else c if c.isalnum() else " " for c in (r.text or "").lower()).split("."):
            words = sentence.split()
            if words:
                hits = [model.weights[k] for w in words for k in [zlib.crc32(x.encode()) % toxicity.BUCKETS for x in ([w, w[:7] + "-"] if len(w) > 7 else [w])] if k in model.weights]
                scores.append(1 / (1 + np.exp(-np.clip(model.bias + sum(hits), -30, 30))) if hits else 0.0)
                clear *= 1 - scores[-1]
        assert abs(r.score - (1 - clear)) < 1e-12
        assert r.worst_sentence == (scores.index(max(scores)) if scores and max(scores) else None)


def test_context_limits(spark, docs, texts):
    """The histogram and its suffix sums answer every limit and share as the lengths themselves do."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    lengths = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts.values())
    sums = token_counts.op1_query(docs).cache()
    for r in sums.collect():
        over = [n for n in lengths if n >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_total, r.tokens_total) == (lengths.count(r.n_tokens), len(over), sum(over), len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and abs(r["quantile"] - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 17, 128, 2048, lengths[5], lengths[-1], lengths[-1] + 1]
    got = {r.context_limit: (r.docs_fit, r.tokens_fit, r.truncated_total) for r in token_counts.at_limits(sums, limits).collect()}
    assert got == {c: (sum(n <= c for n in lengths), sum(n for n in lengths if n <= c), sum(min(n, c) for n in lengths)) for c in limits}
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.share: r.n_tokens for r in token_counts.length_at(sums, shares).collect()}
    assert got == {s: min(n for n in lengths if sum(m <= n for m in lengths) >= s * len(lengths) - 1e-9) for s in shares}


def test_pieces():
    """Hostile texts have the ids of whole texts, in batches of any size; an unknown kind of tokenizer encodes whole texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    rnd, path = random.Random(2), tokens.default_tokenizer()
    parts = [" ", "  ", "\n", " \n", "a", "bc", "The", "don't", "'s", "1", "23", ".", "!", "...", "é", "\u00a0", "\u3000", "\t", "😀", "<|endoftext|>", " word", "word.", "\0", "\x1c", "\r\n", "你好", "Ж", " ñandú", " straße."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None, ""]
    exp = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder, array = tokens.PieceEncoder(path, pieces=500), pa.array(texts)
    for most in (1 << 20, 300):
        got = [encoder.encode(array.slice(a, n)) for a, n in tokens.bounded(array, most)]
        assert np.concatenate([g[0] for g in got]).tolist() == [x for ids in exp for x in ids] and np.concatenate([g[1] for g in got]).tolist() == [len(ids) for ids in exp]
    other = Tokenizer(models.WordLevel({"a b": 1, "?": 0}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    encoder.tokenizer, encoder.by_pieces = other, tokens.splits_at_spaces({"pre_tokenizer": {"type": "Split"}})
    assert not encoder.by_pieces and encoder.encode(pa.array(["a b|c", None]))[0].tolist() == [1, 0]


def test_keys_of_rows(spark):
    """Rows whose nulls stand in other columns are documents of their own."""
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None)], "doc_id long, source string, text string")
    assert df.select(mixing.row_key(df)).distinct().count() == 2


def test_columns_of_a_stage(spark):
    """A column of the table's own that is called score comes out as it was."""
    docs = spark.createDataFrame([(i, "you idiot" if i % 3 == 0 else "all is well", 0.25 + i) for i in range(60)], "doc_id long, text string, score double")
    sf = Scratch(spark, "t").path("sf")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).write.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).collect()
    assert {r.doc_id: r.score for r in kept} == {i: 0.25 + i for i in range(60) if i % 3}


def test_offending_sentences(spark):
    """Labels of documents alone tell which sentence is to blame."""
    rnd = random.Random(6)
    plain = ["we met today", "it rained a lot", "trees grow here", "books are heavy", "all went home"]
    rows = []
    for i in range(300):
        s = rnd.sample(plain, 4)
        if i % 4 == 0:
            s[rnd.randrange(4)] = f"you {rnd.choice(['fool', 'scum'])} of a {rnd.choice(['dog', 'man'])}"
        rows.append((i, ". ".join(s), i % 4 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int"))
    got = {(r.doc_id, r.sentence) for r in toxicity.offending_sentences(docs, model).collect()}
    assert got == {(i, k) for i, t, _ in rows for k, s in enumerate(t.split(". ")) if s.startswith("you")}


def test_top_k(spark):
    rnd = random.Random(7)
    v = [rnd.choice([rnd.getrandbits(63), -rnd.getrandbits(63), rnd.randint(-3, 3)]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for k in (1, 2, 250, 499, 500):
        assert quality.kth_largest(df, k) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(df, 501) is None


def test_resampling(spark, docs, texts):
    good = docs.select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("target"))
    got = {r.doc_id: r for r in quality.resample(good, F.col("target")).collect()}
    raw = sum(np.bincount(quality.features(t), minlength=quality.BUCKETS) for t in texts.values())
    aim = sum(np.bincount(quality.features(t), minlength=quality.BUCKETS) for d, t in texts.items() if d % 2 == 0)
    ratio = np.log((aim + 1) / (aim + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    assert all(abs(got[d].log_weight - ratio[quality.features(t)].sum()) < 1e-6 for d, t in texts.items())
    assert {d for d, r in got.items() if r.kept} == set(sorted(got, key=lambda d: -got[d].key)[: int(np.ceil(quality.KEEP * len(got)))])


def test_blocks():
    rnd = random.Random(8)
    for n in (1, 2, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 50_257, 2**32 - 1):
            x = np.array([rnd.randrange(top) if rnd.random() > 0.05 else rnd.randrange(2**32) for _ in range(n)], np.uint32)
            blocks = tokens.pack_blocks(x)
            starts = np.cumsum([0, *(len(b) for b in blocks)])[:-1].tolist()
            assert len(blocks) == -(-n // tokens.BLOCK) and (tokens.unpack_blocks(memoryview(b"".join(blocks)), starts) == x).all()
    assert tokens.pack_blocks(np.empty(0, np.uint32)) == []


def test_pipeline(spark, texts, items):
    """Each stage, on what the one before kept, against its plain version."""
    scratch, docs = Scratch(spark, "t"), common.load(spark, SF, "documents")
    model = toxicity.train(docs, common.load(spark, SF, "labels"))
    kept = {d for d, t in texts.items() if model.score(t)[0] < 0.5}
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        out.append(docs.collect())
    assert {r.doc_id for r in out[0]} == kept and all(r.text == texts[r.doc_id] for r in out[0])
    # what goes is like a document of its group; few groups of the plain version are not found
    groups = brute.shingle_groups({d: texts[d] for d in kept})
    left = {r.doc_id for r in out[1]}
    assert len(out[1]) == len(left) <= len(kept) and all(groups[d] != d for d in kept - left)
    assert len(kept - left) >= 0.9 * sum(groups[d] != d for d in kept)
    kept = left
    kept -= {d for d, _ in brute.contaminated({d: texts[d] for d in kept}, items)}
    assert sorted(r.doc_id for r in out[2]) == sorted(kept)
    copies = {}
    for r in out[3]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    mixed = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(out[2])).collect()}
    assert copies == {d: n for d, n in mixed.items() if n}
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(tokens.default_tokenizer()), 0
    for r in sorted(out[4], key=lambda r: r.start):
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in sorted(out[4], key=lambda r: r.start)] == sorted(d for d, n in copies.items() for _ in range(n))
