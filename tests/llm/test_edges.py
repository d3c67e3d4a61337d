"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from strandframe.llm import decontaminate, lines, mixing, nndescent, quality, simhash, token_counts, tokens, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (1, BASE, "en", "a", 80),
    (2, BASE.upper(), "en", "a", 80),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, "you idiot. all else is fine\nand so on", "en", "c", 30),
    (7, "you idiot. all else is fine\nand so on", "en", "c", 30),
    (None, "a text without an id", "en", None, 20),
    (8, "before it " + BASE + " after it\nlast line", "fr", "c", 100),
    (9, "ä ö ü ß é – “”  x\0y <|endoftext|> 🙂", "de", "c", 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    # names that operators use inside must not clash with a table's own
    out = spark.createDataFrame(ROWS, DOCS)
    for c in ("score", "fp", "size", "target", "copies", "words", "n", "key", "component_id", "count", "shard", "tokens", "start"):
        out = out.selectExpr("*", f"'x' as {c}")
    return out.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, BASE.title()), (1, None), (2, ""), (3, "last line"), (None, "no such words in any text at all")], "item_id long, text string")


def test_lengths(docs, empty):
    got = {r.n_tokens: r for r in token_counts.op1_query(docs).collect()}
    assert sum(r.n_docs for r in got.values()) == len(ROWS)
    assert got[0].n_docs == 2 and got[0].docs_at_least == len(ROWS) and got[0].truncated_total == 0
    top = got[max(got)]
    assert top.truncated_total == top.tokens_total and top["quantile"] == 1
    assert token_counts.op1_query(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.op2_query(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * max([1, *(r.size for r in rows)])
    assert mixing.op2_query(empty).count() == 0
    assert set(mixing.take_mix(docs).columns) == set(docs.columns)


def test_urls(spark, labels):
    rows = [(1, "https://A.Example.NET/en/x?q#f"), (2, "http://example.net"), (3, None), (4, "no scheme"), (5, "x://sub.example.com/de/1"), (6, "ftp://y.org/fr/"), (6, "ftp://y.org/fr/"), (None, "http://notnet/"), (9, "http://b.net/?a=1")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, tokens string")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_rules.op3_query(pages, labels).collect())
    assert got == [
        (0, "notnet", "/", None, "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "sub.example.com", "/de/1", "example.com/de/", "block"), (6, "y.org", "/fr/", "org/fr/", "allow"), (6, "y.org", "/fr/", "org/fr/", "allow"), (9, "b.net", "/", "net/", "block"),
    ]
    assert url_rules.op3_query(pages.where("page_id < 0"), labels).count() == 0
    assert url_rules.op3_query(pages, labels.where("doc_id < 0")).count() == len(rows)


def test_vectors(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=8)]
    near = [x + 0.001 for x in v]
    rows = [(1, v, 0), (2, v, 0), (3, near, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0] * 8, 0), (9, [float("nan")] * 8, 0), (10, [1.0, None], 0), (None, v, 0), (11, [float("inf")] * 8, 0), (12, [x * 1e-30 for x in v], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.op4_query(table).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert got[4] == (1, 4, True) and got[12] == (1, 4, False)
    for i in (5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)
    assert len(got) == len(rows) and nndescent.op4_query(table.where("vec_id < 0")).count() == 0


def test_lines(docs, empty):
    got = lines.op5_query(docs).collect()
    assert len(got) == len(ROWS) - 1  # equal rows are one document
    by = {r.doc_id: r for r in got}
    assert by[3].n_lines == by[4].n_lines == by[5].n_lines == 0
    assert by[1].removed == [] and by[2].removed == [0] and by[7].n_kept == 2
    assert lines.op5_query(empty).count() == 0
    text = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert text[1] == BASE and text[2] == "" and text[3] is None


def test_simhash(docs, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op6_query(docs).collect()]
    assert len(got) == len(ROWS)
    for i, text, *_ in ROWS:
        fp = f"{simhash.text_fingerprint(text, 4) & (2**64 - 1):016x}"
        assert any(g[0] == i and g[1] == fp for g in got)
    by = {g[0]: g[2] for g in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[7] == 7
    assert simhash.op6_query(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    got = sorted(tokens.op7_query(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    texts = {r[0]: r[1] for r in ROWS}
    start = 0
    for r in got:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.op7_query(empty).count() == 0


def test_toxicity(docs, empty, labels):
    got = toxicity.op8_query(docs, labels).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.op8_query(empty, labels).count() == 0
    assert toxicity.op8_query(docs, labels.where("doc_id < 0")).count() == len(ROWS)


def test_decontamination(docs, empty, items):
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.op9_query(docs, items).collect()}
    assert got == {(1, 0): (0, 15, 1.0), (2, 0): (0, 15, 1.0), (8, 0): (2, 15, 1.0), (8, 3): (19, 2, 1.0)}
    assert decontaminate.op9_query(empty, items).count() == 0
    assert decontaminate.op9_query(docs, items.where("item_id > 99")).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(docs, items).collect()) == [0, 3, 4, 5, 6, 7, 7, 9]


def test_resampling(docs, empty, labels):
    got = quality.op10_query(docs, labels).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) >= int(np.ceil(0.85 * len(ROWS)))
    assert quality.op10_query(empty, labels).count() == 0
    assert quality.op10_query(docs, labels.where("doc_id < 0")).count() == len(ROWS)


@pytest.mark.parametrize("which", ["docs", "empty"])
def test_stages(spark, request, tmp_path, which):
    from pyspark.sql import functions as F

    table = request.getfixturevalue(which)
    request.getfixturevalue("labels").write.parquet(f"{tmp_path}/labels.parquet")
    request.getfixturevalue("items").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        assert out.where(~F.coalesce(F.col("doc_id"), F.lit(-1)).isin(-1, *range(1, 10))).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == (len(ROWS) if which == "docs" else 0)
