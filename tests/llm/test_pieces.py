"""Merges by agenda against the sentencepiece library, and round trips."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from strandframe.llm import pieces

DOCS = "doc_id long, text string, ids string, agrees string, decoded string"
BITS = [
    "a", "b", "e", "th", "in", "er", "the", "The", " ", "  ", "    ", "\n", "\t", "\r\n", "▁", "é", "é", "漢", "字", "ß", "😀", "👩‍👩", "\x00", "\x01", "�", "﻿",
    "<s>", "<0x0A>", "</s>", "<unk>", " ", "\xa0", "\x1c", "Q", "1", "22", "...", "—", "_{", "**", "&lt;", "ﬁ", "Ǆ",
]


def some_texts(seed, n):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices(BITS, k=rnd.randint(0, 40))) for _ in range(n)]
    ranges = [(1, 0x2FF), (0x370, 0x5FF), (0x2E80, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F6FF)]
    return texts + ["".join(chr(rnd.randint(*rnd.choice(ranges))) for _ in range(30)) for _ in range(n // 4)]


@pytest.fixture(scope="module")
def model():
    return pieces.default_model()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("seed", range(3))
def test_ids(model, library, seed):
    texts = some_texts(seed, 4000)
    own, same = pieces.AgendaEncoder(model).checked(texts)
    assert all(same)
    assert own == library.encode(texts)


def test_merges_by_hand(model):
    """One word at a time, many together, and always the best pair of all that is left, found by looking at each."""
    encoder = pieces.AgendaEncoder(model)
    rnd = random.Random(7)
    words = sorted({"▁" + "".join(rnd.choices("etaoinshrdlu▁", k=rnd.randint(1, 11))) for _ in range(3000)})

    def plain(word):
        symbols = list(word)
        while True:
            pairs = [(encoder.cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in encoder.cost]
            if not pairs:
                return symbols
            _, i = min(pairs)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    exp = [plain(w) for w in words]
    assert [encoder.merge(w) for w in words] == exp
    flat, counts = encoder._merge_together(words, 12)
    assert [encoder.library.id_to_piece(p) for p in flat.tolist()] == [s for e in exp for s in e]
    assert counts.tolist() == list(map(len, exp))


def test_long_texts(model, library):
    texts = ["x" * 200_000, "漢字かな交じり文" * 20_000, " ".join(["the"] * 50_000), "\n" * 1000, "▁" * 1000, " " * 1001, "aeiou" * 30_000]
    assert all(pieces.AgendaEncoder(model).checked(texts)[1])


def test_forgetting(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 50)
    encoder = pieces.AgendaEncoder(model)
    for seed in range(6):
        assert all(encoder.checked(some_texts(seed, 40))[1])


def test_documents(spark, model, library):
    rows = [(1, None, "own", "own", "own"), (2, "", None, None, None), (None, "a  b", "x", "y", "z"), (4, "Hello world\n", None, None, None), (4, "Hello world\n", None, None, None)]
    rows += [(i, t, None, None, None) for i, t in enumerate(some_texts(9, 100), 10)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in pieces.op13_query(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exp = set()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        exp.add((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert got == exp
    assert pieces.op13_query(df).count() == len(rows)
    back = pieces.decode(pieces.encode(df, model), model).collect()
    assert len(back) == len(rows) and all(r.agrees and r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) for r in back)
    assert pieces.op13_query(df.limit(0)).count() == 0


def test_models(model):
    with pytest.raises(ValueError):
        pieces.AgendaEncoder(model.replace(b"\x06tok_v0\x18\x02", b"\x06tok_v0\x18\x01"))


def test_spelling(model):
    encoder = pieces.AgendaEncoder(model)
    ids, counts = encoder._spell(np.array([300, -1 - ord("é"), 400, -1, 500]), np.array([2, 1, 2]))
    assert ids.tolist() == [300, *[encoder.bytes[b] for b in "é".encode()], 400, encoder.bytes[0], 500]
    assert counts.tolist() == [3, 1, 2]
