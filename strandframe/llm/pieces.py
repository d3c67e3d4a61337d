"""SentencePiece ids of whole texts for merge-type vocabularies, and texts of ids.

A text, normalised as its model says, starts as one symbol for each character.
All adjacent pairs that the vocabulary holds stand on an agenda; the pair of
highest score, of equal ones the leftmost, becomes one symbol, and its pairs
with its new neighbours join the agenda, until none is left. What is in no
piece is spelt in bytes. The sentencepiece library encodes each Arrow batch as
well, and rows whose ids differ from its are marked.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from strandframe.llm.common import extended
from strandframe.llm.tokens import _grown, bounded

#: Units of texts whose ids a worker remembers (some 150 bytes each).
CACHE_UNITS = 1_000_000
#: Length up to which units are merged many at a time.
TOGETHER = 48
#: Bytes of text that are encoded and checked together.
TEXT_BYTES = 4 << 20
_MERGE_TYPE = 2
_NONE = np.iinfo(np.int64).max
#: Odd multiplier of the hash of pairs.
_MIX = np.int64(0x1E3779B97F4A7C15)


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


class AgendaEncoder:
    """Ids of texts by merging symbols, for one vocabulary with byte pieces.

    Where no piece holds two characters side by side, a text is cut between
    them: no merge reaches over such a place, so each distinct unit is merged
    once and remembered.
    """

    def __init__(self, model: bytes) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if _model_type(model) != _MERGE_TYPE:
            raise ValueError("not a merge-type vocabulary")
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece] = i
                self.cost[piece] = -lib.get_score(i)
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary must have a piece for each byte")
        self._forget()
        self._tables()

    def _tables(self) -> None:
        """Which characters stand side by side in pieces, and which pairs of pieces make one."""
        inner = sorted({c for p in self.ids if len(p) > 1 for c in p})
        place = {c: i for i, c in enumerate(inner, 1)}
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1,) * 2, bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[place[a], place[b]] = True
        # a character that is no piece has a number below zero
        single = [p for p in self.ids if len(p) == 1]
        self.number = np.zeros(0x110000, np.int64)
        self.number[[ord(c) for c in single]] = [self.ids[c] for c in single]
        rank = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        number = lambda p: self.ids.get(p, -1 - ord(p) if len(p) == 1 else None)
        pairs = [(number(p[:k]), number(p[k:]), p) for p in self.ids for k in range(1, len(p))]
        pairs = [((a << 32) + b, rank[self.cost[p]], self.ids[p]) for a, b, p in pairs if a is not None and b is not None]
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, _NONE, np.int64)
        self.pair_rank, self.pair_made = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([k for k, *_ in pairs], np.int64)
        for slot, pair in zip(((keys * _MIX).view(np.uint64) >> np.uint64(64 - self.bits)).tolist(), pairs, strict=True):
            while self.slots[slot] != _NONE:
                slot = (slot + 1) % (1 << self.bits)
            self.slots[slot], self.pair_rank[slot], self.pair_made[slot] = pair

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self._encode_normal([self.library.normalize(text)])[0].tolist()

    def _encode_normal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts, one after the other, and how many each has."""
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        at = self.place[chars]
        cut = np.ones(len(at) + 1, bool)
        if len(at):
            cut[1:-1] = ~self.beside.reshape(-1)[at[:-1] * np.int64(len(self.beside)) + at[1:]]
        cut[ends] = True
        edges = np.flatnonzero(cut)
        # Arrow tells distinct units apart by their bytes
        wide = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), out=wide[1:])
        units = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(wide[edges]), pa.py_buffer(whole.encode()))
        numbers = self._numbers(units)
        size = self.size[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(self.first[numbers] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(edges, ends)], prepend=0)

    def _numbers(self, units: pa.LargeStringArray) -> np.ndarray:
        """The number that each unit is remembered by; new ones are merged first."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.n + len(names) > CACHE_UNITS:
            self._forget()
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            for some, ids, size in self._merged([names[i] for i in new.tolist()]):
                self.store, n_ids = _grown(self.store, self.n_ids, ids)
                self.first, _ = _grown(self.first, self.n, self.n_ids + np.cumsum(size) - size)
                self.size, n = _grown(self.size, self.n, size)
                self.known.update(zip(some, range(self.n, n), strict=True))
                self.n, self.n_ids = n, n_ids
            found[new] = np.fromiter(map(self.known.__getitem__, [names[i] for i in new.tolist()]), np.int64, len(new))
        return found[coded.indices.to_numpy()]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.n = self.n_ids = 0

    def _merged(self, units: list[str]):
        """(units, their ids one after the other, how many each has): those of some lengths go together, long ones one by one."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(-(-len(u) // 4) * 4 if len(u) <= TOGETHER else 0, []).append(u)
        for size, some in by_size.items():
            if size:
                symbols, counts = self._merge_together(some, size)
                yield some, *self._spell(symbols, counts)
            else:
                for u in some:
                    parts = self.merge(u)
                    symbols = np.array([self.ids.get(p, -1 - ord(p[0])) for p in parts], np.int64)
                    yield [u], *self._spell(symbols, np.array([len(parts)]))

    def _spell(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, where characters that are no piece (less than zero) are spelt in bytes."""
        odd = symbols < 0
        if not odd.any():
            return symbols.astype(np.int32), counts
        spelt = {c: [self.bytes[b] for b in chr(-1 - c).encode()] for c in np.unique(symbols[odd]).tolist()}
        parts = [spelt[x] if x < 0 else [x] for x in symbols.tolist()]
        longer = np.cumsum([0, *map(len, parts)])
        stops = np.cumsum(counts)
        return np.fromiter(chain.from_iterable(parts), np.int32, int(longer[-1])), longer[stops] - longer[stops - counts]

    def _merge_together(self, units: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of units of up to width characters, one after the other, and how many each has.

        A row of the agenda holds the ranks of a unit's pairs in order of place.
        Each round merges the first pair of the lowest rank in every row and
        looks up the new symbol with its neighbours.
        """
        lengths, n = np.fromiter(map(len, units), np.int64, len(units)), len(units)
        symbol = np.full((n, width), _NONE, np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        known = self.number[chars]
        symbol[np.arange(width) < lengths[:, None]] = np.where(known > 0, known, -1 - chars.astype(np.int64))
        rank = np.full((n, width), _NONE, np.int64)
        made = np.zeros((n, width), np.int64)
        rank[:, :-1], made[:, :-1] = self._lookup(symbol[:, :-1], symbol[:, 1:])
        right, left = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        row = np.arange(n)
        while True:
            best = rank[row].argmin(1)
            open_ = rank[row, best] < _NONE
            row, best = row[open_], best[open_]
            if not len(row):
                break
            gone, before = right[row, best], left[row, best]
            after, new = right[row, gone], made[row, best]
            symbol[row, best], symbol[row, gone] = new, _NONE
            rank[row, gone] = _NONE
            right[row, best] = after
            near = after < width
            left[row[near], after[near]] = best[near]
            rank[row, best], made[row, best] = self._lookup(new, np.where(near, symbol[row, np.minimum(after, width - 1)], _NONE))
            near = before >= 0
            row_, before = row[near], before[near]
            rank[row_, before], made[row_, before] = self._lookup(symbol[row_, before], new[near])
        stay = symbol != _NONE
        return symbol[stay], stay.sum(1)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of pairs of symbols, _NONE if they make no piece, and the piece."""
        key = (a << 32) + b
        slot = (key * _MIX).view(np.uint64) >> np.uint64(64 - self.bits)
        seen = self.slots[slot]
        # nearly all pairs are settled by the first slot, the others by the next ones
        behind = np.nonzero((seen != key) & (seen != _NONE))
        while len(behind[0]):
            slot[behind] = (slot[behind] + np.uint64(1)) & np.uint64((1 << self.bits) - 1)
            seen[behind] = self.slots[slot[behind]]
            rest = (seen[behind] != key[behind]) & (seen[behind] != _NONE)
            behind = tuple(x[rest] for x in behind)
        hit = (seen == key) & (b != _NONE)
        return np.where(hit, self.pair_rank[slot], _NONE), self.pair_made[slot]

    def merge(self, unit: str) -> list[str]:
        """The symbols of a unit once no pair of neighbours is in the vocabulary."""
        symbols, cost = list(unit), self.cost
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, a, b, pair = heappop(agenda)
            # an entry is stale once one of its symbols has grown or gone
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(pair):
                continue
            symbols[a], symbols[b] = pair, ""
            c, z = right[b], left[a]
            right[a] = c
            if c < n:
                left[c] = a
                grown = pair + symbols[c]
                if grown in cost:
                    heappush(agenda, (cost[grown], a, c, grown))
            if z >= 0:
                grown = symbols[z] + pair
                if grown in cost:
                    heappush(agenda, (cost[grown], z, a, grown))
        return [s for s in symbols if s]

    def checked(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """The ids of texts, and whether the library gives the same."""
        flat, counts = self._encode_normal(self.library.normalize(texts))
        flat, stops = flat.tolist(), np.cumsum(counts).tolist()
        own = [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        theirs = self.library.encode(texts, num_threads=1, add_bos=False, add_eos=False)
        return own, [a == b for a, b in zip(own, theirs, strict=True)]


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> AgendaEncoder:
    """The encoder of a vocabulary, which a Python worker keeps from task to task."""
    return AgendaEncoder(model)


def _model_type(model: bytes) -> int | None:
    """The field of a model that tells merge-type vocabularies (2) from others: number 3 of message 2, unigram where it is unset."""
    spec = dict(_fields(model)).get(2, b"")
    return dict(_fields(spec)).get(3, 1)


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message; whole numbers, and bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
            yield key >> 3, raw[at : at + size]
            at += size


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (text and any other columns) with ids (array<int>) and agrees (the library gives the same ids).

    Null texts are empty ones, which have no ids. All other columns and equal
    rows stay as they are, but for columns named ids or agrees, which are replaced.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("ids", "agrees")])

    def run(batches):
        encoder = encoder_of(model)
        for batch in batches:
            texts = batch.column("text")
            for first, n in bounded(texts, TEXT_BYTES):
                own, same = encoder.checked(["" if t is None else t for t in texts.slice(first, n).to_pylist()])
                rows = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own, pa.list_(pa.int32())), pa.array(same)], [*rows.schema.names, "ids", "agrees"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("agrees", BooleanType())]))


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """tokens (ids and any other columns) with decoded, the library's text of the ids; null ids and none give the empty text."""
    kept = tokens.select(*[c for c in tokens.columns if c != "decoded"])

    def run(batches):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [library.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, extended(kept, ("decoded", "string")))


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids, in UTF-8) and agrees of each row of docs (doc_id, text).

    The same ids and texts as encode and decode give, without their way from task to task.
    """

    def run(batches):
        encoder = encoder_of(model)
        names = [str(i) for i in range(encoder.library.get_piece_size())]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            texts = batch.column("text")
            for first, n in bounded(texts, TEXT_BYTES):
                own, same = encoder.checked(texts.slice(first, n).to_pylist())
                decoded = encoder.library.decode(own, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        pa.array([len(ids) for ids in own], pa.int64()),
                        pa.array([sha(",".join([names[i] for i in ids])) for ids in own]),
                        pa.array([sha(text) for text in decoded]),
                        pa.array(same),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
                )

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, extended(rows.select("doc_id"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("agrees", "boolean")))


def op13_query(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id (null as well), n_tokens, ids_sha256, decoded_sha256, agrees. An empty or null text has no ids; an empty table gives no rows."""
    return digests(docs, default_model())
