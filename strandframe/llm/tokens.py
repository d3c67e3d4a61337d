"""Token ids on disk in patched frame-of-reference blocks.

Documents are put in order of doc_id over range partitions; each partition
encodes its texts and writes one shard. A shard holds blocks of BLOCK ids: the
block's minimum is subtracted, the rest is packed with the width that holds
PERCENTILE of the values, and the high bits of the others go to an exception
list. Its footer has the offset of each block and a table of documents.

Layout of a shard, little-endian:
    b"PFR1"
    blocks: u8 width, u8 0, u16 exceptions, u32 ids, u32 minimum, packed bits,
            u16 positions of exceptions, u32 their values less the minimum
    footer: u64 offsets of the blocks, i64 doc_ids, u8 flags (1: doc_id is null), i64 ids per document
    u64 offset of the footer, u64 blocks, u64 documents, u64 ids, b"PFR1"
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.scratch import Scratch

BLOCK = 1024
PERCENTILE = 0.9
END_ID = 0
#: Pieces of text whose ids a worker remembers (some 200 bytes each).
CACHE_PIECES = 1_000_000
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<BBHII")
_TAIL = struct.Struct("<QQQQ4s")
#: Bytes of text that are encoded together, and ids that are packed or unpacked at once.
TEXT_BYTES, _IDS = 8 << 20, 1 << 20
_MARKS = ".,!?;:|*$%#&"


class PieceEncoder:
    """Ids of whole texts.

    Byte-level tokenizers split before a single space that stands between two
    other characters: no token reaches over such a place, so a text is cut
    there and each distinct piece is encoded once and remembered. Arrow cuts
    texts and numbers their distinct pieces; texts in which a space stands
    beside other white space, or at an end, are cut with more care. A piece that
    ends in marks after a letter or digit is put together from both parts. A
    tokenizer of another kind encodes whole texts.
    """

    def __init__(self, tokenizer_path: str, pieces: int = CACHE_PIECES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.by_pieces = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self.tokenize = self.tokenizer.model.tokenize
        self.most = pieces
        self._forget()

    def _forget(self) -> None:
        # numbers of pieces: after a space, and as they are; of each number, where its ids are
        self.spaced: dict[str, int] = {}
        self.literal: dict[str, int] = {}
        self.first, self.size, self.n = np.empty(1024, np.int64), np.empty(1024, np.int64), 0
        self.store, self.n_store = np.empty(4096, np.uint32), 0

    @staticmethod
    def cut(text: str) -> list[str]:
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:
            if p[:1].strip() == "" or out[-1][-1:].strip() == "":
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after the other, and how many each text has; null is an empty text."""
        if not self.by_pieces:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for ids in found for x in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)
        pieces, at = self._pieces(texts)
        sizes = self.size[pieces]
        ends = np.cumsum(sizes)
        place = np.repeat(self.first[pieces] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.store[place], np.add.reduceat(sizes, at)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if not self.by_pieces:
            return self.encode(texts)[1]
        pieces, at = self._pieces(texts)
        return np.add.reduceat(self.size[pieces], at)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts, and where each text begins; every text has a piece."""
        was = gc.isenabled()
        gc.disable()  # many short lists and no cycles: the collector would only walk them
        try:
            return self._cut_and_numbered(texts)
        finally:
            if was:
                gc.enable()

    def _cut_and_numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.spaced) + len(self.literal) > self.most:
            self._forget()
        texts = texts.fill_null("")
        careful = pc.match_substring_regex(texts, _CAREFUL)
        words = pc.split_pattern(pc.if_else(careful, "", texts), " ")
        at = words.offsets.to_numpy().astype(np.int64)
        pieces = self._numbers(self.spaced, words.values, " ")
        pieces[at[:-1]] = self._numbers(self.literal, words.values.take(pa.array(at[:-1])), "")
        rows = np.flatnonzero(careful.to_numpy(zero_copy_only=False))
        if len(rows):
            cut = [self.cut(t) for t in texts.take(pa.array(rows)).to_pylist()]
            own = self._numbers(self.literal, pa.array([p for parts in cut for p in parts], pa.string()), "")
            ends = np.cumsum([len(parts) for parts in cut])
            sizes, parts, before = np.diff(at), [], 0
            for r, lo, hi in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                parts += [pieces[at[before] : at[r]], own[lo:hi]]
                sizes[r], before = hi - lo, r + 1
            pieces = np.concatenate([*parts, pieces[at[before] :]])
            at = np.concatenate([[0], np.cumsum(sizes)])
        return pieces, at[:-1]

    def _numbers(self, known: dict[str, int], words: pa.Array, prefix: str) -> np.ndarray:
        """The number of each word in known, which takes in new ones; prefix stands before each word in its text."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, held = [names[i] for i in missing.tolist()], {}
            found = [self._ids(w, prefix, held) for w in new]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            self.store, self.n_store = _grown(self.store, self.n_store, flat)
            self.first, _ = _grown(self.first, self.n, self.n_store - len(flat) + np.cumsum(sizes) - sizes)
            self.size, n = _grown(self.size, self.n, sizes)
            known.update(zip(new, range(self.n, n), strict=True))
            out[missing] = np.arange(self.n, n)
            self.n = n
        return out[coded.indices.to_numpy()]

    def _ids(self, word: str, prefix: str, held: dict[str, list[int]]) -> list[int]:
        core = word.rstrip(_MARKS)
        if len(core) == len(word) or not core[-1:].isalnum():
            return self._encoded(prefix, word)
        marks = word[len(core) :]
        if marks not in held:
            held[marks] = self._encoded("", marks)
        if prefix + core not in held:
            number = self.spaced.get(core) if prefix else None
            at = self.first[number] if number is not None else 0
            held[prefix + core] = self._encoded(prefix, core) if number is None else self.store[at : at + self.size[number]].tolist()
        return held[prefix + core] + held[marks]

    def _encoded(self, prefix: str, word: str) -> list[int]:
        """The ids of a piece. A space and a word of letters is one unit of the model, which then needs no splitting."""
        if prefix and word.isalpha() and max(word) < "\u0530":
            unit = _BYTES[32] + word if word.isascii() else (prefix + word).encode().decode("latin-1").translate(_BYTES)
            return [t.id for t in self.tokenize(unit)]
        return self.tokenizer.encode(prefix + word, add_special_tokens=False).ids


#: The letters that byte-level tokenizers write for bytes: printable ones stand for themselves, the others take those from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _grown(held: np.ndarray, n: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """held with more after its first n, and their number."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(n + 2 * len(more), held.dtype)])
    held[n : n + len(more)] = more
    return held, n + len(more)


def splits_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer (its JSON) is known to split before each single space: byte-level, text as it is, no added token with white space or that takes some."""
    pre = tokenizer.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in tokenizer.get("added_tokens") or [])
    return plain and tokenizer.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


#: A space at either end, or beside white space: there, texts are cut with more care.
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CAREFUL = rf"\A | \z| [{_WHITE}]|[{_WHITE}] "


def bounded(texts: pa.Array, most: int = TEXT_BYTES) -> list[tuple[int, int]]:
    """(first, number) of runs of texts of some `most` bytes each, one text at least."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK u32 ids each, the last of what is left; blocks of equal width are packed together."""
    whole = len(ids) // BLOCK
    out: list[bytes] = [b""] * whole
    for rows, first in ((ids[: whole * BLOCK].reshape(whole, BLOCK), 0), (ids[whole * BLOCK :].reshape(1, -1), whole)):
        if not rows.size:
            continue
        n = rows.shape[1]
        low = rows.min(1)
        rest = (rows - low[:, None]).astype("<u4")
        k = max(0, int(np.ceil(PERCENTILE * n)) - 1)
        held = np.partition(rest, k, axis=1)[:, k]
        # the bits that the percentile needs
        widths = np.where(held > 0, np.floor(np.log2(np.maximum(held, 1).astype(np.float64))).astype(np.int64) + 1, 0)
        out += [b""] * (first + len(rows) - len(out))
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            part = rest[at]
            size = (n * w + 7) // 8
            bits = np.zeros((len(at), n * w), np.uint8)
            if w:
                bits = np.unpackbits(part.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little", count=w).reshape(len(at), n * w)
            packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
            row, col = np.nonzero(part >> np.uint32(w)) if w < 32 else (np.empty(0, np.int64),) * 2
            cut = np.searchsorted(row, np.arange(len(at) + 1))
            places, values = col.astype("<u2").tobytes(), part[row, col].tobytes()
            for i, block in enumerate(at.tolist()):
                lo, hi = int(cut[i]), int(cut[i + 1])
                head = _HEAD.pack(w, 0, hi - lo, n, int(low[block]))
                out[first + block] = b"".join((head, packed[i * size : (i + 1) * size], places[2 * lo : 2 * hi], values[4 * lo : 4 * hi]))
    return out


def unpack_blocks(data: memoryview, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at starts, in order; blocks of equal width and size are unpacked together."""
    heads = [_HEAD.unpack_from(data, at) for at in starts]
    ends = np.cumsum([h[3] for h in heads])
    out = np.empty(int(ends[-1]) if heads else 0, "<u4")
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (w, _, _, n, _) in enumerate(heads):
        alike.setdefault((w, n), []).append(i)
    for (w, n), blocks in alike.items():
        size = (n * w + 7) // 8
        rest = np.zeros((len(blocks) * n, 4), np.uint8)
        if w:
            raw = np.stack([np.frombuffer(data, np.uint8, size, starts[i] + _HEAD.size) for i in blocks])
            bits = np.unpackbits(raw, axis=1, bitorder="little", count=n * w).reshape(len(blocks) * n, w)
            packed = np.packbits(bits, axis=1, bitorder="little")
            rest[:, : packed.shape[1]] = packed
        rest = rest.reshape(-1).view("<u4").reshape(len(blocks), n)
        for r, i in enumerate(blocks):
            _, _, n_over, _, low = heads[i]
            at = starts[i] + _HEAD.size + size
            row = rest[r]
            row[np.frombuffer(data, "<u2", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
            out[int(ends[i]) - n : int(ends[i])] = row + np.uint32(low)
    return out


class ShardWriter:
    def __init__(self, stream) -> None:
        self.stream, self.offset, self.offsets, self.docs = stream, 0, [], []
        self.open: list[np.ndarray] = []
        self.n_open = self.n_ids = 0
        self._put(_MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of documents one after the other, and how many each has."""
        self.docs += zip(doc_ids, counts.tolist(), strict=True)
        self.open.append(ids)
        self.n_open += len(ids)
        self.n_ids += len(ids)
        if self.n_open >= _IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, whole, _IDS):
            for block in pack_blocks(ids[lo : min(lo + _IDS, whole)]):
                self.offsets.append(self.offset)
                self._put(block)
        self.open, self.n_open = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        footer = self.offset
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._put(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([n for _, n in self.docs], "<i8").tobytes())
        self._put(_TAIL.pack(footer, len(self.offsets), len(self.docs), self.n_ids, _MAGIC))


class ShardReader:
    """Random access to a shard: its documents, and the ids of blocks in order from any block."""

    def __init__(self, stream) -> None:
        self.stream = stream
        size = stream.size()
        stream.seek(size - _TAIL.size)
        footer, n_blocks, n_docs, self.n_ids, magic = _TAIL.unpack(stream.read(_TAIL.size))
        if magic != _MAGIC:
            raise ValueError("not a shard")
        stream.seek(footer)
        data = stream.read(size - _TAIL.size - footer)
        self.offsets = np.append(np.frombuffer(data, "<u8", n_blocks), np.uint64(footer)).astype(np.int64)
        at = 8 * n_blocks
        ids, null = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)

    def ids(self, first_block: int = 0):
        """Arrays of ids from the start of first_block on."""
        step = max(1, _IDS // BLOCK)
        for b in range(first_block, len(self.offsets) - 1, step):
            end = min(b + step, len(self.offsets) - 1)
            self.stream.seek(self.offsets[b])
            data = memoryview(self.stream.read(self.offsets[end] - self.offsets[b]))
            yield unpack_blocks(data, [int(x - self.offsets[b]) for x in self.offsets[b:end]])


_ENCODERS: dict[tuple, PieceEncoder] = {}


def _encoder(path: str, pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One for each worker process, so that its memory serves all its tasks."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS[path, pieces] = PieceEncoder(path, pieces)
    return _ENCODERS[path, pieces]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, pieces: int = CACHE_PIECES) -> DataFrame:
    """Encode docs (doc_id, text) and write them to shards in folder, a URI that all executors share.

    Returns shard, file, n_docs, n_tokens, start: shards ascend with doc_id,
    null first; start counts the ids of all shards before. Null texts are
    empty; each document ends with end_id. Documents with equal doc_id stand in
    the order of a hash of their text. A task writes to a name of its own and
    the table lists the files of the tasks that counted, so a repeated task
    leaves no half file in the result. A worker remembers the ids of some pieces
    distinct pieces of text; with fewer it takes less memory and encodes more.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer, encoder = None, _encoder(tokenizer_path, pieces)
        for batch in batches:
            for at, n in bounded(batch.column("text")):
                part = batch.slice(at, n)
                if writer is None:
                    store, base = _filesystem(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{shard:06d}-{uuid.uuid4().hex}.pfor"
                    stream = store.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(stream)
                ids, counts = encoder.encode(part.column("text"))
                ended = np.full(len(ids) + n, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
                writer.add(part.column("doc_id").to_pylist(), ended, counts + 1)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids]}, _MANIFEST)

    listed = scratch.save(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


_MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' files; a shard is read in pieces of bounded size."""

    def digests(file: str, start: int):
        store, base = _filesystem(folder)
        with store.open_input_file(f"{base}/{file}") as stream:
            shard = ShardReader(stream)
            crcs = np.zeros(len(shard.doc_ids), np.int64)
            d, left, crc = 0, int(shard.lengths[0]), 0
            for ids in shard.ids():
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                while at < len(data):
                    take = min(left, (len(data) - at) // 4)
                    crc = zlib.crc32(data[at : at + 4 * take], crc)
                    at, left = at + 4 * take, left - take
                    if not left:
                        crcs[d], crc, d = crc, 0, d + 1
                        left = int(shard.lengths[d]) if d < len(crcs) else 0
            if d != len(crcs):
                raise ValueError(f"{file} has fewer ids than its documents")
            starts = start + np.concatenate([[0], np.cumsum(shard.lengths)[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crcs)], schema=_DIGEST)

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield digests(file, start)

    n = max(1, shards.count())
    return shards.select("shard", "file", "start").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_query(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    folder = Scratch(docs.sparkSession, "tokens").path("files")
    shards = write_shards(docs, folder, tokenizer_path or default_tokenizer())
    return read_digests(shards, folder)
