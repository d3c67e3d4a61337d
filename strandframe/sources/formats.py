"""Text formats as Spark data sources: spark.read.format("paf").load("a.paf").

register(spark) makes known lines, paf, gaf, bed, gfa and fasta. Files are read
by ranges of bytes, each a task of its own, and a line belongs to the range in
which it begins; files that end in .gz are one range. The key (file_ord, pos)
sorts lines as they stand in the files: pos is the line's true offset in bytes
(of the unpacked text for .gz). Paths may be local or of any file system that
Arrow opens, globs are expanded, and several are separated by commas.

Options: split (bytes of a range), strict (default true): lines that don't fit
their format raise, rather than being left out, and, for gfa, kinds: the kinds
of lines to read, all if it isn't given. Kinds are no pushed filter, as Spark
4.1 keeps one set of pushed filters for all places of a table in a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
_BLOCK = 4 << 20
#: Kinds of graph lines: header, segment, edge, link, containment, path, walk, gap, fragment, ordered and unordered group, comment, annotation, alignment.
GRAPH_KINDS = "HSELCPWGFOU#xa"

_ALIGNED = (
    "file_ord int, pos bigint, query_name string, query_len bigint, query_start bigint, query_end bigint, strand string, {target} string, {target_len} bigint, "
    "{start} bigint, {end} bigint, {matches} bigint, {bases} bigint, mapq bigint, tags array<struct<key:string,type:string,val:string>>, value string"
)
SCHEMAS = {
    "lines": "file_ord int, pos bigint, value string",
    "paf": _ALIGNED.format(target="target_name", target_len="target_len", start="target_start", end="target_end", matches="num_matching", bases="num_bases"),
    "gaf": _ALIGNED.format(target="path", target_len="path_len", start="path_start", end="path_end", matches="matches", bases="block_len"),
    "bed": "name string, start bigint, end bigint",
    "gfa": "file_ord int, pos bigint, value string, kind string, t array<string>",
    "fasta": "file_ord int, split bigint, record int, name string, description string, pos bigint, at bigint, bases string, line_chars int, eol int",
}


@dataclass
class Range(InputPartition):
    file_ord: int
    path: str
    start: int
    end: int


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that a glob matches, by name."""
    fs, at = _opened(path)
    place = lambda p: p if "://" not in path else path[: len(path) - len(at)] + p
    if any(c in at for c in "*?["):
        from fnmatch import fnmatch

        folder = at[: at.rindex("/")] if "/" in at else "."
        found = fs.get_file_info(pyarrow.fs.FileSelector(folder))
        return sorted(place(f.path) for f in found if f.is_file and fnmatch(f.base_name, at.rpartition("/")[2]))
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.Directory:
        return sorted(place(f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
    if not info.is_file:
        raise FileNotFoundError(path)
    return [path]


def ranges(paths: list[str], split: int = SPLIT) -> list[Range]:
    out = []
    for i, path in enumerate(f for p in paths for f in _files(p)):
        fs, at = _opened(path)
        size = fs.get_file_info(at).size
        step = max(1, size) if path.endswith(".gz") else split
        out += [Range(i, path, start, start + step) for start in range(0, max(1, size), step)]
    return out


def whole_lines(part: Range, block: int = _BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of runs of whole lines that begin in a range; the last line of a file may lack its end."""
    fs, at = _opened(part.path)
    packed = part.path.endswith(".gz")
    end = 1 << 62 if packed else part.end
    with fs.open_input_stream(at, compression="gzip") if packed else fs.open_input_file(at) as f:
        # a line that begins in the range comes after the end of one before it
        pos = max(0, part.start - 1)
        if not packed:
            f.seek(pos)
        skip, rest = part.start > 0, b""
        while pos + len(rest) < end + block or rest:
            data = f.read(block)
            held, rest = rest + data, b""
            if skip:
                cut = held.find(b"\n") + 1
                skip = not cut
                pos += cut or len(held)
                held = held[cut:] if cut else b""
                if pos >= end:
                    return
            if not data:
                if held:
                    yield pos, held
                return
            cut = held.rfind(b"\n") + 1
            if pos + cut >= end and cut:
                cut = held.find(b"\n", end - pos - 1) + 1
                yield pos, held[:cut]
                return
            if cut:
                yield pos, held[:cut]
            pos, rest = pos + cut, held[cut:]


def arrow_lines(pos: int, data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Offsets and texts, without their ends, of the lines of data, which starts at pos."""
    stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    edges = np.concatenate([[0], stops, [] if len(stops) and stops[-1] == len(data) else [len(data)]]).astype(np.int32)
    lines = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
    return pos + edges[:-1].astype(np.int64), pc.utf8_rtrim(lines, "\r\n")


def _fields(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First place and number of the fields of each line, empty ones left out, among all fields."""
    split = pc.split_pattern(lines, "\t")
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(flat, "")
    flat, of = flat.filter(full), of[full.to_numpy(zero_copy_only=False)]
    counts = np.bincount(of, minlength=len(lines))
    return np.cumsum(counts) - counts, counts, flat


def _tags(first: np.ndarray, counts: np.ndarray, flat: pa.Array) -> pa.Array:
    """Fields from the thirteenth on that look like KK:T:value, as lists of structs."""
    extra = np.maximum(counts - 12, 0)
    place = np.repeat(first + 12 - (np.cumsum(extra) - extra), extra) + np.arange(int(extra.sum()))
    parts = flat.take(pa.array(place))
    ok = pc.match_substring_regex(parts, "^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")
    of = np.repeat(np.arange(len(counts)), extra)[ok.to_numpy(zero_copy_only=False)]
    parts = parts.filter(ok)
    cut = lambda a, b: pc.utf8_slice_codeunits(parts, a, b)
    structs = pa.StructArray.from_arrays([cut(0, 2), cut(3, 4), cut(5, None)], ["key", "type", "val"])
    sizes = np.bincount(of, minlength=len(counts))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), structs)


def _bad(kind: str, lines: pa.Array, bad: np.ndarray, strict: bool) -> None:
    if strict and bad.any():
        raise ValueError(f"not {kind}: {lines[int(bad.argmax())].as_py()[:100]}")


class _Reader(DataSourceReader):
    def __init__(self, kind: str, schema, options: dict) -> None:
        self.kind, self.split = kind, int(options.get("split", SPLIT))
        self.strict = options.get("strict", "true").lower() == "true"
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.names = list(schema.names)
        self.kinds = set(options["kinds"]) if options.get("kinds") else None
        if not self.paths:
            raise ValueError("no path")

    def partitions(self) -> list[Range]:
        return ranges(self.paths, self.split)

    def read(self, part: Range):
        if self.kind == "fasta":
            yield from _fasta(part)
            return
        for pos, data in whole_lines(part):
            at, lines = arrow_lines(pos, data)
            keep = pc.not_equal(pc.utf8_trim_whitespace(lines), "") if self.kind != "lines" else pa.array(np.ones(len(lines), bool))
            lines, at = lines.filter(keep), at[keep.to_numpy(zero_copy_only=False)]
            if len(lines):
                yield from getattr(self, "_" + self.kind)(part.file_ord, at, lines)

    def _batch(self, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], self.names)

    def _key(self, file_ord: int, at: np.ndarray) -> list[np.ndarray]:
        return [np.full(len(at), file_ord, np.int32), at]

    def _lines(self, file_ord, at, lines):
        yield self._batch([*self._key(file_ord, at), lines])

    def _gfa(self, file_ord, at, lines):
        kind = pc.utf8_slice_codeunits(lines, 0, 1)
        known = pc.is_in(kind, pa.array(list(GRAPH_KINDS)))
        _bad("a graph line", lines, ~known.to_numpy(zero_copy_only=False), self.strict)
        keep = known if self.kinds is None else pc.and_(known, pc.is_in(kind, pa.array(sorted(self.kinds), pa.string())))
        at, lines, kind = at[keep.to_numpy(zero_copy_only=False)], lines.filter(keep), kind.filter(keep)
        if len(lines):
            yield self._batch([*self._key(file_ord, at), lines, kind, pc.split_pattern(pc.utf8_rtrim_whitespace(lines), "\t")])

    def _bed(self, _file_ord, _at, lines):
        lines = lines.filter(pc.invert(pc.match_substring_regex(lines, "^(#|track|browser)")))
        first, counts, flat = _fields(pc.replace_substring(lines, " ", "\t"))
        first = first[counts >= 3]
        if len(first):
            yield self._batch([flat.take(pa.array(first)), *(flat.take(pa.array(first + i)).cast(pa.int64()) for i in (1, 2))])

    def _paf(self, file_ord, at, lines, star=False):
        if star:  # minimizer rows
            keep = pc.invert(pc.starts_with(lines, "*"))
            at, lines = at[keep.to_numpy(zero_copy_only=False)], lines.filter(keep)
        first, counts, flat = _fields(lines)
        signs = pa.array(["+", "-", "*"] if star else ["+", "-"])
        strand = flat.take(pa.array(np.where(counts >= 12, first + 4, 0))) if len(flat) else flat
        bad = (counts < 12) | ~pc.is_in(strand, signs).to_numpy(zero_copy_only=False) if len(flat) else np.ones(len(lines), bool)
        _bad("GAF" if star else "PAF", lines, bad, self.strict)
        good = np.flatnonzero(~bad)
        if not len(good):
            return
        at, lines, first, counts = at[good], lines.take(pa.array(good)), first[good], counts[good]
        columns = []
        for i in range(12):
            one = flat.take(pa.array(first + i))
            if star and i != 4:
                one = pc.if_else(pc.equal(one, "*"), pa.scalar(None, pa.string()), one)
            columns.append(one if i in (0, 4, 5) else one.cast(pa.int64()))
        if star:  # 255 says that there is none
            columns[11] = pc.if_else(pc.equal(columns[11], 255), pa.scalar(None, pa.int64()), columns[11])
        yield self._batch([*self._key(file_ord, at), *columns, _tags(first, counts, flat), lines])

    def _gaf(self, file_ord, at, lines):
        yield from self._paf(file_ord, at, lines, star=True)


#: Header lines are shorter than this; it is how far a range looks back for the start of its first line.
_LONGEST_HEADER = 1 << 16
#: Letters of a piece of a sequence, at most.
_PIECE = 1 << 17


def _fasta(part: Range, block: int = _BLOCK) -> Iterator[pa.RecordBatch]:
    """Pieces of sequences. record counts the headers that begin in a range from 1; what comes before the first one, of a record begun earlier, is record 0 without a name.

    A base belongs to the range that holds its byte, so lines may be of any
    length; a header line is read to its end by the range in which it begins.
    at counts the bases of the record before the piece in this range, and pos
    is the offset of its first byte. line_chars is the number of its bases
    before its first line end, of eol bytes; null if it has none. A record has
    a row without bases first. FASTQ is not read.
    """
    fs, place = _opened(part.path)
    packed = part.path.endswith(".gz")
    end = 1 << 62 if packed else part.end
    names = [x.split()[0] for x in SCHEMAS["fasta"].split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    with fs.open_input_stream(place, compression="gzip") if packed else fs.open_input_file(place) as f:
        begins, skips = True, False  # whether a line begins here, and whether a header goes on that began before
        ended, last = False, b""  # whether the record's first line end was told, and the byte before
        if part.start and not packed:
            f.seek(max(0, part.start - _LONGEST_HEADER))
            back = f.read(min(part.start, _LONGEST_HEADER))
            line = back[back.rfind(b"\n") + 1 :] if b"\n" in back or len(back) == part.start else b""
            begins, skips, last = back.endswith(b"\n"), line.startswith(b">"), back[-1:]
        pos, record, at, head, name, description = part.start, 0, 0, None, None, None
        while True:
            data = f.read(min(block, end - pos) if pos < end else 1 << 12)
            rows: list[tuple] = []
            i = 0
            while i < len(data):
                if skips or head is not None:
                    stop = data.find(b"\n", i) + 1
                    if head is not None:
                        head += data[i : stop or len(data)]
                    i = stop or len(data)
                    if not stop:
                        break
                    begins, skips = True, False
                    if head is not None:
                        words = head[1:].decode().split(None, 1)
                        name, description = (words[0] if words else ""), (words[1].strip() if len(words) > 1 else "")
                        record, at, head, ended = record + 1, 0, None, False
                        rows.append((part.file_ord, part.start, record, name, description, pos + i, 0, "", None, None))
                if pos + i >= end or i >= len(data):
                    break
                if begins and data[i : i + 1] == b">":
                    head = b""
                    continue
                stop = min(data.find(b"\n>", i) + 1 or len(data), i + _PIECE, end - pos)
                text = data[i:stop]
                bases = text.translate(None, b"\r\n \t")
                line, found, _ = text.partition(b"\n")
                if bases or (found and not ended):
                    chars = len(line.translate(None, b"\r \t")) if found else None
                    eol = 1 + (line or last).endswith(b"\r") if found else None
                    rows.append((part.file_ord, part.start, record, name, description, pos + i, at, bases.decode(), chars, eol))
                    at += len(bases)
                    ended = ended or bool(found)
                begins, last, i = text.endswith(b"\n"), text[-1:], stop
            if not data and head is not None:  # a header at the very end
                words = head[1:].decode().split(None, 1)
                rows.append((part.file_ord, part.start, record + 1, words[0] if words else "", words[1].strip() if len(words) > 1 else "", pos, 0, "", None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            pos += len(data)
            if not data or (pos >= end and head is None):
                return


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMAS[kind]

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, schema, self.options)

    Source.__name__ = Source.__qualname__ = kind.capitalize() + "Source"
    return Source


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for kind in SCHEMAS:
        spark.dataSource.register(_source(kind))
