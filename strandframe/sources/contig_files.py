"""One text file for each contig, named prefix + contig + suffix.

Lines are dealt to tasks by ranges of (contig, order). A task writes a part for
each contig that it meets, and hands on the names of its parts alone; a contig's
parts are then joined in the order of their ranges, as a stream of bytes in a
task of its own. Contigs without lines get empty files if they are named. Parts
of tasks that failed are never listed, and all go once the files stand.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandframe.sources.formats import _opened

_COPY = 4 << 20


@dataclass
class _Parts(WriterCommitMessage):
    task: int
    #: contig to the name of its part
    names: dict[str, str]


class _PartWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        """Write the lines (contig, value) of a task, sorted by contig, one part after the other."""
        fs, folder = _opened(self.folder)
        task = TaskContext.get().partitionId()
        out, names, now = None, {}, None
        try:
            for batch in iterator:
                coded = pc.run_end_encode(batch.column("contig"))
                start = 0
                for contig, stop in zip(coded.values.to_pylist(), coded.run_ends.to_pylist(), strict=True):
                    if contig != now or out is None:
                        if out is not None:
                            out.close()
                        if contig in names:
                            raise ValueError(f"lines of {contig} are not together")
                        now, names[contig] = contig, f"{task}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(f"{folder}/{names[contig]}")
                    lines = batch.column("value").slice(start, stop - start)
                    out.write("".join([x + "\n" for x in lines.to_pylist()]).encode())
                    start = stop
        finally:
            if out is not None:
                out.close()
        return _Parts(task, names)

    def commit(self, messages) -> None:
        """List the parts, by contig in order of their tasks."""
        parts: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for contig, name in m.names.items():
                parts.setdefault(contig, []).append(name)
        fs, folder = _opened(self.folder)
        with fs.open_output_stream(f"{folder}/parts.json") as f:
            f.write("".join(json.dumps({"contig": c, "parts": p}) + "\n" for c, p in parts.items()).encode())

    def abort(self, messages) -> None:
        fs, folder = _opened(self.folder)
        for m in messages:
            for name in m.names.values() if m is not None else ():
                fs.delete_file(f"{folder}/{name}")


class ContigParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contig_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PartWriter(self.options["path"])


def write(lines: DataFrame, prefix: str, suffix: str, order: list[str], names: DataFrame | None = None) -> None:
    """Write column value of lines (contig, value and order) to prefix + contig + suffix, in order within each file.

    prefix is a folder that exists, with or without the start of file names.
    names (contig): those that get an empty file if they have no lines. Lines
    without contig are left out; a contig with a slash in its name raises.
    """
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(ContigParts)
    fs, at = _opened(prefix)
    hidden = f"parts-{uuid.uuid4().hex}"
    folder = f"{prefix[: prefix.rindex('/')]}/{hidden}" if "/" in prefix else hidden
    fs.create_dir(_opened(folder)[1])
    sorted_ = lines.where("contig is not null").repartitionByRange("contig", *order).sortWithinPartitions("contig", *order)
    fine = F.when(F.col("contig").contains("/"), F.raise_error(F.concat(F.lit("a contig with a slash: "), F.col("contig"))).cast("string")).otherwise(F.col("contig"))
    sorted_.select(fine.alias("contig"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")).write.format("contig_parts").mode("append").save(folder)

    parts = spark.read.schema("contig string, parts array<string>").json(f"{folder}/parts.json")
    if names is not None:
        parts = parts.join(names.select("contig").where("contig is not null").distinct(), "contig", "full")
    joined = parts.repartition("contig").mapInArrow(_joiner(folder, prefix, suffix), "contig string, bytes bigint")
    # the sizes are all that comes back
    joined.agg(F.sum("bytes")).collect()
    fs.delete_dir(_opened(folder)[1])


def _joiner(folder: str, prefix: str, suffix: str):
    def run(batches):
        for batch in batches:
            contigs, sizes = batch.column("contig").to_pylist(), []
            for contig, parts in zip(contigs, batch.column("parts").to_pylist(), strict=True):
                fs, at = _opened(f"{prefix}{contig}{suffix}" if "://" not in prefix else f"{prefix}{quote(contig)}{suffix}")
                size, whole = 0, f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(whole) as out:
                    for name in parts or ():
                        with fs.open_input_stream(f"{_opened(folder)[1]}/{name}") as f:
                            while data := f.read(_COPY):
                                out.write(data)
                                size += len(data)
                fs.move(whole, at)  # a file is either there as a whole or not
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("contig"), pa.array(sizes, pa.int64())], ["contig", "bytes"])

    return run
