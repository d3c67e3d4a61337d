"""Covered bases by query, kept up to date as alignments arrive.

State is held by (query, span of SPAN bases): the merged ranges that are
covered there, so that neither a row that comes twice nor the order of rows
matters, and no state holds a whole query. Each batch gives a row for each span
that it touches; the latest row of a span counts, and a query's coverage is the
sum over its spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandframe.operators import alignments

SPAN = 1 << 20
STATE = "starts array<bigint>, ends array<bigint>, version bigint"
UPDATES = "query_name string, query_len bigint, span bigint, version bigint, covered bigint"


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch as one, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]]) if len(starts) else np.empty(0, bool)
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])] if len(starts) else reach


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, version = state.get if state.exists else ([], [], 0)
    s, e, length = [np.array(starts, np.int64)], [np.array(ends, np.int64)], 0
    for frame in frames:
        s.append(frame["start"].to_numpy(np.int64))
        e.append(frame["end"].to_numpy(np.int64))
        length = max(length, int(frame["query_len"].max()))
    starts, ends = merged(np.concatenate(s), np.concatenate(e))
    state.update((starts.tolist(), ends.tolist(), version + 1))
    yield pd.DataFrame([(key[0], length, key[1], version + 1, int((ends - starts).sum()))], columns=["query_name", "query_len", "span", "version", "covered"])


def coverage_updates(paf: DataFrame) -> DataFrame:
    """query_name, query_len, span, version, covered of each span that a batch of the stream paf touches. Write it in update mode."""
    blocks = alignments.query_blocks(paf).where("start < end and query_name is not null")
    spans = F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("end") - 1) / SPAN))
    each = blocks.select("query_name", "query_len", "start", "end", F.explode(spans).alias("span"))
    cut = each.select("query_name", "query_len", "span", F.greatest("start", F.col("span") * SPAN).alias("start"), F.least("end", (F.col("span") + 1) * SPAN).alias("end"))
    return cut.groupBy("query_name", "span").applyInPandasWithState(_update, UPDATES, STATE, "update", GroupStateTimeout.NoTimeout)


def coverage_of(updates: DataFrame) -> DataFrame:
    """query_name, length, covered from all updates of a stream so far."""
    last = updates.groupBy("query_name", "span").agg(F.max("query_len").alias("length"), F.max_by("covered", "version").alias("covered"))
    return last.groupBy("query_name").agg(F.max("length").alias("length"), F.sum("covered").alias("covered"))
