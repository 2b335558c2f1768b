"""What the operators of this subpackage share: stage tables and array helpers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.tables import drop_shuffles, fresh_path, give_back, materialise, release, table

__all__ = ["drop_shuffles", "fresh_path", "gather", "give_back", "joinable", "materialise", "partitions_for", "release", "slices", "string_parts", "table", "tidy"]


def joinable(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; without one Spark shuffles and splits skew."""
    return F.broadcast(df) if rows <= most else df


#: What Python workers keep from one task to the next.
kept_in_worker: list[dict] = []


def tidy(batches, using: dict | None = None):
    """Passes batches on and then gives free memory back, as a Python worker lives on and serves other stages. What earlier stages kept in the worker goes first, but for `using`."""
    for kept in kept_in_worker:
        if kept is not using:
            kept.clear()
    yield from batches
    give_back()


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an Arrow string or binary column with offsets of 32 or 64 bits."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(lengths: np.ndarray, most: int):
    """Yield (from, to) over consecutive rows whose lengths sum to about `most`; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for every (start, length), one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def partitions_for(df: DataFrame, rows: int, each: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each))
