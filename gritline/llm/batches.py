"""Feed Arrow batches to Python in slices whose text is bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of a slice has at most ``limit`` bytes.

    A row is never cut, so a longer text is a slice of its own.
    """
    for batch in batches:
        column = batch.column(text)
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(ends, int(ends[start]) + limit, "right")) - 1
            stop = min(max(stop, start + 1), len(column))
            yield batch.slice(start, stop - start)
            start = stop


def map_text(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Run ``work`` on slices of (id, text); a null text is empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield work(part)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators on text read, as (id, text)."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Running ends of ``lengths``, with a leading zero."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``values[starts[c]:starts[c + 1]]`` of all codes in a row, and where each begins."""
    lengths = np.diff(starts)[codes]
    ends = offsets_of(lengths)
    where = np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])
    return values[where], ends


def list_array(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
