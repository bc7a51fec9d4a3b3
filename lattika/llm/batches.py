"""Arrow batches inside tasks: slices of bounded size, binary columns over a flat buffer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

#: A slice ends after so many rows or so many bytes, whichever comes first (a longer text is a slice of its own).
SLICE_ROWS, SLICE_BYTES = 1_000, 2 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and binary values of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns if batch.num_rows else ():
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
            total += np.diff(offsets[column.offset : column.offset + len(column) + 1])
    return total


def slices(batches: Iterable[pa.RecordBatch], rows: int | None = None, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in slices that fit a worker's memory: of `rows` rows and `size` bytes, SLICE_ROWS and SLICE_BYTES where these are not given."""
    rows, size = rows or SLICE_ROWS, size or SLICE_BYTES
    for batch in batches:
        ends, at = np.cumsum(row_bytes(batch)), 0
        while at < batch.num_rows:
            within = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(at + rows, max(at + 1, within))
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()  # the worker stays for later tasks


def binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive runs of `flat`, counts[i] items long, without a copy."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())


def _frames(texts: pa.Array, press: zstandard.ZstdCompressor) -> pa.Array:
    """Each text as a compressed frame of its own; null stays null."""
    return pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.binary())], pa.binary())


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and packed: each text as a compressed frame of its own, for shuffles that move whole texts; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column(0), "packed": _frames(batch.column(1), press)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, packed binary")


def _with_type(rows: DataFrame, column: str, kind: DataType) -> StructType:
    return StructType([StructField(f.name, kind) if f.name == column else f for f in rows.schema.fields])


def compressed(rows: DataFrame, column: str = "text") -> DataFrame:
    """`rows` with a column of texts as compressed frames in its place, for shuffles that move whole rows; a null text stays null. `restored` undoes it."""
    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([_frames(c, press) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, _with_type(rows, column, BinaryType()))


def restored(rows: DataFrame, column: str = "text") -> DataFrame:
    """`rows` with the texts of a compressed column in its place, in the order of the rows."""
    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches, place):
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, _with_type(rows, column, StringType()))


def unpacked(batches: Iterable[pa.RecordBatch], place: int = 1, size: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of a packed column in its place, in slices whose texts fit a worker's memory."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, held, at, place = [], 0, 0, place % batch.num_columns

        def ready(stop: int) -> pa.RecordBatch:
            part = batch.slice(at, stop - at)
            columns = [pa.array(texts, pa.large_string()) if i == place else c for i, c in enumerate(part.columns)]
            return pa.RecordBatch.from_arrays(columns, part.schema.names)

        for i, value in enumerate(batch.column(place)):
            texts.append(press.decompress(value.as_buffer()).decode() if value.is_valid else None)
            held += len(texts[-1] or "")
            if held >= size:
                yield ready(i + 1)
                texts, held, at = [], 0, i + 1
        if texts:
            yield ready(batch.num_rows)
