"""Packing by power-of-two decomposition (operator 1).

The ids of a document are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence
crosses documents and none holds padding; pieces of equal length form a bucket from which batches are drawn.

Everything happens where the document lies: no shuffle, no state beyond one slice of texts, and the numbering of
sequences depends on the partition alone, so a task that runs again numbers alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattika.llm.batches import binary, slices
from lattika.llm.tokenization import TEXTS, public_path, tokenizer

#: Sequence numbers of one partition.
NUMBERS = 1 << 33


def binary_lengths(total: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and length of every piece of documents with `total` ids, document by document, longest piece first."""
    digits = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    copies = (total[:, None] & digits[None, :]) // digits
    copies[:, 0] = total // longest
    owner = np.repeat(np.arange(len(total)), copies.sum(axis=1))
    return owner, np.repeat(np.tile(digits, len(total)), copies.ravel())


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, longest: int = 2048, by: str | None = None, texts: tuple[int, int] = TEXTS, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    `longest` is a power of two. `end_id` follows the ids of each document, so an empty or null text is one piece
    of one id. Null and repeated ids of documents are packed row by row like any other; an empty table gives no
    rows; other columns are not read. Sequences of one length are the bucket `length`; buckets lie one after the other in each partition.
    `by` names a column of documents that pieces keep, last, and whose values have buckets of their own. `texts` (rows, bytes) are encoded together, and a worker remembers `remembered`
    bytes of pieces; neither changes a row.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path, kept = tokenizer_path or public_path(), [by] if by else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = tokenizer(path, remembered), TaskContext.get().partitionId() * NUMBERS
        for batch in slices(batches, *texts):
            flat, totals = encoder.encode(batch.column(1).to_pylist(), end_id)
            owner, length = binary_lengths(totals, longest)
            begin = np.cumsum(length) - length
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(owner)),
                    "start": begin - (np.cumsum(totals) - totals)[owner],
                    "length": length,
                    "ids": binary(flat, length),
                    "doc_tokens": totals[owner],
                    "sequence_id": number + np.arange(len(owner)),
                    "offset": np.zeros(len(owner), np.int64),
                    **{name: batch.column(2).take(pa.array(owner)) for name in kept},
                }
            )
            number += len(owner)

    schema = StructType.fromDDL("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    schema = StructType([*schema.fields, *[docs.schema[name] for name in kept]])
    return docs.select(F.col("doc_id").cast("long"), "text", *kept).mapInArrow(cut, schema).sortWithinPartitions(*kept, "length", "sequence_id")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as Parquet, one folder per length, for readers that draw batches of equal lengths."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents; the ids of a piece appear as their crc32."""
    from lattika.llm.common import table

    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
