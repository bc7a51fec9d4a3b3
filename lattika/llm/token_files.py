"""Token ids as Arrow files (operator 5).

Documents are dealt out by ranges of doc_id, so that the files in order hold all ids in ascending order of doc_id.
A task writes one Arrow file: the ids of its documents, one after the other, as sequences of equal length
(fixed-size lists), with a mask that is false for the padding at the end of the last one. All batches but the
last hold the same number of sequences, so sequence k lies at a computed place and is read from the mapped file
without a copy. A second small file beside it tells where each document lies.

A file's name is new for each attempt and only files named by the returned manifest count, so lost executors and
repeated tasks leave no wrong result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.batches import binary, slices
from lattika.llm.common import materialize, scratch_path, table
from lattika.llm.tokenization import TEXTS, public_path, tokenizer

#: Sequences of one record batch.
BATCH = 64


def file_system(uri: str):
    """The file system and path of a folder or file; names that Spark uses for a store are those of the store."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri else uri)


def id_type(tokenizer_path: str) -> pa.DataType:
    """16 bits where the vocabulary allows, else 32."""
    return pa.uint16() if len(tokenizer(tokenizer_path).token_bytes) <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Appends ids to one Arrow file of equal-length sequences and masks."""

    def __init__(self, uri: str, kind: pa.DataType, length: int):
        self.kind, self.length, self.held, self.count = kind, length, [], 0
        self.schema = pa.schema({"ids": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})
        system, path = file_system(uri)
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.kind.to_pandas_dtype())
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < len(ids))]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        full = self.length * BATCH
        self.held.append(ids)
        self.count += len(ids)
        if sum(map(len, self.held)) >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full])
            self.held = [flat[len(flat) // full * full :]]

    def close(self) -> None:
        if rest := sum(map(len, self.held)):
            self._batch(np.concatenate(self.held)[:rest])
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences and masks of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = file_system(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence k."""
        batch = self.reader.get_batch(k // BATCH)
        at = k % BATCH * self.length
        return batch.column(0).values.to_numpy()[at : at + self.length], batch.column(1).values.slice(at, self.length)

    def ids(self) -> np.ndarray:
        """All ids of the file without the padding."""
        batches = [self.reader.get_batch(i) for i in range(self.reader.num_record_batches)]
        flat = [b.column(0).values.to_numpy() for b in batches]
        if flat:
            flat[-1] = flat[-1][: batches[-1].column(1).values.true_count]
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32)

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from place `start` to `end`; only the batches that hold them are read."""
        size, parts = self.length * BATCH, []
        for i in range(start // size, -(-end // size)):
            values = self.reader.get_batch(i).column(0).values.to_numpy()
            parts.append(values[max(0, start - i * size) : end - i * size])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write all documents under `path`; returns the manifest: part, file, documents, tokens, first_token (one row per file).

    `end_id` follows the ids of each document; a null text is empty. Rows without doc_id come first; rows that
    share a doc_id lie side by side, by hash of their text. Long texts are encoded in segments and written whole; other columns are not read. An empty table gives an empty manifest.
    """
    vocabulary = tokenizer_path or public_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, docs_seen, counts = TaskContext.get().partitionId(), None, [], []
        for batch in slices(batches, *TEXTS):
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{path}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
                out = SequenceWriter(name, id_type(vocabulary), length)
            flat, totals = tokenizer(vocabulary).encode(batch.column(1).to_pylist(), end_id)
            out.append(flat)
            docs_seen.append(batch.column(0))
            counts.append(totals)
        if out is None:
            return
        out.close()
        index = pa.table({"doc_id": pa.chunked_array(docs_seen), "n_tokens": np.concatenate(counts)})
        system, at = file_system(name + ".docs")
        with system.open_output_stream(at) as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        yield pa.record_batch({"part": pa.array([part], pa.int64()), "file": [name], "documents": pa.array([index.num_rows], pa.int64()), "tokens": pa.array([out.count], pa.int64())})

    system, at = file_system(path)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, "part long, file string, documents long, tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents from the files of a manifest: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["file"])
                system, at = file_system(row["file"] + ".docs")
                index = pa.ipc.open_file(system.open_input_file(at)).read_all()
                counts = index["n_tokens"].to_numpy()
                ends = np.cumsum(counts)
                begin = 0
                while begin < len(counts):  # some 16 MB at a time
                    done = ends[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, done + (4 << 20), side="right")))
                    ids = file.span(int(done), int(ends[end - 1])).astype(np.uint32, copy=False)
                    yield pa.record_batch(
                        {
                            "doc_id": index["doc_id"].slice(begin, end - begin).combine_chunks(),
                            "start": row["first_token"] + ends[begin:end] - counts[begin:end],
                            "n_tokens": counts[begin:end],
                            "ids": binary(ids, counts[begin:end]),
                        }
                    )
                    begin = end

    files = max(1, manifest.count())
    spread = manifest.select("part", "file", "first_token").repartitionByRange(files, "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through files in the shared folder; ids appear as their crc32."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return read_token_files(manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
