"""Hashes over rows in order, as one stream of bytes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattika.operators.rounds import drop, keep

#: Bytes of a row that go through the hash at a time.
PIECE = 64 << 10
#: Bytes of a stream without keys that one task hashes, about; bytes and rows of the ranges that it is put together of.
STRETCH, RANGE_BYTES, RANGE_ROWS = 128 << 20, 32 << 20, 8_192
#: Bytes of OpenSSL's SHA256_CTX: eight words of state, the length, the open block and two counts.
_STATE = 112


@cache
def _library() -> ctypes.CDLL | None:
    """OpenSSL as this interpreter links it, whose SHA-256 state is plain memory and so can go on in another task; None where it lacks these functions."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_char_p]
        lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_void_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
    except (ImportError, OSError, AttributeError):
        return None
    first = _resumed(lib, b"", [pa.py_buffer(b"a" * 100)])
    return lib if _digest(lib, _resumed(lib, first, [pa.py_buffer(b"b" * 100)])) == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest() else None


def _resumed(lib: ctypes.CDLL, state: bytes, pieces: Iterator[pa.Buffer]) -> bytes:
    """The state after some pieces more; an empty state is the beginning."""
    at = ctypes.create_string_buffer(state, 2 * _STATE)
    if not state:
        lib.SHA256_Init(at)
    for piece in pieces:
        lib.SHA256_Update(at, piece.address, piece.size)
    return at.raw[:_STATE]


def _digest(lib: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.create_string_buffer(state, 2 * _STATE))
    return out.raw.hex()


def _turns(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last range of each turn, from the ranges and their bytes in order: of STRETCH bytes, or one range that has more."""
    turns, held = [], 0
    for part, size in sizes:
        if turns and held + size <= STRETCH:
            turns[-1], held = (turns[-1][0], part), held + size
        else:
            turns, held = [*turns, (part, part)], size
    return turns


def _chained(cut: DataFrame, order: list[str], total: int, rows: int) -> str:
    """SHA-256 of `__bytes` in an order, turn by turn: each turn is a task that reads a stretch and goes on from the state (112 bytes) that the one before it left."""
    n = max(-(-total // RANGE_BYTES), -(-rows // RANGE_ROWS))
    ranged = keep(cut.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "stretches")
    sizes = ranged.groupBy("__part").agg(F.sum(F.length("__bytes"))).orderBy("__part").collect()  # a row per range
    state = b""
    for low, high in _turns([tuple(r) for r in sizes]):
        before = state

        def go_on(batches: Iterator[pa.RecordBatch], before: bytes = before) -> Iterator[pa.RecordBatch]:
            after = _resumed(_library(), before, (v.as_buffer() for batch in batches for v in batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([after], pa.binary())], ["state"])

        stretch = ranged.where(F.col("__part").between(low, high)).repartition(1).sortWithinPartitions(*order)
        state = stretch.select("__bytes").mapInArrow(go_on, "state binary").collect()[0][0]
    drop(ranged)
    return _digest(_library(), bytes(state))


def ordered_hash(rows: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """keys, hash: SHA-256 of the contents (binary, null: empty) of a key's rows in an order, one after the other.

    A stream: rows come sorted to the task of their key and go through one hash state, so a key may hold any number of bytes; contents are cut into
    pieces first, so that no batch is large. The bytes of one key are hashed one after the other, as such a hash must be; without keys all rows are one stream,
    which above STRETCH bytes goes through one task after another, each on a stretch of it (where OpenSSL's state can be handed on, else through one).
    Rows of equal order follow by their contents. A key of null is a key.
    """
    by = [*keys, *[f"__o{i}" for i in range(len(order))]]
    whole = rows.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.coalesce(content, F.lit(b"")).alias("__bytes"))
    whole = whole.withColumn("__tie", F.struct(F.sha2("__bytes", 256), F.monotonically_increasing_id()))  # the second part holds the pieces of equal rows apart
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("__bytes") - 1) / PIECE)).cast("int"))
    pieces = F.transform(starts, lambda n: F.substring("__bytes", n * PIECE + 1, F.lit(PIECE)))
    cut = whole.select(*by, "__tie", F.posexplode(pieces).alias("__n", "__bytes"))
    if not keys and _library():
        total, count = cut.agg(F.sum(F.length("__bytes")), F.count("*")).first()
        if (total or 0) > STRETCH:
            return rows.sparkSession.createDataFrame([(_chained(cut, [*by, "__tie", "__n"], total, count),)], "hash string")
    dealt = cut.repartition(*keys) if keys else cut.repartition(1)
    schema = StructType([*[rows.schema[k] for k in keys], StructField("hash", StringType())])
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(at, fields)], pa.array([state.hexdigest()])], [*keys, "hash"])

        fields = ()
        for batch in batches:
            fields = list(batch.schema)[:n]
            named = list(zip(*(c.to_pylist() for c in batch.columns[:n]))) if n else [()] * batch.num_rows
            for i, name in enumerate(named):
                if state is None or name != last:
                    if state is not None:
                        yield done()
                    at, last, state = [c.slice(i, 1) for c in batch.columns[:n]], name, hashlib.sha256()
                state.update(batch.column(n)[i].as_buffer())
        if state is not None:
            yield done()

    return dealt.sortWithinPartitions(*by, "__tie", "__n").select(*keys, "__bytes").mapInArrow(fold, schema)


def files_hash(files: DataFrame, path: str = "path", content: str = "content", mark: bytes = b"\x00") -> DataFrame:
    """hash (one row, none for no files): SHA-256 over path, mark, bytes, mark of all files in binary order of their paths."""
    nul = F.lit(mark)
    return ordered_hash(files, [], [path], F.concat(F.col(path).cast("binary"), nul, F.coalesce(content, F.lit(b"")), nul))
