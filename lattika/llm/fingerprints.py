"""Document fingerprints by MinHash under many universal hash permutations (operator 11).

A text's shingles are folded to 32 bits and sent through PERMUTATIONS functions x -> (a * x + b) >> 32 of 64-bit
arithmetic with random a and b, which are strongly universal (Dietzfelbinger 1996); the least value under each is a
coordinate of the signature. Two signatures agree in a coordinate as often as the sets of shingles are alike. The
fingerprint keeps 16 bits of each least value: two different ones agree by chance once in 65,536 cases.

`classes` finds near-duplicates: signature bands are joined in Spark, every link is verified on the full sets.
`edited` fingerprints each document and its edited text, whose second half is that of the next document. Documents are dealt out by
ranges of doc_id; a task sees its documents in order and only the last one of a task still waits for a text. These,
one for each task, are finished in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.batches import packed, slices, unpacked
from lattika.llm.common import materialize, release, shuffles_dropped, table
from lattika.llm.minhash import near_duplicates
from lattika.llm.shingles import shingle_sets

#: Functions of a signature (a multiple of the four coordinates of a band), and words of a shingle.
PERMUTATIONS, SHINGLE = 128, 5
#: Shingles that go through the functions at a time, so that temporary arrays stay in the cache.
STRIPE = 1 << 14
_RANDOM = np.random.default_rng(11).integers(0, 1 << 63, (2, PERMUTATIONS), np.uint64, endpoint=True)
_A, _B = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1] * np.uint64(2)
#: A coordinate of an empty set.
EMPTY = np.uint32(0xFFFFFFFF)


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of PERMUTATIONS least values for each set; `sets` holds the hashed shingles of one set after the other, `counts` their number."""
    out = np.full((len(counts), PERMUTATIONS), EMPTY)
    folded = (sets ^ (sets >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
    ends = np.cumsum(counts)
    for low in range(0, len(sets), STRIPE):
        x = folded[low : low + STRIPE]
        rows = np.flatnonzero((ends > low) & (ends - counts < low + STRIPE) & (counts > 0))
        starts = np.maximum((ends - counts)[rows] - low, 0)
        for i in range(PERMUTATIONS):
            least = np.minimum.reduceat((x * _A[i] + _B[i]) >> np.uint64(32), starts)
            out[rows, i] = np.minimum(out[rows, i], least.astype(np.uint32))
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A row of PERMUTATIONS 16-bit coordinates for each text; A-Z count as a-z, a null text as empty."""
    return (signatures(*shingle_sets(texts, shingle)) & np.uint32(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, row by row."""
    return (a == b).mean(axis=1)


def _bytes(prints: np.ndarray) -> pa.Array:
    """Rows as binary values, most significant byte first."""
    return pa.array([r.tobytes() for r in prints.astype(">u2")], pa.binary())


def fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles (distinct) and fingerprint (binary) of each row of `docs`, without a shuffle.

    A null text is empty; texts without words share the fingerprint of the empty set; a text of fewer than `shingle` words has its
    whole sequence as its one shingle. Long texts are whole. Null and repeated ids pass through; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, counts = shingle_sets(batch.column(1), shingle)
            prints = (signatures(sets, counts) & np.uint32(0xFFFF)).astype(np.uint16)
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": counts, "fingerprint": _bytes(prints)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, class_id: the least doc_id that each document reaches over links, 100 * intersection >= percent * union of sets of shingles.

    Bands of four coordinates find candidates: a pair at the threshold of 80 % meets in none of the 32 bands with probability 5e-8. Every link is
    verified on the full sets. One row per doc_id; documents without words are classes of their own; rows without doc_id are left out.
    """
    found = near_duplicates(docs, shingle, percent, signatures)
    out = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("class_id")), "classes")
    release(found)  # sketches and labels, which are larger than the answer
    return out


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _COMPARED.split(", ")]


def _edit(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text, or all where it has fewer."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: pa.Array, texts: list[str], following: list[str], shingle: int, own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """The rows of documents whose next texts are known; `own` and `after` are the fingerprints of both."""
    changed = [_edit(a, b) for a, b in zip(texts, following)]
    prints = fingerprints(pa.array(changed, pa.large_string()), shingle)
    columns = [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        _bytes(own),
        _bytes(prints),
        pa.array(likeness(own, prints)),
        pa.array(likeness(own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def edited(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (binary), near_edited, near_next.

    The next document is that of the next doc_id; rows without doc_id come first, rows that share one lie side by side, equal texts next to one another; after the
    last comes the first, so a single document follows itself. A null text is empty. Long texts are whole. Other columns are not read; an empty table gives no rows.
    """
    extra = "part long, first_text string, last_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, opening = TaskContext.get().partitionId(), None, None

        def placed(rows: pa.RecordBatch, last_text: str | None) -> pa.RecordBatch:
            """The rows with the texts of the task's first and last document, where these are among them."""
            n = rows.num_rows
            more = [pa.array([part] * n, pa.int64()), pa.array([opening] + [None] * (n - 1), pa.string()), pa.array([None] * (n - 1) + [last_text], pa.string())]
            return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "part", "first_text", "last_text"])

        for batch in slices(unpacked(batches)):
            if not batch.num_rows:
                continue
            ids, texts, prints = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], fingerprints(batch.column(1), shingle)
            if held is None:
                opening = texts[0]
            else:  # the last document of the slice before
                ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2], prints])
            held = (ids[-1:], texts[-1], prints[-1:])
            if len(texts) > 1:
                yield placed(_compared(ids[:-1], texts[:-1], texts[1:], shingle, prints[:-1], prints[1:]), None)
                opening = None
        if held is not None:
            unknown = pa.nulls(1, pa.string()), _bytes(held[2]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())
            yield placed(pa.RecordBatch.from_arrays([held[0], pa.array([len(held[1])], pa.int64()), *unknown], _NAMES), held[1])

    ordered = packed(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    found = materialize(ordered.mapInArrow(run, f"{_COMPARED}, {extra}"), "fingerprints")

    firsts = found.where("first_text IS NOT NULL").select(F.col("part").alias("next_part"), "first_text", F.col("fingerprint").alias("first_print"))
    lasts = found.where("last_text IS NOT NULL").select("part", "doc_id", "last_text", "fingerprint")
    in_order = Window.orderBy("part")  # a row per task
    follows = lasts.select("part").select("part", F.lead("part").over(in_order).alias("n"), F.min("part").over(in_order).alias("least")).select("part", F.coalesce("n", "least").alias("next_part"))
    waiting = lasts.join(follows, "part").join(firsts, "next_part").select("doc_id", "last_text", "fingerprint", "first_text", "first_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, after = (np.array([np.frombuffer(v.as_py(), ">u2") for v in batch.column(i)], np.uint16).reshape(-1, PERMUTATIONS) for i in (2, 4))
            yield _compared(batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist(), shingle, own, after)

    return found.where("last_text IS NULL").drop("part", "first_text", "last_text").unionByName(waiting.mapInArrow(finish, _COMPARED))


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents, with the class of near-duplicates that each belongs to; fingerprints appear in hexadecimal digits."""
    docs = table(spark, sf_dir, "documents")
    with shuffles_dropped(spark):
        near = classes(docs)
        rows = edited(docs)
    hexed = [F.lower(F.hex(c)).alias(c) if c.endswith("fingerprint") else F.col(c) for c in rows.columns]
    return rows.join(near, "doc_id", "left").select(*hexed, "class_id")
