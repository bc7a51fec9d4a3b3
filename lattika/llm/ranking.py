"""Ranked lexical search on a two-level quantised index (operator 13).

A document's score for a query is the sum over the query's terms of w * i, where w is the term's weight and i its impact
there, in whole numbers. The index holds postings twice, a block of documents in a row of one written table: on the
first level the impacts as bytes, i / STEP rounded upward, on the second term frequencies and lengths.

A search reads the first level of all blocks: bytes give each document an upper bound, STEP * w * q, and a lower
bound, w * (STEP * (q - 1) + 1). The k-th greatest lower bound of a query over all documents is its threshold: k documents
reach it, so one whose upper bound is smaller can't be among the k best. Every document whose upper bound reaches the threshold
is rescored exactly from the second level, however many they are, and the k best of these are the answer.

Blocks lie where their texts lay: building shuffles nothing, searches shuffle at most k rows of each task and query. Queries are sent to the blocks in
groups of bounded size. Terms are 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.batches import binary, slices
from lattika.llm.common import materialize, table
from lattika.llm.shingles import word_hashes

#: Impacts are below 1,000,000, so that a byte holds them in these steps.
STEP = 1 << 12
#: Terms of the queries of a group, about; a group is sent to all tasks.
GROUP_TERMS = 1 << 17
#: Bytes that part terms: ASCII without digits and letters.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Index:
    """A written table of blocks and the counts that weights and impacts depend on: documents with a term, and terms with repeats."""

    blocks: DataFrame
    documents: int
    terms: int


def _lengths(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2, np.int64)
        for batch in slices(batches):
            counts = word_hashes(batch.column(0), BETWEEN)[1]
            found += (counts > 0).sum(), counts.sum()
        yield pa.record_batch({"n": found[:1], "terms": found[1:]})

    n, terms = docs.select("text").mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return n or 0, terms or 0


def impacts(frequency: np.ndarray, lengths: np.ndarray, n: int, terms: int) -> np.ndarray:
    """The impact of a term that occurs `frequency` times in documents of `lengths` terms."""
    distinct, at = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * int(x) * n // terms for x in distinct], np.int64)[at]  # Python integers, as the product may pass 64 bits
    return 1_000_000_000 * frequency // (1_000 * frequency + 20 * m)


_BLOCK = "docs int, terms binary, postings binary, members binary, bytes binary, doc_ids binary, absent binary, lengths binary, frequencies binary"


def build(docs: DataFrame) -> Index:
    """An index of all rows of `docs` (doc_id, text), written to the shared folder.

    Terms are runs of ASCII digits and letters and of characters beyond ASCII, with A-Z lower-cased; a null text has none. Long
    texts are whole; repeated rows and ids are documents of their own; other columns are not read. An empty table gives an empty index.
    """
    n, total = _lengths(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = word_hashes(batch.column(1), BETWEEN)
            if not len(hashes):
                continue
            owner = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)
            order = np.argsort(hashes, kind="stable")  # owners of a term stay in order
            hashes, owner = hashes[order], owner[order]
            new_term = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            first = np.flatnonzero(new_term | np.concatenate([[True], owner[1:] != owner[:-1]]))
            frequency = np.diff(first, append=len(hashes))
            starts = np.flatnonzero(new_term[first])
            members = owner[first]
            quantised = -(-impacts(frequency, counts[members], n, total) // STEP)
            columns = [
                hashes[first][starts],
                np.diff(starts, append=len(first)).astype(np.uint32),
                members,
                quantised.astype(np.uint8),
                batch.column(0).fill_null(0).to_numpy(),
                batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                counts,
                frequency.astype(np.uint32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([len(counts)], pa.int32()), *(binary(c, np.array([len(c)])) for c in columns)], [c.split()[0] for c in _BLOCK.split(", ")])

    return Index(materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK), "lexical-index"), n, total)


def _queries(items: DataFrame) -> DataFrame:
    """item_id, n and terms (distinct hashes) of each item that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = word_hashes(batch.column(1), BETWEEN)
            parts = [np.unique(p) for p in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
            held = np.array([len(p) for p in parts], np.int64)
            rows = pa.record_batch({"item_id": batch.column(0), "n": held, "terms": binary(np.concatenate([*parts, hashes[:0]]), held)})
            yield rows.filter(pa.array(held > 0))

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, n long, terms binary")


@dataclass
class Group:
    """Queries that meet the blocks together: their distinct terms (sorted) with weights, and for each the places of its terms."""

    ids: list
    terms: np.ndarray
    places: list[np.ndarray]
    weights: np.ndarray


def _grouped(rows: list) -> Group:
    held = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    terms = np.unique(np.concatenate(held))
    return Group([r["item_id"] for r in rows], terms, [np.searchsorted(terms, h) for h in held], np.zeros(len(terms), np.int64))


def _parts(batch: pa.RecordBatch, **types) -> Iterator[dict[str, np.ndarray]]:
    """The named binary columns of each block as arrays, and docs."""
    for i in range(batch.num_rows):
        yield {"docs": batch.column("docs")[i].as_py()} | {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in types.items()}


def _document_counts(index: Index, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each term; `terms` is one group's."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for b in _parts(batch, terms=np.uint64, postings=np.uint32):
                at = np.searchsorted(sent.value, b["terms"])
                known = sent.value[np.minimum(at, len(found) - 1)] == b["terms"]
                found[at[known]] += b["postings"][known]
        some = np.flatnonzero(found)
        yield pa.record_batch({"term": some, "n": found[some]})

    rows = index.blocks.select("docs", "terms", "postings").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"]
    return out


def _bounded(block: dict[str, np.ndarray], group: Group) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query with a term in the block: its number, upper and lower bounds of all documents of the block, and the places of its terms in the block."""
    at = np.searchsorted(block["terms"], group.terms)
    known = block["terms"][np.minimum(at, len(block["terms"]) - 1)] == group.terms
    row = np.where(known, np.cumsum(known) - 1, -1)
    at = at[known]
    ends = np.cumsum(block["postings"], dtype=np.int64)
    lengths = block["postings"][at].astype(np.int64)
    which = np.repeat(np.arange(len(at)), lengths)
    posting = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(ends[at] - lengths, lengths)
    quantised = np.zeros((len(at), block["docs"]), np.uint8)
    quantised[which, block["members"][posting]] = block["bytes"][posting]
    weights = group.weights[known].astype(np.float64)  # sums stay far below 2 ** 53
    for q, places in enumerate(group.places):
        rows = row[places]
        rows = rows[rows >= 0]
        if len(rows):
            values = quantised[rows].astype(np.float64)
            upper = weights[rows] @ values
            below = weights[rows] @ (values > 0)
            yield q, STEP * upper, STEP * upper - (STEP - 1) * below, at[rows]


def _greatest(values: np.ndarray, k: int) -> np.ndarray:
    return values if len(values) <= k else np.partition(values, len(values) - k)[len(values) - k :]


def _thresholds(index: Index, group: Group, k: int) -> np.ndarray:
    """The k-th greatest lower bound of each query over all documents; 0 where fewer than k have one."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * len(sent.value.ids)
        for batch in batches:
            for block in _parts(batch, terms=np.uint64, postings=np.uint32, members=np.uint16, bytes=np.uint8):
                for q, _, lower, _ in _bounded(block, sent.value):
                    held[q] = _greatest(np.concatenate([held[q], lower[lower > 0]]), k)
        of = np.repeat(np.arange(len(held)), [len(h) for h in held])
        yield pa.record_batch({"query": of, "lower": np.concatenate([*held, np.zeros(0)])})

    rows = index.blocks.select("docs", "terms", "postings", "members", "bytes").mapInArrow(run, "query long, lower double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    found = rows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query", "lower").toPandas()
    out = np.zeros(len(group.ids))
    out[found["query"].to_numpy(np.int64)] = found["lower"]
    return out


def _rescored(index: Index, group: Group, thresholds: np.ndarray, k: int) -> DataFrame:
    """item_id, doc_id, score: of each task and query the k best of all documents whose upper bound reaches the threshold."""
    sent = index.blocks.sparkSession.sparkContext.broadcast((group, thresholds, index.documents, index.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, thresholds, n, total = sent.value
        held = [np.zeros((3, 0), np.int64)] * len(group.ids)  # score, is doc_id known, doc_id
        for batch in batches:
            for b in _parts(batch, terms=np.uint64, postings=np.uint32, members=np.uint16, bytes=np.uint8, doc_ids=np.int64, absent=np.uint8, lengths=np.int64, frequencies=np.uint32):
                ends = np.cumsum(b["postings"], dtype=np.int64)
                for q, upper, _, at in _bounded(b, group):
                    candidate = upper >= max(thresholds[q], 1)
                    if not candidate.any():
                        continue
                    scores = np.zeros(b["docs"], np.int64)
                    for t in at:  # the terms of one query
                        span = slice(ends[t] - b["postings"][t], ends[t])
                        members = b["members"][span]
                        some = candidate[members]
                        exact = impacts(b["frequencies"][span][some].astype(np.int64), b["lengths"][members[some]], n, total)
                        scores[members[some]] += group.weights[np.searchsorted(group.terms, b["terms"][t])] * exact
                    found = np.flatnonzero(scores)
                    rows = np.concatenate([held[q], np.stack([scores[found], 1 - b["absent"][found], b["doc_ids"][found]])], axis=1)
                    held[q] = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[:k]]
        of = np.repeat(np.arange(len(held)), [h.shape[1] for h in held])
        rows = np.concatenate([*held, np.zeros((3, 0), np.int64)], axis=1)
        yield pa.record_batch({"item_id": pa.array([group.ids[q] for q in of], pa.int64()), "doc_id": pa.array(rows[2], mask=rows[1] == 0), "score": rows[0]})

    return index.blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each row of `items` (item_id, text): item_id, rank (from 1), doc_id, score.

    Highest score first, equal scores by ascending doc_id (documents without an id before them); all documents with a score above 0 where there are fewer than k.
    Terms count once in an item. Items without a term, or without one that a document holds, have no rows; of items that share an item_id
    one (the least by its terms) is asked; an item without an id is asked as such. Columns other than item_id and text are not read.
    """
    asked = materialize(_queries(items).groupBy("item_id").agg(F.min(F.struct(F.hex("terms").alias("h"), "n", "terms")).alias("q")).select("item_id", "q.n", "q.terms"), "items")
    terms = asked.agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(terms / GROUP_TERMS))
    found = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # some GROUP_TERMS terms
        if not rows or not index.documents:
            continue
        group = _grouped(rows)
        counts = _document_counts(index, group.terms)
        group.weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(c) + 1))) for c in counts], np.int64)
        found.append(_rescored(index, group, _thresholds(index, group, k), k))
    schema = "item_id long, rank int, doc_id long, score long"
    if not found:
        return items.sparkSession.createDataFrame([], schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranking(spark, sf_dir: str) -> DataFrame:
    """All benchmark items against an index of all documents."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH words AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
postings AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words),
counted AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM postings GROUP BY doc_id, n, term),
weighted AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, sizes GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN weighted USING (term) JOIN counted USING (term), sizes GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
