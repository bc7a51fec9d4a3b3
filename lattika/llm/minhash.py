"""Near-duplicates by fast similarity sketching, banding and exact verification (operator 10).

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round i every shingle is hashed to a bin and a value, and a bin keeps
the least value of the earliest round that reached it. After T rounds with random bins come T rounds that visit
each bin in turn, so every coordinate fills; equal coordinates estimate the Jaccard similarity as sharply as T
independent minima would. Bands of ROWS coordinates find candidates: a pair at similarity 0.8 meets in none of the 32 bands with
probability 5e-8.

Plan: texts with equal shingle sets collapse to their least doc_id first. A band bucket then compares each member
with the bucket's least member only; links found are closed into components, and buckets whose members lie in
different components are compared across components on their full sets, in blocks, so that no link that joins
components is lost and no bucket meets in one task. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.batches import compressed, packed, restored, slices, unpacked
from lattika.llm.common import materialize, release, table
from lattika.llm.shingles import mix, shingle_sets
from lattika.operators.components import connected_components

#: Coordinates of a sketch (a power of two, 128 at most: a round takes 8 bits) and of a band.
T, ROWS = 128, 4
#: Shingles and rows of a block, at most, when a bucket is compared across components.
VOLUME, MEMBERS = 1_000_000, 8_192
#: Rows and columns of the incidence matrices on either side.
STRIPES, COLUMNS = (512, 1024), 2048
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: np.ndarray, counts: np.ndarray, t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; `sets` holds the sets one after the other, `counts` their sizes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(counts), t), _NONE)
    flat, active, x = out.ravel(), np.flatnonzero(counts), sets
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ mix(np.full(1, i, np.uint64)))
        bins = (h & np.uint64(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        open_ = (out[active] == _NONE).any(axis=1)
        if not open_.all():
            still = np.zeros(len(counts), bool)
            active = active[open_]
            still[active] = True
            keep = still[owner]
            x, owner = x[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of the key."""
    bands = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key.view(np.int64)


def sketch_table(docs: DataFrame, shingle: int, sketch: Callable[[np.ndarray, np.ndarray], np.ndarray] = sketches) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if it is empty) and band keys of the sketch that `sketch` makes of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, counts = shingle_sets(batch.column(1), shingle)
            ends = np.cumsum(counts)
            digests = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) if n else None for e, n in zip(ends, counts)]
            keys = band_keys(sketch(sets, counts))
            has = np.where(counts > 0, keys.shape[1], 0)
            bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has)]).astype(np.int32), keys[counts > 0].ravel())
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": counts, "digest": pa.array(digests, pa.binary()), "bands": bands})

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], shingle: int) -> Iterator[pd.DataFrame]:
    """The rows of each group of equal keys, which come one after the other, with the sorted shingle hashes of their packed texts (the last column) in the place of these."""
    held: list[pd.DataFrame] = []
    for batch in slices(unpacked(batches, place=-1)):
        flat, counts = shingle_sets(batch.column(batch.num_columns - 1), shingle)
        rows = batch.drop_columns(batch.schema.names[-1:]).to_pandas()
        rows["shingles"] = np.split(flat, np.cumsum(counts)[:-1]) if len(rows) else []
        if not len(rows):
            continue
        changes = (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)
        parts = np.split(np.arange(len(rows)), np.flatnonzero(changes) + 1)
        for at in parts:
            part = rows.iloc[at[0] : at[-1] + 1]
            if held and tuple(held[-1][keys].iloc[-1]) != tuple(part[keys].iloc[0]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _compare_groups(rows: DataFrame, keys: list[str], order: list[str], shingle: int, compare: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Links (a, b) that `compare` finds among the rows of each group, which it gets sorted, with their sets. The last column of rows is the packed text; a group must fit a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys, shingle):
            found = compare(group)
            if len(found):
                yield pa.record_batch({c: pa.array(found[c].to_numpy(np.int64)) for c in "ab"})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, "a long, b long")


def _blocks(n: str) -> Column:
    """Aggregate: how many blocks rows of `n` shingles are dealt out into."""
    return F.greatest(F.ceil(F.sum(n) / VOLUME), F.ceil(F.count(n) / MEMBERS)).cast("int")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b, n: shingles of b) whose full shingle sets have 100 * intersection >= percent * union. texts: doc_id and packed.

    All b of one a are compared with its set where they lie, in blocks, so its text travels once a block and not once a pair.
    """
    held = pairs.groupBy("a").agg(_blocks("n").alias("blocks"))
    text = lambda x: texts.select(F.col("doc_id").alias(x), "packed")
    hubs = held.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(text("a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "packed")
    rows = pairs.join(held, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")).join(text("b"), "b").select("a", "block", "b", "packed")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        is_hub = group["b"].isna().to_numpy()
        members = group[~is_hub]
        flat, counts = np.concatenate(list(members["shingles"]) or [np.zeros(0, np.uint64)]), np.array([len(s) for s in members["shingles"]], np.int64)
        owner, near = np.repeat(np.arange(len(counts)), counts), np.zeros(len(counts), bool)
        for x in group["shingles"][is_hub]:
            at = np.minimum(np.searchsorted(x, flat), max(len(x) - 1, 0))
            shared = np.bincount(owner, weights=x[at] == flat, minlength=len(counts)) if len(x) else np.zeros(len(counts))
            near |= 100 * shared >= percent * (len(x) + counts - shared)
        return members[near]

    return _compare_groups(hubs.unionByName(rows), ["a", "block"], ["b"], shingle, compare).distinct()


def links_between(outliers: pd.DataFrame, members: pd.DataFrame, percent: int, alone: bool) -> pd.DataFrame:
    """A link (a, b) for each two components that one joins: rows of `outliers` against rows of `members`.

    Both have rep, component and shingles. Intersections are counted for all pairs at once, as products of incidence
    matrices over the shingles that two rows share; `alone`: the members include the outliers.
    """
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(outliers) or not len(members):
        return none
    x, y = (np.concatenate(list(t["shingles"])) for t in (outliers, members))
    size_x, size_y = (np.array([len(v) for v in t["shingles"]]) for t in (outliers, members))
    common, counts = np.unique(y, return_counts=True)
    common = np.intersect1d(common[counts > 1] if alone else common, x)
    row_x, row_y = (np.repeat(np.arange(len(s), dtype=np.int32), s) for s in (size_x, size_y))

    def placed(v: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, v).astype(np.int32)
        known = common[np.minimum(at, len(common) - 1)] == v if len(common) else np.zeros(len(v), bool)
        return at[known], row[known]

    (at_x, row_x), (at_y, row_y) = placed(x, row_x), placed(y, row_y)
    rep_x, rep_y, own_x, own_y = (t[c].to_numpy() for c in ("rep", "component") for t in (outliers, members))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    def incidence(at: np.ndarray, row: np.ndarray, first: int, rows: int, low: int) -> np.ndarray:
        a, b = np.searchsorted(row, [first, first + rows])
        some = (at[a:b] >= low) & (at[a:b] < low + COLUMNS)
        out = np.zeros((rows, COLUMNS), np.float32)
        out[row[a:b][some] - first, at[a:b][some] - low] = 1
        return out

    for i in range(0, len(size_x), STRIPES[0]):
        for j in range(0, len(size_y), STRIPES[1]):
            x_rows, y_rows = min(STRIPES[0], len(size_x) - i), min(STRIPES[1], len(size_y) - j)
            shared = np.zeros((x_rows, y_rows), np.float32)
            for low in range(0, len(common), COLUMNS):
                shared += incidence(at_x, row_x, i, x_rows, low) @ incidence(at_y, row_y, j, y_rows, low).T
            union = size_x[i : i + x_rows, None] + size_y[None, j : j + y_rows] - shared
            close = 100 * shared.astype(np.float64) >= percent * union
            for a, b in np.argwhere(close & (own_x[i : i + x_rows, None] != own_y[None, j : j + y_rows])):
                found.setdefault((own_x[i + a], own_y[j + b]), (rep_x[i + a], rep_y[j + b]))
    return pd.DataFrame(list(found.values()), columns=["a", "b"]) if found else none


def across(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components of a bucket's members.

    members: hub, rep, n (shingles), component; buckets with one hub are one group. texts: doc_id and packed. All members outside a group's largest component
    are compared with all its members. A group of more than VOLUME shingles or MEMBERS rows is dealt out into blocks
    on either side, so each comparison holds two blocks. Texts travel packed; sets are made where they are compared. Members are read several times: hand them over written.
    """
    largest = members.groupBy("hub", "component").count().groupBy("hub").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rows = members.join(largest, "hub").withColumn("out", F.col("component") != F.col("main"))
    blocks = rows.withColumn("far", F.when(F.col("out"), F.col("n"))).groupBy("hub").agg(_blocks("far").alias("outs"), _blocks("n").alias("alls"))
    rows = rows.join(blocks, "hub").join(texts.select(F.col("doc_id").alias("rep"), "packed"), "rep").select("hub", "rep", "component", "packed", "out", "outs", "alls")
    small = rows.where("alls = 1").select("hub", "rep", "component", "out", "packed")
    within = _compare_groups(small, ["hub"], ["rep"], shingle, lambda group: links_between(group[group["out"]], group, percent, True))

    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    large = rows.where("alls > 1")
    left = large.where("out").withColumn("o", deal("outs")).withColumn("m", count("alls")).withColumn("side", F.lit(0))
    right = large.withColumn("m", deal("alls")).withColumn("o", count("outs")).withColumn("side", F.lit(1))
    columns = ["hub", "o", "m", "rep", "component", "side", "packed"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        side = group["side"].to_numpy()
        return links_between(group[side == 0], group[side == 1], percent, False)

    between = _compare_groups(left.select(columns).unionByName(right.select(columns)), ["hub", "o", "m"], ["side", "rep"], shingle, compare)
    return within.unionByName(between)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, sketch: Callable[[np.ndarray, np.ndarray], np.ndarray] = sketches) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    A link: 100 * intersection >= percent * union of the sets of `shingle`-word shingles. A text without words
    (or a null text) is linked with nothing. A row without doc_id is linked with nothing either: its component_id is null and it is kept. Rows
    that share a doc_id are one document with all their links. Texts of any length are compared whole; other columns are not read. An empty table gives no rows. `sketch` makes rows of T unsigned
    coordinates of sets, which equal one another as often as the sets are alike.
    """
    rows = materialize(sketch_table(docs, shingle, sketch), "sketches")
    linkable = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    copies = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = linkable.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    members = materialize(bands.join(buckets, "key"), "members")
    nodes = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(packed(docs).join(nodes, "doc_id", "left_semi"), "texts")
    pairs = members.where("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n"))
    links = materialize(confirmed(pairs, texts, shingle, percent), "links")
    found = connected_components(links, "a", "b", materialize)

    placed = members.join(found, members.rep == found.node, "left").select("key", "hub", "rep", "n", F.coalesce("component", "rep").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    inside = materialize(placed.join(open_, "key", "left_semi").groupBy("hub", "rep", "component").agg(F.max("n").alias("n")), "inside")  # else planned and computed a dozen times below
    every = links.union(across(inside, texts, shingle, percent))

    ids = linkable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    shared = linkable.join(ids, "doc_id", "left_semi").join(copies, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    whole = connected_components(every.union(shared), "a", "b", materialize)
    for done in (members, texts, links, inside):
        release(done)

    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(copies, "digest", "left")
    out = out.join(whole, out.rep == whole.node, "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with all its columns, without the documents that `near_duplicates` does not keep.

    Of rows that share a doc_id the one with the least hash of all columns stays; rows without doc_id all stay. Texts travel as compressed frames.
    """
    found = materialize(near_duplicates(docs, shingle, percent).select("doc_id", "kept"), "verdicts")
    gone = found.where("NOT kept").select("doc_id").distinct()
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    some = not twice.isEmpty()
    once = compressed(docs).join(gone, "doc_id", "left_anti")
    rest = restored(once.join(twice, "doc_id", "left_anti") if some else once)
    if some:
        least = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        one = docs.join(twice, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").withColumn("__least", least).where("__least = 1").drop("__least")
        rest = rest.unionByName(one)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: Rounds of least labels in the SQL below; more than the longest chain of links of a small table.
_SQL_ROUNDS = 10


def _oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps = [f"l{i + 1} AS MATERIALIZED (SELECT l.node, least(l.t, coalesce(min(m.t), l.t)) AS t FROM l{i} l LEFT JOIN both_ e ON l.node = e.a LEFT JOIN l{i} m ON e.b = m.node GROUP BY l.node, l.t)" for i in range(_SQL_ROUNDS)]
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
spread AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM spread a JOIN spread b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links), l0 AS (SELECT doc_id AS node, doc_id AS t FROM sets), {", ".join(steps)}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, t AS component_id, doc_id = t AS kept FROM sets JOIN l{_SQL_ROUNDS} ON doc_id = node
"""


OP10_SQL = _oracle()
