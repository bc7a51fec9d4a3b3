"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking (operator 3).

Coarse centroids and the codebooks of the residuals are trained on a bounded sample (SAMPLE vectors); every vector is
indexed: its nearest centroid's list, and a byte for each part of its residual. A query probes its nearest lists, as many as
TRIED of the queries, which may lie elsewhere than the rest, need among the sample for a recall of RECALL. A table of the query's products with all codewords gives the approximate distance of
every probed member by look-ups, the nearest of all probed lists together are the query's candidates (RERANK, or more where the
same queries show that codes tell neighbours apart less well), and only these are measured exactly, on the original vectors.

Lists are dealt out into blocks of about BLOCK vectors: small lists that lie close together share a block, a list that a vector
repeated by a third of all rows fills is many blocks. The first pass sends codes alone to the blocks, the
second the vectors. What each pass returns of a query is bounded by its candidates, and Spark cuts it down within a task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.common import materialize, release, table

#: Training vectors, at most; coarse lists, at most (the square root of the vectors below that); codewords of a part, at most; components of a part, about.
SAMPLE, LISTS, WORDS, PART = 20_000, 2048, 256, 4
#: Share of the queries' true neighbours in the sample that the probed lists must hold; queries that measure it.
RECALL, TRIED = 0.96, 256
#: Share of them that the candidates must hold.
CODED = 0.98
#: Least number of candidates of a query that are measured exactly (a block returns no more than there are, and only those within the distance that as many of the sample keep within); vectors of a block; queries that meet a block in one task, fewer where they have more candidates.
RERANK, BLOCK, QUERY_BLOCK = 200, 4096, 4096


def _nearest(x: np.ndarray, centers: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    d = (centers**2).sum(axis=1) - 2 * x @ centers.T
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centers of x (fewer where x has fewer distinct rows)."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centers = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = _nearest(x, centers)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


class Quantizer:
    """Coarse centers and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.coarse = k_means(sample, lists)
        residual = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.cuts = np.linspace(0, self.dim, max(1, -(-self.dim // PART)) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], WORDS, 8) for a, b in zip(self.cuts, self.cuts[1:])]
        own, codes, _ = self.encode(sample)
        self.coded = self.coarse[own] + np.concatenate([w[codes[:, i]] for i, w in enumerate(self.books)], axis=1)  # the sample as its codes say; dropped once it was measured

    def candidates(self, asked: np.ndarray, apart: np.ndarray, k: int, total: int, share: float = CODED) -> int:
        """The number of nearest coded ones that hold `share` of the asked vectors' k nearest among all `total` vectors.

        apart: squared distances of the asked from the sample, infinite for themselves. The sample's nearest stand for the neighbours that lie as close among all; what the codes
        put no farther away than one of them, though it is, comes before it.
        """
        size = apart.shape[1]
        wanted, before = max(1, -(-k * size // max(total, 1))), []
        for query, far in zip(asked, apart):
            seen = np.where(np.isfinite(far), ((self.coded - query) ** 2).sum(axis=1), np.inf)
            for t in np.argsort(far, kind="stable")[:wanted]:
                if np.isfinite(far[t]):
                    before.append(int(((seen <= seen[t] * (1 + 1e-9)) & (far > far[t] * (1 + 1e-9))).sum()))
        return k + -(-sorted(before)[int(np.ceil(share * len(before))) - 1] * total // size) if before else k

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of each row, and the part of its distance to any query that does not depend on the query: |r|^2 + 2 c.r for center c and coded residual r."""
        own = _nearest(x, self.coarse)[:, 0]
        center = self.coarse[own]
        codes = np.stack([_nearest((x - center)[:, a:b], w)[:, 0] for a, b, w in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        coded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), (coded * (coded + 2 * center)).sum(axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """-2 q.w for all codewords w, parts x WORDS: with a member's own part and its center's distance, the squared distance to it."""
        out = np.zeros((len(self.books), WORDS))
        for i, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[i, : len(w)] = -2 * (w @ query[a:b])
        return out

    def probes(self, sample: np.ndarray, asked: np.ndarray, apart: np.ndarray, k: int, recall: float = RECALL) -> int:
        """The least number of nearest lists that hold `recall` of the asked vectors' k nearest sample vectors, measured by brute force (apart: squared distances, infinite for themselves).

        Neighbours among all vectors are nearer than those of the sample, so the sample asks for rather too many lists.
        """
        k = min(k, apart.shape[1])
        near = np.argpartition(apart, k - 1, axis=1)[:, :k]
        order = _nearest(asked, self.coarse, len(self.coarse)).reshape(len(asked), -1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        needed = np.take_along_axis(place, _nearest(sample, self.coarse)[:, 0][near], 1)
        needed = np.sort(needed[np.isfinite(np.take_along_axis(apart, near, 1))])
        return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else len(self.coarse)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of a list column without nulls, in double precision."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def blocks(held: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list: lists of more than BLOCK vectors have blocks of their own, close ones share a block."""
    first, parts, at, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), -1, 0
    regions = _nearest(coarse, k_means(coarse, int(-(-held.sum() // BLOCK)) or 1))[:, 0]
    large = held > BLOCK
    for i in np.argsort(regions, kind="stable"):
        if large[i]:
            continue
        if at < 0 or held[i] > room:
            at, room = at + 1, BLOCK
        first[i] = at
        room -= held[i]
    for i in np.flatnonzero(large):
        first[i], parts[i] = at + 1, -(-held[i] // BLOCK)
        at += parts[i]
    return first, parts


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose id is not null and whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0))


def _meeting(members: DataFrame, asking: DataFrame, rerank: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block's share of queries that meets it in one task: queries are dealt out, members go to every share. A task returns about as many candidates whatever a query has."""
    together = max(1, QUERY_BLOCK * RERANK // max(RERANK, min(rerank, BLOCK)))
    shares = asking.groupBy("block").agg(F.ceil(F.count("*") / together).cast("int").alias("shares"))
    left = members.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    right = asking.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("asker"), F.col("shares")).cast("int")).drop("shares")
    return left, right


def search(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", probed: int | None = None, rerank: int = RERANK) -> DataFrame:
    """The k nearest found of every query row among all other rows: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Nearest first, ties to the smaller vec_id; all candidates where there are fewer than k. Rows without vec_id, and
    vectors that are null, empty or zero or hold null or non-finite components, take no part; nor do vectors of another
    length than the most frequent one. Rows of one vec_id are one result at its least distance, and one query; where their vectors
    differ they are candidates of their own. Columns other than vec_id and the vector are not read. An empty table gives no rows. probed: lists to probe, measured on the sample where it is not given; rerank: candidates at least, more where the queries need them.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")), "v")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["dim"], sizes["count"]
    rows = rows.where(F.size("v") == dim)
    hashed = F.xxhash64("vec_id")
    share = min(1.0, 1.2 * SAMPLE / total)
    tried = rows.where("q").select("vec_id", "v").orderBy(hashed, "v").limit(TRIED).toPandas()
    if not len(tried):
        return spark.createDataFrame([], schema)
    sample = rows.where(F.pmod(hashed, F.lit(1 << 20)) < share * (1 << 20)).select("vec_id", "v", hashed.alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.select("vec_id", "v").limit(SAMPLE).toPandas()
    known = np.array(sample["v"].tolist(), np.float64)
    quantizer = Quantizer(known, int(min(LISTS, max(1, total**0.5))))
    lists = len(quantizer.coarse)
    asked = np.array(tried["v"].tolist(), np.float64)
    apart = np.stack([((known - query) ** 2).sum(axis=1) for query in asked])
    apart[tried["vec_id"].to_numpy()[:, None] == sample["vec_id"].to_numpy()] = np.inf
    probes = min(lists, probed or quantizer.probes(known, asked, apart, k))
    rerank = max(rerank, k, min(total, quantizer.candidates(asked, apart, k, total)))
    quantizer.coded = None
    sampled, one = np.unique(sample["vec_id"].to_numpy(np.int64), return_index=True)
    sample_list, sample_codes, sample_bias = quantizer.encode(known[one])
    sample_places = np.arange(sample_codes.shape[1]) * WORDS + sample_codes

    def limit(query_id: int, query: np.ndarray, probing: np.ndarray) -> float:
        """A coded distance that `rerank` other members of the probed lists surely keep within, as so many of the sample do."""
        seen = np.isin(sample_list, probing) & (sampled != query_id)
        if seen.sum() < rerank:
            return float("inf")
        center = ((query - quantizer.coarse) ** 2).sum(axis=1)
        near = quantizer.table(query).ravel()[sample_places[seen]].sum(axis=1) + sample_bias[seen] + center[sample_list[seen]]
        far = np.partition(near, rerank - 1)[rerank - 1]
        return float(far + 1e-9 * (abs(far) + 1))  # rounding may differ where sums are taken otherwise

    def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes, bias = quantizer.encode(_matrix(batch.column(1), dim))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.record_batch({"list": pa.array(own, pa.int32()), "vec_id": batch.column(0), "codes": packed, "bias": bias, "v": batch.column(1), "q": batch.column(2)})

    index = materialize(rows.select("vec_id", "v", F.coalesce("q", F.lit(False)).alias("q")).mapInArrow(index_batches, "list int, vec_id long, codes binary, bias double, v array<double>, q boolean"), "ann-index")
    counts = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # a row per list, LISTS at most
    held = np.array([counts.get(i, 0) for i in range(lists)])
    first, parts = blocks(held, quantizer.coarse)

    def probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = _nearest(_matrix(batch.column(1), dim), quantizer.coarse, lists).reshape(batch.num_rows, -1)
            enough = (np.cumsum(held[order], axis=1) > k).argmax(axis=1) + 1  # lists that surely hold k others
            enough[held.sum() <= k] = lists
            at, block, wanted, limits = [], [], [], []
            vectors = _matrix(batch.column(1), dim)
            for i, n in enumerate(np.maximum(probes, enough)):
                of: dict[int, list[int]] = {}
                for own in order[i, :n].tolist():
                    for b in range(first[own], first[own] + parts[own]):
                        of.setdefault(int(b), []).append(own)
                at += [i] * len(of)
                limits += [limit(batch.column(0)[i].as_py(), vectors[i], order[i, :n])] * len(of)
                block += of.keys()
                wanted += of.values()
            take = pa.array(at, pa.int64())
            yield pa.record_batch({"block": pa.array(block, pa.int64()), "query_id": batch.column(0).take(take), "query": batch.column(1).take(take), "asker": batch.column(2).take(take), "lists": pa.array(wanted, pa.list_(pa.int32())), "limit": pa.array(limits, pa.float64())})

    queries = index.where("q").select("vec_id", "v", F.xxhash64("vec_id", "v").alias("asker")).dropDuplicates(["vec_id", "asker"])
    asked = materialize(queries.mapInArrow(probe_batches, "block long, query_id long, query array<double>, asker long, lists array<int>, limit double"), "ann-queries")
    dealt = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, parts))], "list int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "codes"), F.col("parts"))
    placed = index.join(F.broadcast(dealt), "list").withColumn("block", block)  # LISTS rows at most

    def approximate(members: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if members.num_rows and asking.num_rows:
            members = members.sort_by("list")
            own, ids, bias = (members.column(c).to_numpy() for c in ("list", "vec_id", "bias"))
            codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            places = np.arange(codes.shape[1]) * WORDS + codes
            block = members.column("block")[0].as_py()
            for query_id, asker, query, wanted, within in zip(asking.column("query_id").to_pylist(), asking.column("asker").to_pylist(), _matrix(asking.column("query"), dim), asking.column("lists").to_pylist(), asking.column("limit").to_pylist()):
                spans = [(a, b, c) for a, b, c in zip(np.searchsorted(own, wanted), np.searchsorted(own, wanted, side="right"), wanted) if b > a]
                if not spans:
                    continue
                at = np.concatenate([np.arange(a, b) for a, b, _ in spans])
                to_center = np.repeat([((query - quantizer.coarse[c]) ** 2).sum() for _, _, c in spans], [b - a for a, b, _ in spans])
                near = quantizer.table(query).ravel()[places[at]].sum(axis=1) + bias[at] + to_center
                other = (ids[at] != query_id) & (near <= within)
                best = _least(near[other], ids[at][other], rerank)
                found.append((np.full(len(best[0]), asker), np.full(len(best[0]), query_id), *best, np.full(len(best[0]), block)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64)]
        return pa.table(dict(zip(("asker", "query_id", "vec_id", "near", "block"), columns)))

    left, right = _meeting(placed.select("block", "list", "vec_id", "codes", "bias"), asked, rerank)
    keys = ("block", "share")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(approximate, "asker long, query_id long, vec_id long, near double, block long")
    rank = F.row_number().over(Window.partitionBy("query_id", "asker").orderBy("near", "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= rerank)
    near = near.groupBy("block", "query_id", "asker").agg(F.collect_list("vec_id").alias("ids"))  # `rerank` of a query at most
    chosen = materialize(near.join(asked.select("block", "query_id", "asker", "query"), ["block", "query_id", "asker"]), "ann-candidates")

    def exact(members: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if members.num_rows and asking.num_rows:
            members = members.sort_by("vec_id")
            ids, original = members.column("vec_id").to_numpy(), _matrix(members.column("v"), dim)
            for query_id, query, wanted in zip(asking.column("query_id").to_pylist(), _matrix(asking.column("query"), dim), asking.column("ids").to_pylist()):
                a, b = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, side="right")
                at = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
                score = np.sqrt(((original[at] - query) ** 2).sum(axis=1))
                names, score = _least(score, ids[at], k)
                found.append((np.full(len(names), query_id), names, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    left, right = _meeting(placed.select("block", "vec_id", "v"), chosen, rerank)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(exact, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = materialize(met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
    for done in (index, asked, chosen):
        release(done)
    return found


def _least(values: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n ids of the least values and these values, ties to the smaller id, each id once."""
    if len(values) > 4 * n:
        rows = np.flatnonzero(values <= np.partition(values, n - 1)[n - 1])
        if len(np.unique(ids[rows])) >= n:
            values, ids = values[rows], ids[rows]
    order = np.lexsort((ids, values))
    once = np.sort(np.unique(ids[order], return_index=True)[1])[:n]
    return ids[order][once], values[order][once]


def op3_ann(spark, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the rows whose vec_id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
