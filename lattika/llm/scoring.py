"""Language-model scoring by cross-entropy difference (operator 9).

Two bigram models, matched in order, vocabulary and smoothing: the target model counts the documents labelled as good, the
background model counts all documents. A document's score is its cross-entropy per token under the target model less that under the
background model (Moore and Lewis 2010); the lower, the more it resembles the target.

All words and pairs of all documents are in the models, however rare. The VOCABULARY most frequent words and the PAIRS
most frequent pairs of them travel to the tasks, with their exact counts, and are scored where the text lies; this
bounds what is broadcast and keeps frequent keys out of the shuffle, and no count is dropped by it. Every occurrence of a rarer
word or pair goes to a bucket by hash, which counts it over both corpora and returns sums by document, packed for each slice of texts.
Words are told apart by a 64-bit hash, pairs by a 64-bit hash of both words, A-Z in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.batches import binary, slices
from lattika.llm.common import materialize, release, shuffles_dropped, table
from lattika.llm.shingles import mix, word_hashes

#: Bounds of what is broadcast of the models; the weight, in words, of a model's prior.
VOCABULARY, PAIRS, PRIOR = 1 << 16, 1 << 19, 5.0
#: Steps of a count per doubling, when the least count of a bounded table is chosen.
STEPS = 8
#: Words of the texts for each bucket of rare words and pairs.
BUCKET_WORDS = 1 << 21
#: Hash of the start of a text, as the word before its first one.
START = mix(np.full(1, 1, np.uint64))[0]
#: What an entry of a bucket is: a pair with a frequent second word, one with a rare second word, a rare word before another; what a slice knew of its documents.
FREQUENT, RARE, BEFORE, OWN = range(4)
#: What an entry of a bucket counts for.
SCORED, BACKGROUND, TARGET = 1, 2, 4


def _sums(docs: DataFrame, count, schema: str) -> DataFrame:
    """Totals by key of what `count` makes of each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for keys, counts, kind in count(*word_hashes(batch.column(0))):
                yield pa.record_batch({"kind": pa.array(np.full(len(keys), kind), pa.int32()), "key": keys, "n": counts})

    return docs.select("text").mapInArrow(run, schema).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts, at most `most`: all whose count reaches the least level that keeps within it."""
    step = F.floor(F.log2("n") * STEPS).cast("int").alias("step")  # so few levels, whatever the input
    kept, least = 0, None
    for r in sorted(counts.groupBy(step).count().collect(), key=lambda r: -r["step"]):
        if (kept := kept + r["count"]) > most:
            break
        least = r["step"]
    return counts.where(F.floor(F.log2("n") * STEPS) >= least) if least is not None else counts.where("false")


class Models:
    """Both models: exact counts of the frequent words and pairs, and the corpora, in which the buckets count the others."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, unigrams: np.ndarray, contexts: np.ndarray, bigrams: np.ndarray, totals: np.ndarray, distinct: int):
        """words: sorted hashes; pairs: sorted codes; unigrams: 2 x words; contexts: 2 x words + 2 (as first words); bigrams: 2 x pairs; totals: words of both corpora; distinct: unlike words."""
        self.words, self.pairs, self.contexts, self.bigrams, self.totals, self.distinct = words, pairs, contexts, bigrams, totals, distinct
        self.unigram = self.probability(*unigrams)
        self.docs = self.target = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"docs": None, "target": None}

    def probability(self, background: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Unigram probabilities of words of these counts, 2 x words: both models are smoothed alike, towards one distribution over the shared vocabulary.

        One more word stands for those that the background lacks.
        """
        size = self.distinct + 1
        base = (background + 1) / (self.totals[0] + size)
        return np.stack([(n + PRIOR * size * base) / (total + PRIOR * size) for n, total in zip((background, target), self.totals)])

    def pair_losses(self, code: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are frequent, and the losses of those, less their contexts', 2 x frequent pairs."""
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == code if len(self.pairs) else np.zeros(len(code), bool)
        return known, -np.log(self.bigrams[:, at[known]] + PRIOR * self.unigram[:, second[known]])


def word_ids(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes among the sorted words; the unknown word is the place after the last."""
    at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
    return np.where(words[at] == hashes, at, len(words)) if len(words) else np.zeros(len(hashes), np.int64)


def pair_codes(words: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of (word before, word) for every word of all texts, and the ids of the words before and of the words."""
    second = word_ids(words, hashes)
    first = np.concatenate([[0], second[:-1]]) if len(second) else second
    starts = (np.cumsum(counts) - counts)[counts > 0]
    first[starts] = len(words) + 1
    return first * (len(words) + 2) + second, first, second


def fit(docs: DataFrame, target: DataFrame) -> Models:
    """Models of all `docs` (background) and of the `target` documents."""
    schema = "kind int, key long, n long"

    def words_of(hashes: np.ndarray, counts: np.ndarray):
        keys, n = np.unique(hashes, return_counts=True)
        yield keys.view(np.int64), n, 0

    with shuffles_dropped(docs.sparkSession):
        unigrams = materialize(_sums(docs, words_of, schema), "word-counts")
    whole = unigrams.agg(F.sum("n"), F.count("n")).first()
    top = most_frequent(unigrams, VOCABULARY).select("key", "n").toPandas()
    order = np.argsort(top["key"].to_numpy(np.int64).view(np.uint64))
    words = top["key"].to_numpy(np.int64).view(np.uint64)[order]
    sent = docs.sparkSession.sparkContext.broadcast(words)  # VOCABULARY words at most

    def pairs_of(hashes: np.ndarray, counts: np.ndarray):
        codes, first, second = pair_codes(sent.value, hashes, counts)
        rare = len(sent.value)
        for kind, x in enumerate((codes[(first != rare) & (second != rare)], second, first)):
            keys, n = np.unique(x, return_counts=True)
            yield keys, n, kind

    def by_id(counted: DataFrame, kind: int) -> np.ndarray:
        out, found = np.zeros(len(words) + 2), counted.where(F.col("kind") == kind).toPandas()
        out[found["key"].to_numpy(np.int64)] = found["n"]
        return out

    with shuffles_dropped(docs.sparkSession):
        counted = materialize(_sums(docs, pairs_of, schema), "pair-counts")
        pairs = materialize(most_frequent(counted.where("kind = 0"), PAIRS).select("key", "n"), "pairs")
        aimed = materialize(_sums(target, pairs_of, schema), "target-counts")
    both = pairs.join(aimed.where("kind = 0").select("key", F.col("n").alias("m")), "key", "left").fillna(0).toPandas().sort_values("key")
    ones = np.stack([by_id(x, 1) for x in (counted, aimed)])
    contexts = np.stack([by_id(x, 2) for x in (counted, aimed)])
    models = Models(words, both["key"].to_numpy(np.int64), ones[:, : len(words)], contexts, both[["n", "m"]].to_numpy(np.float64).T, ones.sum(axis=1), whole[1])
    models.docs, models.target = docs, target
    for counts in (unigrams, counted, pairs, aimed):
        release(counts)
    return models


def _entries(docs: DataFrame, sent, role: Column, buckets: int, scored: bool) -> DataFrame:
    """Of each slice of texts: what is known of its documents at once (where they are scored), and every occurrence of a rare word or pair, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, name = sent.value, TaskContext.get().partitionId() << 24
        for name, batch in enumerate(slices(batches), name):
            hashes, counts = word_hashes(batch.column(1))
            code, first, second = pair_codes(models.words, hashes, counts)
            before = np.concatenate([[START], hashes[:-1]]) if len(hashes) else hashes
            before[(np.cumsum(counts) - counts)[counts > 0]] = START
            owner = np.repeat(np.arange(len(counts)), counts).astype(np.uint16)
            known, losses = models.pair_losses(code, second)
            rare, late = second == len(models.words), first == len(models.words)
            pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)
            roles = batch.column(2).to_numpy()
            if scored:
                n = len(counts)
                own = [np.bincount(owner[known], weights=a, minlength=n) + np.bincount(owner[~late], weights=np.log(c[first[~late]] + PRIOR), minlength=n) for a, c in zip(losses, models.contexts)]
                has_id, ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
                yield record([name % buckets], name, OWN, [0], [n], has_id.astype(np.uint8), ids.astype(np.int64), counts.astype(np.int64), *own)
            folded = (before ^ (before >> np.uint64(32))).astype(np.uint32)  # beside the word itself it tells a pair as well as a hash of both
            for kind, of, key, x, y in ((FREQUENT, ~known & ~rare, pair, pair, second.astype(_id_type())), (RARE, rare, hashes, folded, hashes), (BEFORE, late, before, before, before[:0])):
                bucket = (mix(key[of]) % np.uint64(buckets)).astype(np.int64) * 8 + roles[owner[of]]
                order = np.argsort(bucket, kind="stable")
                names, held = np.unique(bucket, return_counts=True)
                if len(names):
                    docs_of = owner[of][order] if scored else owner[:0]
                    yield record(names // 8, name, kind, names % 8, held, docs_of, x[of][order], y[of][order] if len(y) else y)

    def record(bucket, name: int, kind: int, role, held, *columns: np.ndarray) -> pa.RecordBatch:
        none = pa.array([b""] * len(bucket), pa.binary())
        parts = [binary(c, np.asarray(held)) if len(c) else none for c in columns] + [none] * (5 - len(columns))
        fixed = [pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(len(bucket), name, np.int64)), *(pa.array(np.broadcast_to(np.asarray(v, np.int32), len(bucket))) for v in (kind, role))]
        return pa.RecordBatch.from_arrays([*fixed, *parts], ["bucket", "slice", "kind", "role", "docs", "x", "y", "background", "target"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role"))
    return text.mapInArrow(run, "bucket int, slice long, kind int, role int, docs binary, x binary, y binary, background binary, target binary")


def _id_type():
    """Numbers of frequent words."""
    return np.uint16 if VOCABULARY <= 1 << 16 else np.uint32


def _flat(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The runs of a binary column, one after the other."""
    parts = []
    for c in column.chunks:
        if len(c) and c.buffers()[2]:
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts).view(dtype) if parts else np.zeros(0, dtype)


def _count(keys: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """How often the key of each scored entry occurs in both corpora, 2 x scored entries."""
    at = np.unique(keys, return_inverse=True)[1]
    return np.stack([np.bincount(at[roles & r > 0], minlength=len(keys))[at[roles & SCORED > 0]] for r in (BACKGROUND, TARGET)])


SUMS = "slice long, own boolean, docs binary, x binary, y binary, background binary, target binary"


def _bucket_sums(group: pa.Table, models: Models) -> pa.Table:
    """For each slice of texts one row: sums by document of all its entries in the bucket. What a slice knew of its documents itself passes unchanged."""
    kinds = group.column("kind").to_numpy()
    names = [c.split()[0] for c in SUMS.split(", ")]
    own = group.filter(pa.array(kinds == OWN)).append_column("own", pa.array(np.ones(int((kinds == OWN).sum()), bool))).select(names)
    where, losses = [], []
    for kind in (FREQUENT, RARE, BEFORE):
        part = group.filter(pa.array(kinds == kind))
        x, y = _flat(part.column("x"), np.uint32 if kind == RARE else np.uint64), _flat(part.column("y"), _id_type() if kind == FREQUENT else np.uint64)
        lengths = np.array([n // x.itemsize for n in pa.compute.binary_length(part.column("x")).to_pylist()], np.int64)
        if kind == RARE:
            x = mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y)
        roles = np.repeat(part.column("role").to_numpy(), lengths)
        seen = _count(x, roles)
        scored = roles & SCORED > 0
        if kind == BEFORE:
            losses.append(np.log(seen + PRIOR))
        elif kind == RARE:
            losses.append(-np.log(seen + PRIOR * models.probability(*_count(y, roles))))
        else:
            losses.append(-np.log(seen + PRIOR * models.unigram[:, y[scored].astype(np.int64)]))
        where.append(np.repeat(part.column("slice").to_numpy(), lengths)[scored] << 16 | _flat(part.column("docs"), np.uint16).astype(np.int64))
    at, row = np.unique(np.concatenate(where), return_inverse=True)
    slices_, held = np.unique(at >> 16, return_counts=True)
    sums = [binary(np.bincount(row, weights=v, minlength=len(at)).astype(np.float64), held) for v in np.concatenate(losses, axis=1)]
    none = pa.array([b""] * len(held), pa.binary())
    rest = pa.Table.from_arrays([pa.array(slices_), pa.array(np.zeros(len(held), bool)), binary((at & 0xFFFF).astype(np.uint16), held), none, none, *sums], names)
    return pa.concat_tables([own.cast(rest.schema), rest])


def _documents(group: pa.Table) -> pa.Table:
    """The documents of one slice, from what it knew itself and the sums of all buckets."""
    is_own = group.column("own").to_numpy()
    own, rest = group.filter(pa.array(is_own)), group.filter(pa.array(~is_own))
    ids = pa.array(_flat(own.column("x"), np.int64), mask=_flat(own.column("docs"), np.uint8) == 0)
    out, at = {"doc_id": ids, "n_tokens": _flat(own.column("y"), np.int64)}, _flat(rest.column("docs"), np.uint16)
    for c in ("background", "target"):
        out[c] = _flat(own.column(c), np.float64) + np.bincount(at, weights=_flat(rest.column(c), np.float64), minlength=len(ids))
    return pa.table(out)


def score(docs: DataFrame, models: Models, good: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference), per token in nats; one row per row of `docs`.

    A text without words (or a null text) has 0 tokens and null losses. Null and repeated ids pass through; an empty table gives no rows.
    Texts of any length count whole, hashed in chunks; columns other than doc_id and text are not read.
    good: where `docs` is the background, what is true of its rows that are the target and of no other; the target is then not read again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by VOCABULARY and PAIRS
    buckets = max(1, math.ceil(models.totals.sum() / BUCKET_WORDS))
    entries = lambda of, role, scored: _entries(of, sent, role, buckets, scored)
    if good is not None:
        found = entries(docs, F.when(good, SCORED | BACKGROUND | TARGET).otherwise(SCORED | BACKGROUND), True)
    else:
        own = entries(docs, F.lit(SCORED | BACKGROUND), True) if docs is models.docs else entries(docs, F.lit(SCORED), True).union(entries(models.docs, F.lit(BACKGROUND), False))
        found = own.union(entries(models.target, F.lit(TARGET), False))
    sums = found.groupBy("bucket").applyInArrow(lambda group: _bucket_sums(group, sent.value), SUMS)
    rows = sums.groupBy("slice").applyInArrow(_documents, "doc_id long, n_tokens long, background double, target double")
    per_word = [F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).alias(f"{c}_loss") for c in ("target", "background")]
    return rows.select("doc_id", "n_tokens", *per_word).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and good: whether a label calls the document good, by a merge join at every size, as labels grow with the documents."""
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    return docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def op9_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents; the target model counts those of quality 1."""
    with shuffles_dropped(spark):
        docs = materialize(marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "marked")
    return score(docs, fit(docs, docs.where("good")), F.col("good"))
