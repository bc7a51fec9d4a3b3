"""Language identification by a byte convolutional network (operator 6).

A text is cut into windows of WINDOW bytes. Filters of several widths run over the bytes of a window, the maximum of each
filter over the window is kept, and a softmax layer turns the maxima into probabilities; a text's probabilities
are those of its windows, weighted by their bytes. The network is trained here, in numpy, on a bounded sample
of labelled rows (SAMPLE_ROWS of each language at most), from whose whole texts PIECES windows each are drawn; the fitted
tables are small and travel with the task. Prediction reads whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lattika.llm.batches import slices
from lattika.llm.common import table

#: Bytes of a window; filter widths and filters of each width.
WINDOW, WIDTHS, FILTERS = 512, (2, 3, 4), 24
#: The training sample: rows of a language at most, windows drawn from each text.
SAMPLE_ROWS, PIECES = 400, 8
BATCH, RATE = 64, 0.01
#: Windows that are predicted at a time.
STEP = 512
UNKNOWN = "und"

#: Symbols: 0 pads; letters count in lower case; digits, white space and other ASCII are one symbol each; other bytes are themselves.
_SYMBOL = np.full(256, 3, np.int32)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 1
_SYMBOL[48:58] = 2
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(4, 30)
_SYMBOL[128:] = np.arange(30, 158)
SYMBOLS = 158


class ByteNetwork:
    """One-hot byte convolutions, max pooling, a rectifier and softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {f"w{k}": rng.normal(0, 0.15, (k, SYMBOLS, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.p["b"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.p["v"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)
        self.pairs: dict[int, list[np.ndarray]] = {}

    def _prepare(self) -> None:
        """Sums of two neighbouring offsets, so that a filter of width 4 takes two look-ups."""
        self.pairs = {}
        for k in WIDTHS:
            w = self.p[f"w{k}"]
            self.pairs[k] = [(w[i][:, None] + w[i + 1][None]).reshape(-1, FILTERS) for i in range(0, k - 1, 2)]

    def _responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each width: windows x positions x filters."""
        both = x[:, :-1] * SYMBOLS + x[:, 1:]
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            out = self.pairs[k][0][both[:, :n]]
            for j, t in enumerate(self.pairs[k][1:], 1):
                out += t[both[:, 2 * j : 2 * j + n]]
            if k % 2:
                out += self.p[f"w{k}"][k - 1][x[:, k - 1 : k - 1 + n]]
            yield out

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled + self.p["b"], 0)
        z = hidden @ self.p["v"] + self.p["c"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return hidden, e / e.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        """Probabilities of each window of symbols."""
        if not self.pairs:
            self._prepare()
        pooled = [np.concatenate([r.max(axis=1) for r in self._responses(x[i : i + step])], axis=1) for i in range(0, len(x), step)]
        return self._head(np.concatenate(pooled))[1] if pooled else np.zeros((0, len(self.languages)))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> None:
        """Adam, once over the texts, on a part of each of random length, so that short texts are learnt too."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        at = 0
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            x = np.zeros((len(rows), WINDOW), np.int32)
            for i, r in enumerate(rows):
                size = int(rng.choice([24, 64, 160, WINDOW]))
                first = int(rng.integers(0, max(1, len(texts[r]) - size + 1)))
                part = np.frombuffer(texts[r][first : first + size], np.uint8)
                x[i, : len(part)] = _SYMBOL[part]
            self._prepare()
            best, pooled = [], []
            for r in self._responses(x):
                best.append(r.argmax(axis=1))
                pooled.append(np.take_along_axis(r, best[-1][:, None], axis=1)[:, 0])
            hidden, prob = self._head(np.concatenate(pooled, axis=1))
            dz = prob
            dz[np.arange(len(rows)), labels[rows]] -= 1
            dz /= len(rows)
            dh = (dz @ self.p["v"].T) * (hidden > 0)
            g = {"v": hidden.T @ dz, "c": dz.sum(axis=0), "b": dh.sum(axis=0)}
            for j, k in enumerate(WIDTHS):
                g[f"w{k}"] = np.zeros_like(self.p[f"w{k}"])
                grad = dh[:, j * FILTERS : (j + 1) * FILTERS]
                for o in range(k):
                    np.add.at(g[f"w{k}"][o], (x[np.arange(len(rows))[:, None], best[j] + o], np.arange(FILTERS)[None]), grad)
            at += 1
            for k, v in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                v -= RATE * (m[k] / (1 - 0.9**at)) / (np.sqrt(s[k] / (1 - 0.999**at)) + 1e-8)
        self.pairs = {}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, part of a text) for at most SAMPLE_ROWS rows of each language, spread by hash, PIECES parts of WINDOW characters from places all over each text."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    hashed = F.xxhash64(F.lit("language"), "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "doc_id"))
    counts = known.groupBy("lang").count().collect()  # a row per language, as many as the network tells apart
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * SAMPLE_ROWS / r["count"])))])
    rows = known.select("doc_id", "lang", hashed.alias("h")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))  # about twice as many as are needed, of each language
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS)
    chosen = known.select("doc_id", "text", "lang", hashed.alias("h")).join(rows.select("doc_id", "lang", "h", "rank").hint("broadcast"), ["doc_id", "lang", "h"])  # SAMPLE_ROWS of a language at most
    chosen = chosen.dropDuplicates(["lang", "rank"]).select("lang", "text", "rank", "h", F.explode(F.sequence(F.lit(1), F.lit(PIECES))).alias("piece"))
    first = F.pmod(F.xxhash64("h", "piece"), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    parts = chosen.select("lang", "rank", "piece", F.substring(F.col("text"), first, F.lit(WINDOW)).alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(parts, key=lambda r: (r["rank"], r["piece"], r["lang"]))]


def train(docs: DataFrame) -> ByteNetwork | None:
    """A network fitted on the labelled rows of `docs` that are not held out; None if there are none."""
    sample = training_sample(docs)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    network = ByteNetwork(languages)
    network.fit([t.encode() for _, t in sample], np.array([languages.index(lang) for lang, _ in sample]))
    return network


def _windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of STEP windows of a slice at a time: their symbols, the row of each, and the bytes in each."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    for at in range(0, len(owner), STEP):
        own = owner[at : at + STEP]
        begin = start[own] + place[at : at + STEP] * WINDOW
        length = np.minimum(WINDOW, (start + size)[own] - begin)
        spot = begin[:, None] + np.arange(WINDOW)
        x = np.where(np.arange(WINDOW) < length[:, None], _SYMBOL[raw[np.minimum(spot, len(raw) - 1)]], 0)
        yield x, own, length


def identify(docs: DataFrame, network: ByteNetwork | None, predicted: str = "lang_pred", scored: str = "score") -> DataFrame:
    """`docs` with all its columns, and lang_pred and score (0 to 1), or so named: the likeliest language of each whole text.

    A text that is null or holds no letter gets `und` with score 0, as every text does where nothing was learnt.
    Columns of these names in `docs` are replaced; an empty table gives no rows.
    """
    docs = docs.drop(predicted, scored)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at)
            known = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool) & (network is not None)
            lang, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if known.any():
                total = np.zeros((len(known), len(network.languages)))
                for x, owner, length in _windows(texts):
                    np.add.at(total, owner, network.predict(x) * length[:, None])
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
                best = total.argmax(axis=1)
                lang[known] = np.array(network.languages, object)[best[known]]
                score[known] = np.minimum(1.0, total.max(axis=1)[known])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, predicted, scored])

    added = [StructField(predicted, StringType()), StructField(scored, DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def op6_language(spark, sf_dir: str) -> DataFrame:
    """All documents, by a network trained on those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")
