"""Host-level quality rules (operator 8), in DataFrame operations only.

Every document is measured once. Rule failures are summed by host (the `source` column), a host's failure rate of each rule
is shrunk with a beta prior fitted to all hosts by the method of moments, and hosts whose shrunk rate passes the limit
are refused together with all their documents. A host with few documents stays near the common rate.

The measurements of a document are a handful of numbers; only they are written and joined. Sums by host combine before
the shuffle, so a host with a third of all documents costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import WORD, materialize, table

# The base rules, counted in words.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Rules counted by host: a failing document's condition on its measurements.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: A host is refused where a shrunk failure rate lies above this.
LIMIT = 0.5
#: Bounds of a prior's strength in documents.
STRENGTH = (2.0, 1000.0)


def _repeat_words(hashes: Column, by_hash: Column) -> Column:
    """Words in windows that occur twice or more; by_hash: (hash, place) of all windows, sorted."""
    twice = F.filter(by_hash, lambda w, i: (F.get(by_hash, i - 1)["h"] == w["h"]) | (F.get(by_hash, i + 1)["h"] == w["h"]))
    places = F.sort_array(F.transform(twice, lambda w: w["i"]))
    start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    step = lambda s, p: F.struct((s["words"] + F.least(F.lit(WINDOW), p - s["last"])).alias("words"), p.alias("last"))
    return F.aggregate(places, start, step, lambda s: s["words"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words. Windows are compared by 64-bit hash within one text.
    """
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: line.rlike(WORD)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - WINDOW + 1)
    hashes = F.when(F.size("words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW))))
    rows = rows.select(
        "doc_id", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("by_hash", F.when(repeated, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("hashes"), F.col("by_hash")), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def priors(hosts: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Mean and strength in documents of each rule's beta prior, by the method of moments over all hosts: one row of sums, whatever the number of hosts.

    Rates are weighted by documents, and what the spread of rates owes to the binomial noise of each host is taken off.
    """
    moments = [F.sum("documents").alias("all"), F.count("*").alias("hosts"), F.sum(F.col("documents") * F.col("documents").cast("double")).alias("squares")]
    for name in RULES:
        moments += [F.sum(name).alias(f"{name}_sum"), F.sum(F.col(name) * F.col(name).cast("double") / F.col("documents")).alias(f"{name}_squares")]
    row, found = hosts.agg(*moments).first(), {}
    for name in RULES:
        if not row["all"]:
            found[name] = (None, None)
            continue
        mean, free = row[f"{name}_sum"] / row["all"], row["hosts"] - 1
        spread = row[f"{name}_squares"] - row[f"{name}_sum"] * mean
        room, noise = mean * (1 - mean), row["all"] - row["squares"] / row["all"] - free
        excess = spread / room - free if room > 0 else 0.0
        strength = noise / excess - 1 if excess > 0 and noise > 0 else STRENGTH[1]
        found[name] = (mean, max(STRENGTH[0], min(STRENGTH[1], strength)))
    return found


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, documents, refused, and the shrunk rate of each rule; one row per host (null is a host)."""
    counts = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = materialize(measured.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("documents"), *counts), "hosts")
    fitted = priors(hosts)
    shrunk = lambda name, mean, strength: (F.col(name) + F.lit(mean).cast("double") * F.lit(strength)) / (F.col("documents") + F.lit(strength))
    hosts = hosts.withColumns({f"{name}_rate": shrunk(name, *fitted[name]) for name in RULES})
    refused = F.greatest(*[F.col(f"{name}_rate") for name in RULES]) > LIMIT
    return hosts.select("host", "documents", *[f"{name}_rate" for name in RULES], refused.alias("refused"))


def judge(docs: DataFrame) -> DataFrame:
    """The measurements of every document and kept: false if a base rule failed or the host is refused.

    Every row gives one row; null and repeated ids pass through; an empty table gives no rows. Texts of any length are measured
    whole, a null text as empty; columns other than doc_id, text and source are not read.
    """
    measured = materialize(measure(docs), "measures")
    verdicts = host_verdicts(measured).select("host", "refused")
    joined = measured.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("refused", F.lit(False)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    rates = ", ".join(
        f"""(x_{n} + m_{n} * s_{n}) / (documents + s_{n}) AS r_{n}""" for n in RULES
    )
    strengths = ", ".join(
        f"greatest({STRENGTH[0]}, least({STRENGTH[1]}, CASE WHEN p_{n} > 0 AND v_{n} / p_{n} - free > 0 AND noise > 0 THEN noise / (v_{n} / p_{n} - free) - 1 ELSE {STRENGTH[1]} END)) AS s_{n}" for n in RULES
    )
    sums = ", ".join(f"sum(x_{n}) OVER () / CAST(sum(documents) OVER () AS DOUBLE) AS m_{n}, sum(x_{n}) OVER () AS t_{n}, sum(x_{n} * CAST(x_{n} AS DOUBLE) / documents) OVER () AS q_{n}" for n in RULES)
    moments = ", ".join(f"q_{n} - t_{n} * m_{n} AS v_{n}, m_{n} * (1 - m_{n}) AS p_{n}" for n in RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE {rule}) AS x_{n}" for n, rule in RULES.items())
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
listed AS (
  SELECT k, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
spots AS (SELECT k, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM listed WHERE len(words) >= {WINDOW}),
windows AS (SELECT k, i, list_aggregate(words[i + 1 : i + {WINDOW}], 'string_agg', ' ') AS w FROM spots),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT k, sum(least({WINDOW}, i - coalesce(last, -{WINDOW}))) AS n
  FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS last FROM twice) GROUP BY k),
measured AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM listed LEFT JOIN covered USING (k)),
hosts AS (SELECT source AS host, count(*) AS documents, {counts} FROM measured GROUP BY source),
summed AS (
  SELECT *, {sums}, count(*) OVER () - 1 AS free,
         sum(documents) OVER () - sum(documents * CAST(documents AS DOUBLE)) OVER () / sum(documents) OVER () - (count(*) OVER () - 1) AS noise FROM hosts),
fitted AS (SELECT *, {moments} FROM summed),
priors AS (SELECT *, {strengths} FROM fitted),
shrunk AS (SELECT host, {rates} FROM priors),
verdicts AS (SELECT host, greatest({", ".join(f"r_{n}" for n in RULES)}) > {LIMIT} AS refused FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND NOT refused AS kept
FROM measured JOIN verdicts ON source IS NOT DISTINCT FROM host
"""


OP8_SQL = _oracle()
