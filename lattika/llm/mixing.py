"""Mixing sources to target weights by weighted fair queueing (operator 2).

The sizes of all documents together are to be shared by the sources in proportion to their weights, a source giving
each document twice at most; what a capped source leaves is shared by the rest. Every source is a queue of its
documents in a shuffled order, then the same documents again, and each is served in packets of at most PACKET words, so that a
very long document holds up no other source. The virtual finish time of a document, as of a packet, is the source's words up to
its end, divided by the source's target; in order of it all queues interleave at the target rates.

The stream of all packets in that order is cut where its running total reaches the budget, the sum of the targets. The total runs
in two levels: over narrow ranges of finish time, then row by row within the one range where the budget is reached. Every
source so ends within a packet of its target. Running sums of the queues are taken in two levels as well, over narrow hash ranges and
within them, so that a source with a third of all rows is many groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.batches import compressed, restored
from lattika.llm.common import WORD, materialize, table

# Weights by a source's place in code point order, repeating; the shared words as a fraction of all; copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), (3, 2), 2
#: Words that a queue serves at a time, at most.
PACKET = 64
#: Rows of a hash range of one source, about, in small tables; the square root of all rows in large ones, so that neither level is long.
RANGE_ROWS = 2_000
#: Ranges that a stretch of the stream is summed by at a time.
SLOTS = 4096
#: Packets, at most, that are put in order one by one to find the last one taken.
STEP = 65_536


def target_table(sizes: DataFrame) -> DataFrame:
    """source, place (from 0, null last), source_size, target; one row per source.

    Targets are l * weight for one level l, capped at COPIES times the source's size: sources in ascending order of the level at
    which they reach the cap are capped as long as the level of the rest lies above.
    """
    num, den = SHARE
    whole = Window.partitionBy(F.lit(1))  # a row per source from here on
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("place", F.lit(len(WEIGHTS))).cast("int") + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", COPIES * F.col("source_size"))
    ranked = whole.orderBy(F.col("cap") / F.col("weight"), "place")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    left = (num * F.sum("source_size").over(whole) - den * F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.lit(float(den))
    sources = sources.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    sources = sources.withColumn("rank", F.row_number().over(ranked))
    first = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))).over(whole)
    return sources.withColumn("level", first).select(
        "source", "place", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target")
    )


def queues(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Every row of `docs` in its source's queue: doc_id, source, row_key, size, place, source_size, target, ends_at, nth.

    ends_at, nth: words and rows of the source up to the end of this row, in the shuffled order (md5 of seed and doc_id; rows that share
    a doc_id, and rows without one, lie by row_key, a hash of their id, text and source).
    """
    key = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text", "source")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), key.cast("string")))))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("row_key"), words.alias("size"), order.alias("h"))
    rows = materialize(rows, "sizes")
    size = max(RANGE_ROWS, math.sqrt(rows.count()))
    of = rows.groupBy(F.col("source").alias("of")).agg(F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.count("*") / F.lit(size)))).cast("int").alias("digits"))
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.substring(F.col("h"), F.lit(1), F.col("digits"))).drop("of", "digits")
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
    before = [F.coalesce(F.sum(c).over(in_source), F.lit(0)).alias(f"{c}_before") for c in ("sum", "rows")]
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), *before)
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", "row_key")
    rows = rows.withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("number", F.row_number().over(within))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    targets = target_table(rows.select("source", "size")).withColumnRenamed("source", "t")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t")))
    up_to = [(F.col("sum_before") + F.col("run")).alias("ends_at"), (F.col("rows_before") + F.col("number")).alias("nth")]
    return rows.select("doc_id", "source", "row_key", "size", "place", "source_size", "target", *up_to)


def _finish(words: Column) -> Column:
    """Virtual time at which a source has served so many words."""
    return F.coalesce(F.try_divide(words.cast("double"), F.col("target")), F.lit(0.0))


def _packets(copy: int) -> Column:
    """The packets of a copy in order: finish, place, upto (words of the source up to its end), words."""
    start = F.lit(copy) * F.col("source_size") + F.col("ends_at") - F.col("size")
    numbers = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / PACKET))

    def packet(i: Column) -> Column:
        words = F.least(F.lit(PACKET).cast("long"), F.col("size") - (i - 1) * PACKET)
        upto = start + (i - 1) * PACKET + words
        return F.struct(_finish(upto).alias("finish"), F.col("place").cast("long").alias("place"), upto.alias("upto"), words.alias("words"))

    return F.when(F.col("size") > 0, F.transform(numbers, packet)).otherwise(F.array().cast("array<struct<finish:double,place:bigint,upto:bigint,words:bigint>>"))


def cut(queued: DataFrame) -> tuple[float, int, int, int] | None:
    """Where the stream of all packets reaches the budget: finish, place and upto of the last packet taken, and the words taken of it; None where there are no words.

    The stream is summed by ranges of finish time, the range that the budget ends in by finer ones, and where many packets finish at once these by ranges of place, until
    no more than STEP packets are left; these alone are put in order one by one.
    """
    stream = queued.select(F.inline(F.concat(*[_packets(i) for i in range(COPIES)])))
    total = stream.agg(F.sum("words")).first()[0] or 0
    num, den = SHARE
    budget, before = num * (total // COPIES) // den, 0
    if budget <= 0:
        return None
    for axis in ("finish", "place"):
        while True:
            low, high, n = stream.agg(F.min(axis), F.max(axis), F.count("*")).first()
            if n <= STEP or low == high:
                break
            at = F.least(F.floor((F.col(axis).cast("double") - float(low)) / ((float(high) - float(low)) / SLOTS)), F.lit(SLOTS - 1)).cast("int")
            sums = {r["slot"]: r["words"] for r in stream.groupBy(at.alias("slot")).agg(F.sum("words").alias("words")).collect()}  # SLOTS rows at most
            for slot in sorted(sums):
                if before + sums[slot] >= budget:
                    break
                before += sums[slot]
            stream = stream.where(at == slot)
            if len(sums) == 1:
                break  # as fine as numbers go
    run = F.sum("words").over(Window.orderBy("finish", "place", "upto").rowsBetween(Window.unboundedPreceding, 0))
    last = stream.withColumn("run", run + before).where(F.col("run") >= budget).orderBy("run").first()
    return last["finish"], last["place"], last["upto"], last["words"] - (last["run"] - budget)


def served(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The columns of `queues` for every row of `docs`, and takes: the words that the mix takes of each copy."""
    queued = materialize(queues(docs, seed), "queues")
    end = cut(queued)
    if end is None:
        return queued.withColumn("takes", F.array_repeat(F.lit(0).cast("long"), COPIES))
    last = F.struct(F.lit(end[0]).alias("finish"), F.lit(end[1]).cast("long").alias("place"), F.lit(end[2]).cast("long").alias("upto"))

    def taken(packet: Column) -> Column:
        key = F.struct(packet["finish"].alias("finish"), packet["place"].alias("place"), packet["upto"].alias("upto"))
        return F.when(key < last, packet["words"]).when(key == last, F.lit(end[3]).cast("long")).otherwise(F.lit(0).cast("long"))

    add = lambda s, x: s + taken(x)
    return queued.withColumn("takes", F.array(*[F.aggregate(_packets(i), F.lit(0).cast("long"), add) for i in range(COPIES)]))


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy: copy (from 0), taken, finish."""
    copies = rows.select("*", F.posexplode("takes").alias("copy", "taken")).drop("takes")
    return copies.withColumn("finish", _finish(F.col("copy") * F.col("source_size") + F.col("ends_at")))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The queued copies of all rows in global order of virtual finish time: the columns of `queues`, copy (from 0), finish, taken.

    Partitions are ranges of finish, sorted within. taken: the words of the copy that the mix takes: all of them,
    the first ones of a document cut at the end of the mix, or 0 after it. Null texts and texts without words have size 0
    and no words to take; a null source is a source, the last; null and repeated ids count row by row; an empty table gives no rows.
    A long text is served in packets between those of others. Columns other than doc_id, text and source are not read.
    """
    order = ("finish", "place", "nth", "copy")
    return _copies(served(docs, seed)).repartitionByRange(*order).sortWithinPartitions(*order)


def take(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as documents in its global order: the rows of `docs` with all their columns, once for each copy taken; a cut copy keeps its first words as they stand.

    Rows without words are not part of a mix. Rows that are equal in doc_id, text and source are told apart by number. A long text is
    cut only at the end of the mix; an empty table gives no rows. Texts travel as compressed frames, to what is taken of them and into the order.
    """
    taken = _copies(served(docs, seed)).where("taken > 0").select("row_key", "nth", "place", "finish", "size", "taken")
    taken = materialize(taken.groupBy("row_key", "place", "nth").agg(F.max("size").alias("size"), F.collect_list(F.struct("finish", "taken")).alias("takes")), "takes")
    own = docs.columns
    key = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text", "source")
    rows = compressed(docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("row"), key.alias("key"), "text"))
    alike = taken.groupBy("row_key").count().where("count > 1").select("row_key")
    out = rows.join(taken.join(alike, "row_key", "left_anti"), rows.key == F.col("row_key"))
    if not alike.isEmpty():
        numbered = rows.join(alike, rows.key == alike.row_key, "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("key")))
        again = taken.join(alike, "row_key", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("row_key").orderBy("nth")))
        out = out.unionByName(numbered.join(again, (F.col("key") == F.col("row_key")) & (F.col("i") == F.col("n"))).drop("i", "n"))
    out = out.select("row", "text", "place", "nth", "size", F.inline("takes"))
    out = out.repartitionByRange("finish", "place", "nth").sortWithinPartitions("finish", "place", "nth")
    out = restored(out.select("row", "text", "size", "taken"))
    text = F.when(F.col("taken") < F.col("size"), first_words(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    return out.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in own])


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, as it stands."""
    space = r"[\x20\x09-\x0D]"
    ahead = F.when(text.rlike(f"^{space}"), 1).otherwise(0)  # the empty part before white space
    parts = F.split(text, f"{space}+", (n + ahead + 1).cast("int"))
    rest = F.when(F.size(parts) > n + ahead, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - rest), f"{space}+$", "")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, with what the mix takes of each."""
    total = F.aggregate("takes", F.lit(0).cast("long"), lambda s, x: s + x)
    return served(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", total.alias("taken"))


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sources),
weighed AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 2 * source_size AS cap FROM placed),
levels AS (
  SELECT *, row_number() OVER w AS rank,
         (CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 2.0)
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), place)),
one AS (SELECT level AS l FROM levels WHERE level * weight <= cap ORDER BY rank LIMIT 1),
targets AS (SELECT source, place, source_size, least(l * weight, CAST(cap AS DOUBLE)) AS target FROM levels, one),
queued AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS ends_at, row_number() OVER () AS k FROM rows),
known AS (SELECT k, doc_id, size, source_size, target, place, ends_at FROM queued JOIN targets ON queued.source IS NOT DISTINCT FROM targets.source),
numbers AS (SELECT *, unnest(range(1, (size + 63) // 64 + 1)) AS i FROM known),
packets AS (
  SELECT k, place, target, least(64, size - 64 * (i - 1)) AS words, copy * source_size + ends_at - size + least(size, 64 * i) AS upto
  FROM numbers, (VALUES (0), (1)) c(copy)),
stream AS (SELECT k, words, sum(words) OVER (ORDER BY CAST(upto AS DOUBLE) / target, place, upto ROWS UNBOUNDED PRECEDING) AS run FROM packets),
taken AS (SELECT k, sum(greatest(0, least(words, (SELECT 3 * sum(size) // 2 FROM rows) - (run - words)))) AS taken FROM stream GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM known LEFT JOIN taken USING (k)
"""
