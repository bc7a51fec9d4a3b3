"""Latest, nearest, first and best rows per key, and evidence that qualifies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark cuts it down before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    return top_one(df, keys, F.col(time).desc_nulls_last(), *[F.col(t) for t in ties])


def keep_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key by position; rows with a null or empty key go."""
    return top_one(df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], F.col(pos))


def nearest_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, right_id: str, prefer: str | None = None) -> DataFrame:
    """left_id, right_id, gap: the row of the other side nearest in time with equal keys, ties to the greatest `prefer` where that is named (a number or time of the right rows), then to the smaller id; null where there is none.

    Only the rows right before and after in time can be nearest, so two sorts per key find them without a pairwise join.
    """
    worth = F.lit(0.0) if prefer is None else F.coalesce(-F.col(prefer).cast("double"), F.lit(float("inf")))
    ranked = right.select(*keys, F.col(right_time).cast("double").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(left.schema[left_id].dataType).alias("l"), F.struct(worth.alias("worth"), F.col(right_id).alias("id")).alias("r"))
    both = left.select(*keys, F.col(left_time).cast("double").alias("t"), F.lit(0).alias("side"), F.col(left_id).alias("l"), F.lit(None).cast(ranked.schema["r"].dataType).alias("r")).unionByName(ranked)
    # of rows at one time only the first counts, so that the neighbour found is the one that ties go to
    both = both.withColumn("first", F.min("r").over(Window.partitionBy(*keys, "t")))
    at = F.when(F.col("side") == 1, F.struct("t", F.col("first").alias("r")))
    order = Window.partitionBy(*keys).orderBy("t")
    before = F.last(at, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    behind = Window.partitionBy(*keys).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    after = F.last(at, ignorenulls=True).over(behind)  # running from the end, so that no frame is computed anew for a row
    rows = both.withColumn("before", before).withColumn("after", after).where("side = 0")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("gap"), F.col(f"{c}.r").alias("r")))
    best = F.least(option("before"), option("after"))
    return rows.withColumn("best", best).select(*keys, F.col("l").alias(left_id), F.col("best.r.id").alias(right_id), F.col("best.gap").alias("gap"))


def qualified(df: DataFrame, assertions: str, state: str = "status", good: str = "pass") -> Column:
    """All assertions of a row are good; none at all is good too."""
    return F.forall(F.coalesce(F.col(assertions), F.array().cast(df.schema[assertions].dataType)), lambda a: a[state] == good)


def qualified_traces(traces: DataFrame, frames: DataFrame, before: str, after: str, frame: str) -> DataFrame:
    """Traces both of whose frames are among the qualified ones."""
    ids = frames.select(F.col(frame).alias("__frame")).distinct()
    return traces.join(ids, F.col(before) == F.col("__frame"), "left_semi").join(ids, F.col(after) == F.col("__frame"), "left_semi")


def pattern_matches(targets: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """target and every row whose value equals or fully matches one of its patterns.

    targets: target, patterns. Each distinct pattern is matched by itself, so groups and references inside it are its own, and one that is no regular expression matches only its own text.
    Distinct values meet distinct patterns in a join that shuffles values, not rows: a value is matched once however often it occurs.
    """
    values = rows.select(F.col(value).alias("__value")).where("__value IS NOT NULL").distinct()
    one = targets.select("target", F.explode("patterns").alias("pattern")).where("pattern IS NOT NULL")
    found = whole_matches(one.select("pattern").distinct(), values, "__value")
    return one.join(found, "pattern").select("target", "__value").distinct().join(rows, F.col("__value") == F.col(value)).drop("__value")


#: Patterns that meet the values in one pass, about; these are sent to all tasks.
PATTERNS = 4_096


def whole_matches(patterns: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """pattern and each value that equals it or that it matches as a whole.

    Patterns are compiled once a task and go to the tasks in groups of about PATTERNS, so that no side of the join grows beyond a bound.
    """
    kind = f"pattern string, {value} {values.schema[value].dataType.simpleString()}"
    groups = max(1, -(-patterns.count() // PATTERNS))
    out = None
    for g in range(groups):
        given = [r[0] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g).collect()]

        def run(batches: Iterator[pd.DataFrame], given: list[str] = given) -> Iterator[pd.DataFrame]:
            tests = [(p, _whole(p)) for p in given]
            for batch in batches:
                hits = [(p, v) for p, test in tests for v in batch[value] if v == p or (test is not None and test(v))]
                yield pd.DataFrame(hits, columns=["pattern", value])

        part = values.select(value).mapInPandas(run, kind)
        out = part if out is None else out.unionByName(part)
    return out


def _whole(pattern: str) -> Callable | None:
    """A test of whole texts; None where the pattern is no regular expression."""
    try:
        return re.compile(pattern).fullmatch
    except re.error:
        return None


def status_lattice(df: DataFrame, keys: list[str], status: str, ranked: list[str]) -> DataFrame:
    """The first status of `ranked` that occurs under a key; null where none does."""
    place = F.array_position(F.array(*map(F.lit, ranked)), F.col(status))
    return df.groupBy(*keys).agg(F.get(F.array(*map(F.lit, ranked)), F.min(F.when(place > 0, place)).cast("int") - 1).alias("status"))


def running_offsets(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """expected: the bytes before each chunk of a key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("expected", F.coalesce(F.sum(length).over(before), F.lit(0)))


def appended(chunks: DataFrame, sizes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(sizes, refused): each upload's size after its chunks, and the chunks that were refused, with `expected`.

    chunks: key, n (order of arrival), offset, length; sizes: key, size. A chunk counts if it begins where the upload ends when it arrives; chunks of an upload without a size are refused, expected being null. The chunks of
    one upload are few and are taken one after the other.
    """
    arrived = F.array_sort(F.collect_list(F.struct("n", "offset", "length")))
    start = F.struct(F.col("size").alias("size"), F.array().cast("array<struct<n:bigint,offset:bigint,length:bigint,expected:bigint>>").alias("refused"))

    def one(state: Column, chunk: Column) -> Column:
        fits = F.coalesce(chunk["offset"] == state["size"], F.lit(False))
        no = F.struct(chunk["n"].cast("long").alias("n"), chunk["offset"].cast("long").alias("offset"), chunk["length"].cast("long").alias("length"), state["size"].alias("expected"))
        return F.struct(F.when(fits, state["size"] + chunk["length"]).otherwise(state["size"]).alias("size"), F.when(fits, state["refused"]).otherwise(F.concat(state["refused"], F.array(no))).alias("refused"))

    known = sizes.select(key, F.col("size").cast("long").alias("size"))
    after = chunks.groupBy(key).agg(arrived.alias("chunks")).join(known, key, "full_outer").withColumn("s", F.aggregate(F.coalesce("chunks", F.array().cast(chunks.groupBy().agg(arrived.alias("c")).schema["c"].dataType)), start, one))
    return after.where("size IS NOT NULL").select(key, F.col("s.size").alias("size")), after.select(key, F.inline("s.refused"))


def consecutive_distance(df: DataFrame, keys: list[str], order: str, vector: str, scale: float = 255.0) -> DataFrame:
    """distance: mean absolute difference to the vector before, over `scale`; null for the first one and for unequal lengths."""
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(order))
    rows = df.withColumn("__before", before)
    total = F.aggregate(F.zip_with(vector, "__before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    distance = F.when((F.size(vector) == F.size("__before")) & (F.size(vector) > 0), total / F.size(vector) / scale)
    return rows.withColumn("distance", distance).drop("__before")


def last_of(values: Column) -> Column:
    """The last member of an array; null where there is none."""
    return F.try_element_at(values, F.lit(-1))
