"""Streams of session events: replay, accumulation, lifecycle and resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Failures in a row before a session gives up, seconds that an ended session is remembered, markers of inner text.
RETRIES, KEPT_SECONDS = 5, 60
OPEN, CLOSE = "<think>", "</think>"
ENDED = ("completed", "failed", "cancelled")


def replay(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Events (session, id, ...) after the last id that each reader (reader, session, last_id) has seen, with reader."""
    return last_seen.join(events, "session").where(F.col("id") > F.coalesce("last_id", F.lit(-1)))


def accumulated(events: DataFrame) -> DataFrame:
    """session, content: the texts of a session's events joined in order of id; works on a table as on each micro-batch of a stream."""
    return events.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("content"))


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (session, id, ts, ...) without repeats of an id that arrive within a delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "id"])


def visible_and_inner(events: DataFrame) -> DataFrame:
    """session, visible, inner: the text outside and inside think markers, wherever chunks were cut."""
    whole = accumulated(events)
    inner = F.regexp_extract_all("content", F.lit(f"(?s){OPEN}(.*?)(?:{CLOSE}|\\z)"), F.lit(1))
    return whole.select("session", F.regexp_replace("content", f"(?s){OPEN}.*?(?:{CLOSE}|\\z)", "").alias("visible"), F.array_join(inner, "").alias("inner"))


def lifecycle(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (target, workspace, session, event, ts) as admissions: target, workspace, session, event, accepted.

    One session at a time is active for a target and workspace: a `start` is refused while another session runs, and an
    event of a session that is not active is refused, but for repeated starts. An ended session is forgotten KEPT_SECONDS of event
    time after its last event, once the watermark (`delay` behind) has passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active, last, out = state.get[0] if state.exists else "", 0, []
        for batch in batches:
            for r in batch.sort_values("ts", kind="stable").itertuples(index=False):
                ok = (active in ("", r.session)) if r.event == "start" else active == r.session
                if ok:
                    active = "" if r.event in ENDED else r.session
                out.append((*key, r.session, r.event, ok))
                last = max(last, int(r.ts.timestamp() * 1000))
        state.update((active,))
        if not active:
            state.setTimeoutTimestamp(max(last + KEPT_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["target", "workspace", "session", "event", "accepted"])

    return events.withWatermark("ts", delay).groupBy("target", "workspace").applyInPandasWithState(
        step, "target string, workspace string, session string, event string, accepted boolean", "active string", "append", GroupStateTimeout.EventTimeTimeout
    )


def resumption(attempts: DataFrame) -> DataFrame:
    """session, n, retry, state for attempts (session, n, got_content, done): the number of failures in a row, and whether to go on.

    A failed attempt that brought content starts the count anew at 1. A session is `completed` at its first attempt that is done, `failed` at
    RETRIES + 1 failures in a row, else `running`.
    """
    along = Window.partitionBy("session").orderBy("n")
    fresh = F.sum(F.when(F.col("got_content"), 1).otherwise(0)).over(along)
    rows = attempts.withColumn("__block", fresh)
    inside = Window.partitionBy("session", "__block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("retry", F.sum(F.when(F.col("done"), 0).otherwise(1)).over(inside))
    over = F.when(F.col("done"), "completed").when(F.col("retry") > RETRIES, "failed")
    rows = rows.withColumn("__over", over)
    earlier = F.count("__over").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__earlier", earlier).where("__earlier = 0").select("session", "n", "retry", F.coalesce("__over", F.lit("running")).alias("state"))


def continuation(first: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an answer and its continuation, each composite key once: the first occurrence by (part, pos) stays."""
    both = first.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "pos"))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "part")


def continued(first: DataFrame, more: DataFrame) -> DataFrame:
    """Answers (session, frame, page, comparison, uncertainties) after their continuation: frame and page only where the answer has none, the continuation's comparison where it has one, uncertainties of both, each text once in order."""
    b = more.select("session", *[F.col(c).alias(f"__{c}") for c in ("frame", "page", "comparison", "uncertainties")])
    rows = first.join(b, "session", "full_outer")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.array_compact(F.concat(F.coalesce("uncertainties", none), F.coalesce("__uncertainties", none))))
    has = F.col("uncertainties").isNotNull() | F.col("__uncertainties").isNotNull()
    given = lambda c: F.when(F.col(c) != "", F.col(c)) if first.schema[c].dataType.simpleString() == "string" else F.col(c)
    return rows.select("session", F.coalesce(given("frame"), "__frame").alias("frame"), F.coalesce(given("page"), "__page").alias("page"), F.coalesce("__comparison", "comparison").alias("comparison"), F.when(has, both).alias("uncertainties"))


def apply_if_current(table: DataFrame, writes: DataFrame, key: str, order: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(table, refused) after writes that name the revision they change: (key, revision, payload); a write of another revision, of none, or of an unknown key is refused.

    Of several writes that name the current revision of a key, the first by `order` is applied; it makes a new revision, so the others are refused.
    """
    current = table.select(key, F.col("revision").alias("__now"))
    place = F.row_number().over(Window.partitionBy(key, "revision").orderBy(order))
    checked = writes.withColumn("__place", place).join(current, key, "left").withColumn("__ok", F.coalesce(F.col("revision") == F.col("__now"), F.lit(False)) & (F.col("__place") == 1))
    good = checked.where("__ok").select(key, (F.col("revision") + 1).alias("revision"), "payload")
    return table.join(good.select(key), key, "left_anti").unionByName(good), checked.where("NOT __ok").select(writes.columns)


def write_in_turn(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream whose micro-batches are applied one after the other: one writer, whatever the number of sources of its rows."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").start()


def listed(active: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions that run, then stored ones that do not: the columns of `stored`, and running."""
    rest = stored.join(active.select("session"), "session", "left_anti")
    return active.select(stored.columns).withColumn("running", F.lit(True)).unionByName(rest.withColumn("running", F.lit(False)))


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks after a restart: what was running or uploading has failed."""
    return tasks.withColumn("status", F.when(F.col("status").isin("running", "uploading"), "failed").otherwise(F.col("status")))
