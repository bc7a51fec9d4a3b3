"""Inner and visible text of streamed answers, split while chunks arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lattika.streaming.sessions import CLOSE, OPEN

#: The state store that processors with timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def split(pending: str, inside: bool, text: str, last: bool = False) -> tuple[str, str, str, bool]:
    """visible, inner, pending, inside after `text` follows what was pending.

    What may be the beginning of the awaited marker stays pending: the longest end of the text that the marker begins with. `last`: nothing follows, so nothing is kept back.
    """
    found, rest = {False: [], True: []}, pending + text
    while True:
        marker = CLOSE if inside else OPEN
        before, met, after = rest.partition(marker)
        if met:
            found[inside].append(before)
            inside, rest = not inside, after
            continue
        kept = 0 if last else next((n for n in range(min(len(marker) - 1, len(rest)), 0, -1) if rest.endswith(marker[:n])), 0)
        found[inside].append(rest[: len(rest) - kept])
        return "".join(found[False]), "".join(found[True]), rest[len(rest) - kept :], inside


class _Splitter(StatefulProcessor):
    """State of a session: its pending text, whether it is inside a thought, the last chunk seen, when it is given up."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "pending string, inside boolean, last long, deadline long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  name given by Spark
        pending, inside, last, deadline = self.open.get() if self.open.exists() else ("", False, None, None)
        out, ended, latest = [], False, 0
        for chunk in pd.concat(list(rows)).sort_values("id", kind="stable").itertuples(index=False):
            if ended or (last is not None and chunk.id <= last):
                continue  # a repeat, or what follows the end
            text, ended, last = chunk.text or "", bool(chunk.final), int(chunk.id)
            visible, inner, pending, inside = split(pending, inside, text, ended)
            latest = max(latest, int(chunk.ts.timestamp() * 1000))
            out.append((*key, last, visible, inner))
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        if ended:
            self.open.clear()
        elif out or deadline is not None:
            deadline = max(latest + self.quiet_ms, deadline or 0, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(deadline)
            self.open.update((pending, inside, last, deadline))
        yield pd.DataFrame(out, columns=["session", "id", "visible", "inner"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        if self.open.exists():
            pending, inside, last, _ = self.open.get()
            visible, inner, _, _ = split(pending, inside, "", True)
            out = [(*key, last, visible, inner)] if pending else []
            self.open.clear()
        yield pd.DataFrame(out, columns=["session", "id", "visible", "inner"])

    def close(self) -> None:
        pass


def needs_timers(spark: SparkSession) -> None:
    """Fails where the session's state store has no timers (`session.SETTINGS` names one that has)."""
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")


def split_stream(chunks: DataFrame, delay: str = "1 minute", quiet_seconds: int = 600) -> DataFrame:
    """A stream of (session, id, text, ts, final) as session, id, visible, inner: what each chunk adds to the text outside and inside think markers.

    Chunks of a session arrive in order of id from batch to batch, in any order within one; repeats of an id count once. A marker may be cut anywhere: its beginning waits for the next chunk. The
    chunk marked `final` brings what still waits and ends the session; a session that stays quiet for so many seconds of event time is ended by a timer, once the watermark
    (`delay` behind) has passed, with a row under its last id if text was waiting. A null text is empty. State of a session is a part of a marker and three numbers.
    """
    needs_timers(chunks.sparkSession)
    kind = chunks.schema["session"].dataType.simpleString()
    schema = StructType.fromDDL(f"session {kind}, id long, visible string, inner string")
    rows = chunks.select("session", "id", "text", "ts", "final").withWatermark("ts", delay)
    return rows.groupBy("session").transformWithStateInPandas(_Splitter(quiet_seconds * 1000), schema, "append", "eventTime")
