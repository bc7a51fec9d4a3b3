"""Folders of session records as a data source of Spark: `spark.read.format("session_records").load(root)`.

A session is a folder that holds the session's own record; each is a partition that a task reads by itself, or a few hundred are where there are many. A filter on the session prunes folders
before any file is opened. Files that cannot be read become rows with an error instead of ending the job.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lattika.sources.stores import file_store

# File names of a session's own record, and the flag of sessions that were made up.
SESSION_RECORD, MADE_UP = "raw-session.json", ("executionAuthorization", "offlineFixture")

FORMAT, PUSHDOWN = "session_records", "spark.sql.python.filterPushdown.enabled"


#: Sessions up to which each is a partition, and sessions of a partition at most: a task costs more than a session's files.
APART, TOGETHER = 64, 256


@dataclass
class Folders(InputPartition):
    """The folders of some sessions: name and path of each."""

    sessions: list[tuple[str, str]]


class SessionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.names = options["path"].rstrip("/"), options.get("files", "*.json*")
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  name given by Spark
        """Takes what is asked of the session's name, so that other folders are never opened; leaves the rest to Spark."""
        for f in filters:
            on_session = getattr(f, "attribute", None) == ("session",)
            if on_session and isinstance(f, EqualTo):
                self.tests.append(lambda name, v=f.value: name == v)
            elif on_session and isinstance(f, In):
                self.tests.append(lambda name, v=frozenset(f.value): name in v)
            elif on_session and isinstance(f, StringStartsWith):
                self.tests.append(lambda name, v=f.value: name.startswith(v))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Every folder below the root, at any depth, that holds a session's record, in order of its path."""
        from pyarrow import fs

        store, top = file_store(self.root)
        found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        folders = sorted(posixpath.dirname(i.path) for i in found if i.is_file and i.base_name == SESSION_RECORD)
        kept = [(posixpath.basename(f), f) for f in folders if all(test(posixpath.basename(f)) for test in self.tests)]
        n = min(TOGETHER, -(-len(kept) // APART))
        return [Folders(kept[i : i + n]) for i in range(0, len(kept), n or 1)] or [Folders([])]  # Spark wants one partition at least

    def read(self, partition: Folders) -> Iterator[tuple]:
        """session, path, file, pos, record, error: a row for each object of JSON and JSON-lines files; a line or file that cannot be read gives its error."""
        from pyarrow import fs

        store, _ = file_store(self.root)
        for session, folder in partition.sessions:
            infos = store.get_file_info(fs.FileSelector(folder))
            yield from self._rows(store, session, sorted((i for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, self.names)), key=lambda i: i.path))

    def _rows(self, store, session: str, infos: list) -> Iterator[tuple]:
        for info in infos:
            place = (session, info.path, info.base_name)
            try:
                with store.open_input_stream(info.path) as stream:
                    text = stream.read().decode()
            except (OSError, UnicodeDecodeError) as e:
                yield (*place, -1, None, str(e).splitlines()[0])
                continue
            by_line = info.base_name.endswith(".jsonl")
            for pos, part in enumerate(text.splitlines() if by_line else [text]):
                if not part.strip():
                    continue
                try:
                    value = json.loads(part)
                    yield (*place, pos, json.dumps(value, ensure_ascii=False), None) if isinstance(value, dict) else (*place, pos, None, "root is not a map")
                except ValueError as e:
                    yield (*place, pos, None, str(e))


class SessionRecords(DataSource):
    """Options: path (the root folder), files (a pattern of file names, `*.json*`)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "session string, path string, file string, pos int, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SessionReader(dict(self.options))


def session_records(spark: SparkSession, root: str, files: str = "*.json*") -> DataFrame:
    """session, path, file, pos, record, error of all session folders below a root. Filters on the session prune folders."""
    spark.dataSource.register(SessionRecords)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(FORMAT).option("files", files).load(root)


def evidence_maps(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sessions, frames, observations, traces) of session records, each with session and record (a variant).

    Sessions that were made up are left out with all they hold. Of frames that share an id, and of observations that share a frame, the last one counts, in order of
    path and place; traces all stay. The id of each is `id` (observations: the frame's).
    """
    v = F.try_parse_json("record")
    rows = records.where("error IS NULL").withColumn("v", v)
    made_up = F.coalesce(F.try_variant_get("v", f"$.{'.'.join(MADE_UP)}", "boolean"), F.lit(False))
    sessions = rows.where((F.col("file") == SESSION_RECORD) & ~made_up).select("session", "path", F.try_variant_get("v", "$.id", "string").alias("id"), F.col("v").alias("record"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    good = sessions.select(folder.alias("__folder"))
    kept = rows.withColumn("__folder", folder).join(good, "__folder", "left_semi")

    def of(file: str, key: str, last: bool) -> DataFrame:
        part = kept.where(F.col("file") == file).select("session", "path", "pos", F.try_variant_get("v", f"$.{key}", "string").alias("id"), F.col("v").alias("record"))
        if last:
            part = part.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("path"), F.desc("pos")))).where("__n = 1").drop("__n")
        return part.drop("path", "pos")

    return sessions.drop("path"), of("raw-frames.jsonl", "id", True), of("raw-observations.jsonl", "frameRef", True), of("raw-action-traces.jsonl", "id", False)
