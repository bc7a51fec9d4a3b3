"""Written tables between the rounds of a recursive plan: each cuts lineage, and a lost executor costs one round. Rows dealt out to as many tasks as their number or size asks for."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a folder in the warehouse where that is unset; a cluster whose warehouse lies on each machine's own disk has none."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not context.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_lattika_scratch"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/lattika/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT = re.compile(r"/lattika/[^/]+-[0-9a-f]{32}$")


def _folders(df: DataFrame) -> list[str]:
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def drop(*tables: DataFrame) -> None:
    """Delete the files of kept tables that nothing reads any more; files that were not kept here are left alone."""
    for df in tables:
        spark = df.sparkSession
        for folder in filter(_KEPT.search, _folders(df)):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of rounds, at most, that are read side by side; older ones are then put together.
FOLDERS = 24


class Growing:
    """A table that rounds add to: each round's rows are written once (and again with those of many others), and all rounds are read as one table."""

    def __init__(self, keep: Callable[[DataFrame, str], DataFrame], label: str):
        self.keep, self.label, self.first, self.folders = keep, label, None, []

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of `df` as the newest round; returns them as written."""
        kept = self.keep(df, self.label)
        self.first = self.first if self.first is not None else kept
        self.folders += _folders(kept)
        if len(self.folders) > FOLDERS:
            old = self.first.sparkSession.read.schema(self.first.schema).parquet(*self.folders[:-1])  # the newest is what the caller holds
            self.folders = [*_folders(self.keep(old, self.label)), self.folders[-1]]
            drop(old)
        return kept

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.first.sparkSession.read.schema(self.first.schema).parquet(*self.folders) if self.folders else self.first


#: Bytes of a table's files for which a shuffle gets a partition more; bytes of small partitions that are joined (narrow rows take some 17 times as much where they are sorted and hashed); rows of a task whose work costs much a row.
PARTITION_BYTES, JOINED_BYTES, TASK_ROWS = 1 << 20, 8 << 20, 5_000
#: Bytes of a table's files that one task reads, at most: what it sorts or hashes before a shuffle takes many times as much.
READ_BYTES = 16 << 20
#: Times that rows take what their compressed files do: Spark goes by it when it takes a table for small enough to broadcast. Bytes of a shuffle's partition from which a join deals it out, where it is also larger than most.
UNPACKED, SKEWED_BYTES = 16, 32 << 20


def partitions_for(df: DataFrame) -> None:
    """Shuffles of this session begin with a partition for each PARTITION_BYTES of a table's files, `spark.sql.shuffle.partitions` at least, so that no task grows with the input; adaptive execution joins those that turn out small. A task reads READ_BYTES of files at most. Tables are broadcast by the size of their rows, not of their files, and joins deal out keys with many rows."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED_BYTES))
    conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(SKEWED_BYTES))
    if df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > READ_BYTES:
        conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))
    now = int(conf.get(name, None) or conf.get("spark.sql.shuffle.partitions"))
    paths, total = df.sparkSession._jvm.org.apache.hadoop.fs, 0
    for f in df.inputFiles():
        path = paths.Path(f)
        total += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    if -(-total // PARTITION_BYTES) > now:
        conf.set(name, str(-(-total // PARTITION_BYTES)))


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out by a key into tasks of about so many: a file that is small in bytes is read by one task, whatever a row costs."""
    return df.repartition(max(1, -(-df.count() // rows)), key)
