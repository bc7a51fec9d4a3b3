"""What the operators share: reading tables, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lattika.operators.rounds import drop, shared_folder

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; every read goes through Spark's own reader, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one in the warehouse where that is unset; a warehouse on a machine's own disk is refused on a cluster."""
    return shared_folder(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; no two calls give the same."""
    return f"{shared_dir(spark).rstrip('/')}/lattika/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the written files behind a materialized table that nothing reads any more."""
    drop(df)


@contextmanager
def shuffles_dropped(spark):
    """Shuffle files go at the end of each query inside: what a query writes is all that is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
