"""Sinks. Spark's committer publishes a table only when all its tasks are done, so readers never see a part."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.functions.identity import content_hash
from lattika.operators.hashing import ordered_hash
from lattika.sources.manifests import VersionedTable
from lattika.sources.stores import file_store


def replace(df: DataFrame, path: str) -> int:
    """Replace a versioned table, which `df` may read: readers see the old version or the new one, whole; returns the new version. See `manifests.VersionedTable`."""
    return VersionedTable(df.sparkSession, path).write(df)


def create(df: DataFrame, path: str) -> None:
    """Fails where the target exists."""
    df.write.mode("errorifexists").parquet(path)


def by_feature(df: DataFrame, path: str, feature_path: str, levels: int = 3) -> None:
    """Partition folders by the first parts of a feature path; absent parts are `_`."""
    for i in range(levels):
        df = df.withColumn(f"feature_l{i + 1}", F.coalesce(F.get(F.col(feature_path), F.lit(i)), F.lit("_")))
    df.write.partitionBy(*[f"feature_l{i + 1}" for i in range(levels)]).parquet(path)


def evidence(df: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines with a hash of each, once; returns the manifest: rows and root_hash (one row)."""
    hashed = df.withColumn("contentHash", content_hash(F.to_json(F.struct(*df.columns))))
    hashed.write.mode("errorifexists").json(path)
    back = df.sparkSession.read.schema(hashed.schema).json(path)
    root = ordered_hash(back, [], ["contentHash"], F.concat("contentHash", F.lit("\n")).cast("binary"))
    return back.agg(F.count("*").alias("rows")).join(F.broadcast(root.withColumnRenamed("hash", "root_hash")), how="left")  # one row each


def _put(root: str, path: str, content: bytes) -> None:
    """One file in whatever store the root names: written beside its place, then moved there, so that a task that runs again leaves whole files alone."""
    store, top = file_store(root)
    place = f"{top.rstrip('/')}/{path}"
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(draft) as sink:
        sink.write(content)
    store.move(draft, place)


def _files(df: DataFrame, root: str, content: str, render: Callable[[object], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path, value in zip(batch["path"], batch[content]):
                data = render(value).encode()
                _put(root, path, data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    df.select("path", content).mapInPandas(run, "path string, bytes long").write.mode("overwrite").parquet(f"{root.rstrip('/')}/_written")
    return df.sparkSession.read.parquet(f"{root.rstrip('/')}/_written")


def text_files(df: DataFrame, root: str) -> DataFrame:
    """A file for each row of (path, text), below a root; returns path and bytes of each. Paths are distinct; a null text is an empty file. Files are written where their rows lie."""
    return _files(df, root, "text", lambda text: text or "")


def yaml_files(df: DataFrame, root: str) -> DataFrame:
    """A YAML file for each row of (path, documents: JSON texts), a document after the other, keys in their order; returns path and bytes of each. Paths are distinct."""

    def render(documents) -> str:
        import yaml

        return yaml.safe_dump_all([json.loads(d) for d in documents], allow_unicode=True, sort_keys=False)

    return _files(df, root, "documents", render)


def lines(df: DataFrame, path: str) -> None:
    """A report of one text per row."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(path)
