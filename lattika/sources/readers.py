"""Readers of record files. Parsing that Spark lacks runs in tasks, file by file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, content of all files below a folder whose name fits, in no order; empty files are none to Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", "content")


def yaml_records(spark: SparkSession, root: str, without: tuple[str, ...] = ("manifest.yaml",), aliases: bool = True) -> DataFrame:
    """path, pos, record (JSON text), error: the documents of all YAML files; a file that cannot be read gives one row with its error. Anchors and merges are resolved, or an error where `aliases` is false."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    if not aliases and any(isinstance(t, (yaml.AnchorToken, yaml.AliasToken)) for t in yaml.scan(content)):
                        rows.append((path, -1, None, "anchor or alias"))
                        continue
                    for i, doc in enumerate(yaml.safe_load_all(content)):
                        if isinstance(doc, dict):
                            rows.append((path, i, json.dumps(doc, ensure_ascii=False, default=str), None))
                        elif doc is not None:
                            rows.append((path, i, None, "root is not a map"))
                except yaml.YAMLError as e:
                    rows.append((path, -1, None, str(e).splitlines()[0]))
            yield pd.DataFrame(rows, columns=["path", "pos", "record", "error"])

    rows = files(spark, root, "*.{yaml,yml,YAML,YML}").where(~F.element_at(F.split("path", "/"), -1).isin(list(without)))
    return rows.mapInPandas(parse, "path string, pos int, record string, error string")


def of_type(records: DataFrame, kind: str) -> DataFrame:
    """Records (record: JSON text) of an entity type, or of a record type where they have none."""
    v = F.try_parse_json("record")
    return records.where(F.coalesce(F.try_variant_get(v, "$.entityType", "string"), F.try_variant_get(v, "$.recordType", "string"), F.try_variant_get(v, "$.recordKind", "string")) == kind)


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line; blank lines are skipped and lines that are no JSON fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_json(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """path, record, error of JSON files; an object that repeats a key, a root that is no object and a broken file are errors."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def once(pairs):
            if len(pairs) != len(dict(pairs)):
                raise ValueError("repeated key")
            return dict(pairs)

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    doc = json.loads(content, object_pairs_hook=once)
                    rows.append((path, json.dumps(doc, ensure_ascii=False), None) if isinstance(doc, dict) else (path, None, "root is not a map"))
                except ValueError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "record", "error"])

    return files(spark, root, glob).mapInPandas(parse, "path string, record string, error string")


def evidence_resources(spark: SparkSession, path: str) -> DataFrame:
    """sha256, byteLength, mediaType of an index of resources (JSON lines), in order of sha256."""
    return json_lines(spark, path, "sha256 string, byteLength long, mediaType string").where("sha256 IS NOT NULL").orderBy("sha256")


def session_logs(spark: SparkSession, glob: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON-lines logs below session folders, with the session's name from the path."""
    rows = spark.read.schema(schema).json(glob)
    return rows.withColumn("session", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def front_matter(texts: DataFrame, column: str) -> DataFrame:
    """texts with `header` (the block between `---` lines at the top; null without one) and `body`."""
    pattern = r"(?s)^---\n(.*?)\n---\n"
    has = F.col(column).rlike(pattern)
    return texts.withColumn("header", F.when(has, F.regexp_extract(column, pattern, 1))).withColumn("body", F.regexp_replace(column, pattern, ""))


def wiki_links(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, target of each `[[target|label]]` or `[[target#part]]`; embedded `![[...]]` are no links."""
    found = F.regexp_extract_all(column, F.lit(r"(?<!!)\[\[([^\]|#]+)"), F.lit(1))
    return texts.select(key, F.explode(found).alias("target")).withColumn("target", F.trim("target"))


def resolve_links(links: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """links with the path of the document that each target names: below the root first, then as a path, then by file name, the least path of several."""
    name = F.element_at(F.split("path", "/"), -1)
    plain = lambda c: F.regexp_replace(c, r"\.md$", "")
    options = [(0, plain(F.regexp_replace("path", f"^{root}/", ""))), (1, plain(F.col("path"))), (2, plain(name))]
    candidates = documents.select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), c.alias("target")) for i, c in options])).alias("o")).select("path", "o.*").distinct()
    best = candidates.groupBy("target").agg(F.min(F.struct("priority", "path")).alias("b")).select("target", F.col("b.path").alias("path"))
    return links.withColumn("target", plain(F.col("target"))).join(best, "target", "left")


def html_links(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, href of every link with a quoted address."""
    return pages.select(key, F.explode(F.regexp_extract_all(column, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))


def hierarchy_rows(dumps: DataFrame, key: str, column: str) -> DataFrame:
    """key, node, parent, depth, attributes (JSON text) of XML screen dumps, in document order; a dump that cannot be parsed gives one row without a node, its error as attributes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column]):
                try:
                    stack = [(ElementTree.fromstring(text), None, 0)] if text else []
                except ElementTree.ParseError as e:
                    rows.append((k, None, None, None, json.dumps({"error": str(e)})))
                    continue
                n = 0
                while stack:
                    at, parent, depth = stack.pop()
                    rows.append((k, n, parent, depth, json.dumps(dict(at.attrib), ensure_ascii=False)))
                    stack += [(child, n, depth + 1) for child in reversed(list(at))]
                    n += 1
            out = pd.DataFrame(rows, columns=[key, "node", "parent", "depth", "attributes"])
            yield out.astype({"node": "Int64", "parent": "Int64", "depth": "Int32"})

    kind = dumps.schema[key].dataType.simpleString()
    return dumps.select(key, column).mapInPandas(parse, f"{key} {kind}, node long, parent long, depth int, attributes string")
