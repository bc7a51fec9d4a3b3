"""JSON values: paths, predicates on paths, walks, lenient parsing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from lattika.functions.lenient import checkpoint_part, read_object


def at_path(json_text: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path; null where it is missing or has another type."""
    return F.try_variant_get(F.try_parse_json(json_text), f"$.{path}", kind)


def satisfies(json_text: Column, conditions: list[tuple[str, str, str]]) -> Column:
    """All of (path, `eq` or `ne`, value) hold; a missing, null or `unknown` value and any other operation fail."""
    out = F.lit(True)
    for path, op, value in conditions:
        found = at_path(json_text, path)
        known = found.isNotNull() & (found != "unknown")
        out = out & known & ((found == value) if op == "eq" else (found != value) if op == "ne" else F.lit(False))
    return F.coalesce(out, F.lit(False))


def _walk(v, path: str = "$", parent: str | None = None) -> Iterator[tuple[str, str, str, str | None]]:
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield path, kind, v if isinstance(v, str) else "" if isinstance(v, (dict, list)) else json.dumps(v), parent
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from _walk(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]", path)


def walk(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row (key, path, kind, value, parent: the path of what holds it) for every value inside the JSON texts of a column; a text that is no JSON gives kind `invalid`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column]):
                try:
                    rows += [(k, *found) for found in _walk(json.loads(text))] if text is not None else []
                except (ValueError, RecursionError):
                    rows.append((k, "$", "invalid", text, None))
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "value", "parent"])

    texts = [StructField(n, StringType()) for n in ("path", "kind", "value", "parent")]
    return df.select(key, column).mapInPandas(run, StructType([df.schema[key], *texts]))


def forbidden(df: DataFrame, key: str, column: str, markers: list[str]) -> DataFrame:
    """Values and keys inside JSON texts that contain one of the markers: key, path, marker."""
    found = walk(df, key, column)
    hit = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.col("value"), m) | F.contains(F.col("path"), m))
    return found.select(key, "path", F.explode(hit).alias("marker"))


def repair(text: str | None) -> str | None:
    """The first JSON object in a text as JSON: read strictly, else leniently. None where there is none, or where nested too deep to write."""
    begin = text.find("{") if text is not None else -1
    if begin < 0:
        return None
    try:
        found = json.JSONDecoder(parse_constant=_refused).raw_decode(text, begin)[0]
    except (ValueError, RecursionError):
        found = read_object(text)
    try:
        return json.dumps(found, ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def _refused(word: str):
    raise ValueError(word)


@F.pandas_udf(StringType())
def parse_object(s: pd.Series) -> pd.Series:
    """The JSON object that a model's answer holds, repaired where it is malformed or cut short; null where there is none."""
    return s.map(repair)


@F.pandas_udf(StringType())
def parse_checkpoint(s: pd.Series) -> pd.Series:
    """The JSON object after the last `<data-json>` of a stream, repaired where it is cut short; null where there is none."""
    return s.map(lambda text: repair(checkpoint_part(text)))
