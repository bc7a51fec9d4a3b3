"""Keys, versions and lists as column expressions; text forms that Spark lacks as vectorised functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Capabilities that name no action are this one.
NO_ACTION = "none"


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


@F.pandas_udf(StringType())
def compatibility_form(s: pd.Series) -> pd.Series:
    """Unicode NFKD."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def page_key(name: Column) -> Column:
    """`page.` and a slug of a name: letters and digits in lower case, other runs as one hyphen; a hash where nothing is left."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(compatibility_form(name), r"[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(F.lit("page."), F.when(slug != "", slug).otherwise(F.substring(F.sha2(name, 256), 1, 12)))


def safe_segment(value: Column, default: str = "unknown") -> Column:
    """A path segment of letters, digits, dot, underscore and hyphen."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def next_version(version: Column) -> Column:
    """name@a.b.c with c raised by one; name@1.0.0 where the version has another form."""
    parts = r"^(.*@\d+\.\d+\.)(\d+)$"
    raised = F.concat(F.regexp_extract(version, parts, 1), (F.regexp_extract(version, parts, 2).try_cast("bigint") + 1).cast("string"))
    return F.when(version.rlike(parts), raised).otherwise(F.concat(F.substring_index(version, "@", 1), F.lit("@1.0.0")))


def last_part(value: Column, separator: str) -> Column:
    return F.element_at(F.split(value, separator), -1)


def alias_of(value: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """A member of `known`, after replacing aliases; empty where it is none."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    low = F.lower(F.trim(value))
    found = F.coalesce(F.create_map(*pairs)[low], low) if pairs else low
    return F.when(found.isin(known), found).otherwise(F.lit(""))


def capabilities(values: Column, known: list[str]) -> Column:
    """Known capabilities, trimmed, each once in order; `none` only on its own, and where nothing is left."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array()), lambda v: F.trim(v)), lambda v: v.isin([*known, NO_ACTION])))
    acting = F.filter(clean, lambda v: v != NO_ACTION)
    return F.when(F.size(acting) > 0, acting).otherwise(F.array(F.lit(NO_ACTION)))


# What an action on an element does where nothing else is known; every other action is a tap.
EFFECTS = {
    "none": "{} 仅展示或承载内容，不触发交互",
    "input": "向 {} 输入文本或数值",
    "scroll_vertical": "纵向滚动 {} 中的内容",
    "scroll_horizontal": "横向滚动 {} 中的内容",
    "swipe": "滑动 {} 以切换内容或状态",
    "drag": "拖拽 {} 或其中的目标对象",
    "zoom": "缩放 {} 中的内容",
    "multi_touch": "在 {} 上执行多点触控",
    "double_tap": "双击 {} 触发对应交互",
    "long_press": "长按 {} 打开扩展操作或状态",
}
OTHER_EFFECT = "点击 {} 触发对应操作"


def action_effects(caps: Column, existing: Column, element_type: Column) -> Column:
    """action and effect for each capability, in their order: the first effect of that action in `existing` (action, effect) if it is not empty, else what its kind does to the element type."""
    templates = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])

    def one(action: Column) -> Column:
        told = F.get(F.filter(existing, lambda e: (e["action"] == action) & e["effect"].isNotNull()), F.lit(0))["effect"]
        usual = F.replace(F.coalesce(F.try_element_at(templates, action), F.lit(OTHER_EFFECT)), F.lit("{}"), F.coalesce(element_type, F.lit("")))
        return F.struct(action.alias("action"), F.coalesce(F.nullif(told, F.lit("")), usual).alias("effect"))

    return F.transform(caps, one)


def distinct_present(values: Column) -> Column:
    """Each value once, in order, without nulls and empty texts."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def repeat_parts(key: Column) -> Column:
    """prefix, index and suffix of a key such as `row.2.title`; null for other keys."""
    pattern = r"^(.+?)[._-](\d+)[._-](.+)$"  # fixed value
    return F.when(
        key.rlike(pattern),
        F.struct(F.regexp_extract(key, pattern, 1).alias("prefix"), F.regexp_extract(key, pattern, 2).cast("int").alias("index"), F.regexp_extract(key, pattern, 3).alias("suffix")),
    )


def matches(value: Column, pattern: Column) -> Column:
    """A whole value that equals a pattern or matches it as a regular expression."""
    return (value == pattern) | F.regexp_like(value, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


@lru_cache(maxsize=10_000)
def _expression(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None


@F.pandas_udf(BooleanType())
def pattern_found(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """A pattern occurs in a text, letter case aside; a pattern that is no regular expression is looked for as it stands. Null where either is."""

    def one(p: str | None, t: str | None) -> bool | None:
        if p is None or t is None:
            return None
        expression = _expression(p)
        return expression.search(t) is not None if expression else p.lower() in t.lower()

    return pd.Series([one(p, t) for p, t in zip(pattern, text)], dtype=object)


def localized(value: Column, collation: str = "UNICODE") -> Column:
    """A text that sorts and compares by a collation (`UNICODE`, `zh`, ...) instead of by code points."""
    return F.collate(value, collation)


def shortened(text: Column, most: int) -> Column:
    """The first `most` characters."""
    return F.substring(text, 1, most)


def duration_ms(begin: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, never negative; null where one is."""
    ms = F.unix_millis(end) - F.unix_millis(begin)
    return F.when(ms.isNotNull(), F.greatest(F.lit(0).cast("long"), ms))


def contains_any_case(query: str, *parts: Column) -> Column:
    """A query occurs in the parts joined by spaces, letter case aside; an empty query in all."""
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(F.lit(query)))


def interaction_boundary(boundary: Column, caps: Column) -> Column:
    """`none` without an acting capability; else the boundary, `candidate_bbox` where it is none."""
    acting = F.exists(caps, lambda c: c != NO_ACTION)
    return F.when(~F.coalesce(acting, F.lit(False)), F.lit(NO_ACTION)).otherwise(F.when(present(boundary) & (boundary != NO_ACTION), boundary).otherwise("candidate_bbox"))


def utc_time(value: Column) -> Column:
    """A timestamp from RFC 3339 text in UTC; null for other texts."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.try_to_timestamp(value))


def stable_differs(a: Column, b: Column, as_sets: bool = False) -> Column:
    """Values differ, null and empty texts being one; lists and objects by their JSON text, lists as sets where `as_sets`."""

    def plain(c: Column) -> Column:
        c = F.array_sort(F.array_distinct(c)) if as_sets else c
        return F.when(c.isNull(), "").otherwise(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{("v":"?)?|"?\}$', ""))

    return plain(a) != plain(b)
