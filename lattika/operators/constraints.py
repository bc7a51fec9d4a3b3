"""Integrity rules as joins and aggregates. Each returns rows of (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_of(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def dangling(children: DataFrame, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows of `children` whose reference finds no parent; a null reference finds none."""
    return children.join(parents.select(F.col(key).alias("__key")).distinct(), F.col(reference) == F.col("__key"), "left_anti")


def dangling_elements(children: DataFrame, key: str, references: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key, ref) of each element of an array of references that finds no parent."""
    refs = children.select(F.col(key), F.explode(references).alias("ref"))
    return dangling(refs, "ref", parents, parent_key)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reused(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which more than one distinct value occurs, with the values in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def outside_domain(df: DataFrame, kind: str, value: str, allowed: DataFrame, allowed_kind: str, allowed_values: str) -> DataFrame:
    """Rows whose value is not in their kind's list; `*` allows every value, an unknown kind none."""
    rules = allowed.select(F.col(allowed_kind).alias("__kind"), F.col(allowed_values).alias("__allowed"))
    joined = df.join(rules, F.col(kind) == F.col("__kind"), "left")
    free = F.array_contains("__allowed", "*") | F.array_contains("__allowed", F.col(value))
    return joined.where(~F.coalesce(free, F.lit(False))).drop("__kind", "__allowed")


def unknown_members(df: DataFrame, values: str, allowed: Column) -> DataFrame:
    """Rows with members outside a list, and these members."""
    return df.withColumn("unknown", F.array_except(values, allowed)).where(F.size("unknown") > 0)


def set_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only; side says which."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def same_members(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def not_reciprocal(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges (a, b) stated from one end only."""
    return set_difference(forward.select("a", "b"), backward.select("a", "b"), "a", "b")


def several_parents(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Children with more than one parent row; equal parents count each time."""
    return edges.groupBy(child).agg(F.sort_array(F.collect_list(parent)).alias("parents")).where(F.size("parents") > 1)


def overlap(sources: list[DataFrame], key: str) -> DataFrame:
    """Keys that lie in more than one source, with the number of sources."""
    marked = [s.select(F.col(key), F.lit(i).alias("__source")).distinct() for i, s in enumerate(sources)]
    return all_of(marked).groupBy(key).agg(F.count("*").alias("sources")).where("sources > 1")


def card_match(records: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Keys that have not exactly one record and one card: key, records, cards."""
    a = records.groupBy(key).agg(F.count("*").alias("records"))
    b = cards.groupBy(key).agg(F.count("*").alias("cards"))
    return a.join(b, key, "full_outer").fillna(0, ["records", "cards"]).where("records <> 1 OR cards <> 1")
