"""Which pages lose their publication after edits, found from what was edited.

A page depends on its own row, on the elements that are on it, and on the transitions at either end. An element is on the page that owns it, on those it is available on, and on all pages of
the elements it lies in; so an edit of one element may move others. Changes spread from the rows that differ along these dependencies; pages without a change are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.operators.graph import Keep, until_empty


@dataclass
class Site:
    """pages: page, published_at and content; elements: element, parent, page, pages (array) and content; transitions: id, source, target and content."""

    pages: DataFrame
    elements: DataFrame
    transitions: DataFrame


def _digest(df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("__digest", F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")).alias(c) for c in sorted(df.columns) if c not in without])), 256))


def changed(before: DataFrame, after: DataFrame, key: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Keys whose rows differ, were added or are gone."""
    old, new = (_digest(t, without).select(key, F.col("__digest").alias(n)) for t, n in ((before, "old"), (after, "new")))
    return old.join(new, key, "full_outer").where("NOT old <=> new").select(key)


def memberships(elements: DataFrame, of: DataFrame, keep: Keep) -> DataFrame:
    """(element, page) for the elements of `of` (element): their own page, those they are available on, and those of all elements they lie in."""
    start = of.join(elements, "element", "left_semi").select("element", F.col("element").alias("at"))
    up = elements.where("parent IS NOT NULL").select(F.col("element").alias("at"), F.col("parent").alias("next"))
    chain = until_empty(start, lambda new, old: new.join(up, "at").select("element", F.col("next").alias("at")).distinct().join(old, ["element", "at"], "left_anti"), keep, "chains")
    on = elements.select(F.col("element").alias("at"), F.explode(F.array_compact(F.concat(F.array("page"), F.coalesce("pages", F.array().cast("array<string>"))))).alias("page"))
    return chain.join(on, "at").select("element", "page").distinct()


def below(elements: DataFrame, start: DataFrame, keep: Keep) -> DataFrame:
    """The elements of `start` (element) and all that lie in them."""
    down = elements.where("parent IS NOT NULL").select(F.col("parent").alias("above"), F.col("element").alias("child"))
    step = lambda new, old: new.join(down, new.element == down.above).select(F.col("child").alias("element")).distinct().join(old, "element", "left_anti")
    return until_empty(start.select("element").distinct(), step, keep, "below")


def affected_pages(before: Site, after: Site, keep: Keep) -> DataFrame:
    """page: all whose content differs between two states of a site; publication itself is no content."""
    edited = keep(changed(before.elements, after.elements, "element"), "edited")
    moved = keep(below(before.elements, edited, keep).union(below(after.elements, edited, keep)).distinct(), "moved")
    old, new = keep(memberships(before.elements, moved, keep), "memberships"), keep(memberships(after.elements, moved, keep), "memberships")
    with_edited = old.union(new).join(edited, "element", "left_semi").select("page")
    moves = old.exceptAll(new).union(new.exceptAll(old)).select("page")
    edges = changed(before.transitions, after.transitions, "id")
    ends = before.transitions.union(after.transitions.select(before.transitions.columns)).join(edges, "id", "left_semi").select(F.explode(F.array("source", "target")).alias("page"))
    own = changed(before.pages, after.pages, "page", ("published_at",))
    return with_edited.union(moves).union(ends).union(own).where("page IS NOT NULL").distinct()


def invalidated(before: Site, after: Site, keep: Keep) -> DataFrame:
    """The pages after the edits; those published before and now whose content differs are published no more."""
    hit = affected_pages(before, after, keep).withColumn("__hit", F.lit(True))
    was = before.pages.where("published_at IS NOT NULL").select("page", F.lit(True).alias("__was"))
    rows = after.pages.join(hit, "page", "left").join(was, "page", "left")
    return rows.withColumn("published_at", F.when(~(F.coalesce("__hit", F.lit(False)) & F.coalesce("__was", F.lit(False))), F.col("published_at"))).select(after.pages.columns)
