"""Merges, upserts and differences of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.functions.identity import short_id


def row_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, changes: `added`, `removed`, or the names of fields that differ; equal rows are left out."""
    a = before.select(key, F.struct(*fields).alias("old"))
    b = after.select(key, F.struct(*fields).alias("new"))
    differing = F.filter(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    changes = F.when(F.col("old").isNull(), F.array(F.lit("added"))).when(F.col("new").isNull(), F.array(F.lit("removed"))).otherwise(differing)
    return a.join(b, key, "full_outer").select(key, changes.alias("changes")).where(F.size("changes") > 0)


def semantic_diff(active: DataFrame, staged: DataFrame, path: str, content: str) -> DataFrame:
    """path, change (`add` or `update`) of staged files against the active ones; unchanged ones are left out."""
    old = active.select(path, F.col(content).alias("__old"), F.lit(True).alias("__known"))
    change = F.when(F.col("__known").isNull(), "add").when(~F.col(content).eqNullSafe(F.col("__old")), "update")
    return staged.join(old, path, "left").select(path, change.alias("change")).where("change IS NOT NULL")


def last_writer_wins(writes: DataFrame, path: str, content: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(winners, conflicts) of writes to paths in an order.

    A conflict is a write whose content differs from the one applied before it: path, content, previous, and the order columns.
    """
    along = Window.partitionBy(path).orderBy(*order)
    rows = writes.withColumn("previous", F.lag(content).over(along)).withColumn("__n", F.row_number().over(along)).withColumn("__last", F.row_number().over(Window.partitionBy(path).orderBy(*[F.col(o).desc() for o in order])))
    conflicts = rows.where((F.col("__n") > 1) & ~F.col(content).eqNullSafe(F.col("previous"))).select(path, content, "previous", *order)
    return rows.where("__last = 1").drop("__n", "__last", "previous"), conflicts


def replace_partition(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`base` with all rows of the keys of `new` replaced by `new`."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(base: DataFrame, new: DataFrame, key: str, keep_old: dict[str, Column] | None = None) -> DataFrame:
    """Insert new keys and update known ones; a column of `keep_old` keeps its old value where its condition on the new one holds.

    Conditions name the new value by the column's name. Rows of `base` without a new row stay: absence deletes nothing.
    """
    keep_old = keep_old or {}
    fresh = new.select(key, *[F.col(c).alias(f"__new_{c}") for c in new.columns if c != key], F.lit(True).alias("__has"))
    blank = {c: new.select(key, cond.alias(f"__blank_{c}")) for c, cond in keep_old.items()}
    for flags in blank.values():
        fresh = fresh.join(flags, key)
    joined = base.withColumn("__had", F.lit(True)).join(fresh, key, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        old = F.col("__has").isNull() | (F.coalesce(F.col(f"__blank_{c}"), F.lit(False)) & F.col("__had").isNotNull() if c in keep_old else F.lit(False))
        return F.when(old, F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c)

    return joined.select(key, *[value(c) for c in base.columns if c != key])


def insert_absent(base: DataFrame, new: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Insert keys that are not there; of known ones only null `fill` columns take the new value."""
    filled = base.join(new.select(key, *[F.col(c).alias(f"__{c}") for c in fill]), key, "left")
    filled = filled.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fill else F.col(c) for c in base.columns])
    return filled.unionByName(new.join(base, key, "left_anti"))


def resolve(records: DataFrame, known: DataFrame) -> DataFrame:
    """records (pos, type, key, label) with the id of the known entity (id, type, key, label) of equal type: by key, else by a label that is unique in its type."""
    by_key = known.groupBy("type", "key").agg(F.min("id").alias("__by_key"))
    by_label = known.groupBy("type", "label").agg(F.count("*").alias("n"), F.min("id").alias("__by_label")).where("n = 1").drop("n")
    return records.join(by_key, ["type", "key"], "left").join(by_label, ["type", "label"], "left").withColumn("id", F.coalesce("__by_key", "__by_label")).drop("__by_key", "__by_label")


def resolve_either(refs: DataFrame, ref: str, known: DataFrame) -> DataFrame:
    """refs with the id of the known row (id, key) that a reference names, an id before a key; null where there is none."""
    ids = known.select(F.col("id").alias(ref), F.col("id").alias("__id")).distinct()
    keys = known.groupBy(F.col("key").alias(ref)).agg(F.min("id").alias("__key"))
    return refs.join(ids, ref, "left").join(keys, ref, "left").withColumn("id", F.coalesce("__id", "__key")).drop("__id", "__key")


def merge_candidates(existing: DataFrame, proposed: DataFrame, fields: list[str], page: str, new_page: str | None = None) -> DataFrame:
    """A draft after a new answer about its current page: id, key, fields, source, review, owner_kind, page, available, proposal.

    existing: id, key, pos, fields, source, review, owner_kind, page, available (array), edited; proposed: key, fields. `new_page`: the answer is about a page of its own.
    An answer's row meets the row of its key on the current page, or a shared one (owned by the application or a shared component); of several the last by pos. A shared row stays as it
    is, and one of the application is available on the page from now on; a row that a person protects (accepted, edited, or made by one) stays as it is; any other takes the
    answer's fields and keeps its id and review. Protected rows record the answer as a proposal; a shared row without protection records none. Of the other rows shared ones stay, those of other pages, and
    where the page is new all; rows of the current page without an answer go, protected or not. Unmatched rows of the answer are new.
    """
    at = F.lit(new_page or page)
    shared = F.coalesce(F.col("owner_kind").isin("application", "shared_component"), F.lit(False))
    held = existing.withColumn("__shared", shared).withColumn("__protected", F.coalesce((F.col("review") == "accepted") | F.col("edited") | (F.col("source") == "human"), F.lit(False)))
    here = F.col("__shared") | F.coalesce(F.col("page") == page, F.lit(False))
    place = F.row_number().over(Window.partitionBy("key", here).orderBy(F.desc("pos"), F.desc("id")))
    held = held.withColumn("__meets", here & (place == 1))
    new = proposed.select(F.col("key").alias("__key"), F.struct(*fields).alias("__new"))
    joined = held.join(new, F.col("__meets") & (F.col("key") == F.col("__key")), "full_outer")
    fresh, met = F.col("id").isNull(), F.col("id").isNotNull() & F.col("__new").isNotNull()
    stays = F.col("__new").isNotNull() | F.col("__shared") | F.lit(new_page is not None) | ~F.coalesce(F.col("page") == page, F.lit(False))
    take = fresh | (met & ~F.col("__shared") & ~F.col("__protected"))
    none = F.array().cast(existing.schema["available"].dataType)
    listed = F.coalesce("available", none)
    return joined.where(stays).select(
        F.coalesce("id", short_id(F.concat_ws("\n", at, F.col("__key")))).alias("id"),
        F.coalesce("key", "__key").alias("key"),
        *[F.when(take, F.col(f"__new.{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(take, "ai").otherwise(F.col("source")).alias("source"),
        F.when(fresh, "pending").otherwise(F.col("review")).alias("review"),
        F.when(fresh, "page").otherwise(F.col("owner_kind")).alias("owner_kind"),
        F.when(take, at).otherwise(F.col("page")).alias("page"),
        F.when(met & (F.col("owner_kind") == "application"), F.array_distinct(F.concat(listed, F.array(at)))).otherwise(listed).alias("available"),
        F.when(met & F.col("__protected"), F.col("__new")).alias("proposal"),
    )


def merge_fields(choices: DataFrame, a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """One row per choice (pos, a_key, b_key, sources): each field from the side that `sources` names (`a` or `b`), the other where that is null.

    The new key is that of side a, else of b; equal keys get the suffixes -2, -3 and so on in order of pos.
    """
    left = a.select(F.col("key").alias("a_key"), F.struct(*fields).alias("__a"))
    right = b.select(F.col("key").alias("b_key"), F.struct(*fields).alias("__b"))
    joined = choices.join(left, "a_key", "left").join(right, "b_key", "left")
    pick = [F.when(F.col("sources")[f] == "b", F.coalesce(f"__b.{f}", f"__a.{f}")).otherwise(F.coalesce(f"__a.{f}", f"__b.{f}")).alias(f) for f in fields]
    joined = joined.withColumn("__key", F.coalesce(F.when(F.col("__a").isNotNull(), F.col("a_key")), F.col("b_key")))
    n = F.row_number().over(Window.partitionBy("__key").orderBy("pos"))
    key = F.when(n == 1, F.col("__key")).otherwise(F.concat("__key", F.lit("-"), n.cast("string")))
    return joined.select("pos", key.alias("key"), "a_key", "b_key", *pick)


def remap(edges: DataFrame, names: DataFrame, source: str, target: str) -> DataFrame:
    """Edges whose two ends are renamed by (old, new); edges with an end that has no new name go."""
    for end in (source, target):
        edges = edges.join(names.select(F.col("old").alias(end), F.col("new").alias("__new")), end).withColumn(end, F.col("__new")).drop("__new")
    return edges


def repeated_items(elements: DataFrame) -> DataFrame:
    """The rows that repeat in a list: list_key, index, members, box, confidence, for elements (key, x, y, width, height, confidence).

    A key such as `row.2.title` belongs to item 2 of list `row`. An item has two members or more, a list two such items or more.
    """
    from lattika.functions.geometry import union_box
    from lattika.functions.text import repeat_parts

    rows = elements.withColumn("parts", repeat_parts(F.col("key"))).where("parts IS NOT NULL")
    box = union_box(*[F.col(c) for c in ("x", "y", "width", "height")])
    items = rows.groupBy(F.col("parts.prefix").alias("list_key"), F.col("parts.index").alias("index")).agg(F.array_sort(F.collect_set("key")).alias("members"), box.alias("box"), F.min("confidence").alias("confidence"), F.count("*").alias("n")).where("n >= 2")
    return items.withColumn("__items", F.count("*").over(Window.partitionBy("list_key"))).where("__items >= 2").drop("__items", "n")


def remove_pages(pages: DataFrame, elements: DataFrame, transitions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays when pages go: their elements go, other elements lose them from `available` (the order stays), and so do transitions that touch either."""
    ids = gone.select("page").distinct()
    kept = pages.join(ids, "page", "left_anti")
    left = elements.join(ids, "page", "left_anti")
    listed = left.select("element", F.posexplode("available").alias("pos", "page")).join(ids, "page", "left_anti").groupBy("element").agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("__available"))
    still = F.transform("__available", lambda x: x["page"])
    left = left.join(listed, "element", "left").withColumn("available", F.when(F.col("available").isNotNull(), F.coalesce(still, F.array().cast(elements.schema["available"].dataType)))).drop("__available")
    lost = elements.join(ids, "page", "left_semi").select(F.col("element").alias("trigger"))
    for end in ("source", "target"):
        transitions = transitions.join(ids.select(F.col("page").alias(end)), end, "left_anti")
    return kept, left, transitions.join(lost, "trigger", "left_anti")


def page_signatures(pages: DataFrame, elements: DataFrame, transitions: DataFrame) -> DataFrame:
    """page, signature: a hash of a page, its elements and the transitions at either end."""
    listed = lambda df, c: df.groupBy(F.col(c).alias("page")).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(df.columns))))).alias("rows"))
    own = listed(elements, "page").withColumnRenamed("rows", "e")
    ends = transitions.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("__page"))
    near = listed(ends, "__page").withColumnRenamed("rows", "t")
    joined = pages.join(own, "page", "left").join(near, "page", "left")
    return joined.select("page", F.sha2(F.to_json(F.struct(F.struct(*sorted(pages.columns)).alias("p"), "e", "t")), 256).alias("signature"))


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the parents of `gone` (key) and without the children that refer to them; both are to be published as one version."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, reference), reference, "left_anti")


#: Prefixes of references that are derived from owners.
DERIVED = ("owner:", "parent:", "child:")


def rebuilt_references(elements: DataFrame) -> DataFrame:
    """elements (id, key, owner (kind, ref), parent, children, references) with children and references derived from the owners.

    Children are those that name the element as their component: known ones in their order, new ones after them by key. References: the owner, then what is not derived in its order, then the
    parent and the children, each once. An element without children has none (null).
    """
    owned = elements.where("owner.kind IN ('component', 'shared_component')").select(F.col("owner.ref").alias("id"), F.struct("key", F.col("id").alias("child")).alias("c")).groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("__owned"))
    rows = elements.join(owned, "id", "left")
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.transform("__owned", lambda c: c["child"]))
    known = F.array_intersect(F.coalesce("children", none), F.coalesce(ids, none))
    children = F.concat(known, F.array_except(F.coalesce(ids, none), known))
    kept = F.filter(F.coalesce("references", none), lambda r: ~(r.startswith(DERIVED[0]) | r.startswith(DERIVED[1]) | r.startswith(DERIVED[2])))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    owner = F.when(given(F.col("owner.ref")), F.array(F.concat(F.lit(DERIVED[0]), "owner.ref"))).otherwise(none)
    parent = F.when(given(F.col("parent")), F.array(F.concat(F.lit(DERIVED[1]), "parent"))).otherwise(none)
    made = F.array_distinct(F.concat(owner, kept, parent, F.transform(children, lambda c: F.concat(F.lit(DERIVED[2]), c))))
    return rows.withColumn("references", made).withColumn("children", F.when(F.size(children) > 0, children)).drop("__owned")
