"""Checks of a draft: elements on pages, each issue one row (level, code, element)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.functions.geometry import grid_for_box
from lattika.functions.identity import id_time
from lattika.functions.nested import walk
from lattika.functions.text import alias_of, capabilities, interaction_boundary
from lattika.operators.constraints import all_of, violations
from lattika.operators.graph import Keep, availability, leads_to_cycle, terminal_owner

CONTAINERS = ["component", "shared_component"]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def valid_box(box: str = "bbox") -> Column:
    """Finite numbers, a positive size, inside the unit square."""
    x, y, w, h = (F.col(f"{box}.{c}") for c in ("x", "y", "width", "height"))
    finite = ~F.isnan(x + y + w + h) & (F.abs(x + y + w + h) < float("inf"))
    return F.coalesce(finite & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))


def element_issues(elements: DataFrame, types: list[str]) -> DataFrame:
    """Issues that an element shows by itself or with its parent."""
    known = elements.select(F.col("id").alias("__parent")).distinct()
    rows = elements.join(known.hint("merge"), F.col("parentId") == F.col("__parent"), "left")
    grid = grid_for_box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.width"), F.col("bbox.height"), F.col("gridColumns"), F.col("gridRows"))
    rows = rows.withColumn("__box", valid_box()).withColumn("__grid", F.when(F.col("__box"), grid))
    fits = (F.col("gridColumns").between(1, 12)) & (F.col("gridRows").between(1, 12)) & (F.col("gridColumns") == F.col("__grid.columns")) & (F.col("gridRows") == F.col("__grid.rows")) & (F.col("gridRegion") == F.col("__grid.region"))
    parent = F.col("parentId").isNotNull() & (F.col("parentId") != "")
    inside = F.coalesce(F.col("ownerKind").isin(CONTAINERS), F.lit(False))
    risk = lambda name: F.coalesce(F.array_contains("riskSignals", name), F.lit(False))
    checks = [
        ("error", "label_required", _blank("label") & ~F.col("reviewStatus").eqNullSafe(F.lit("rejected"))),
        ("error", "candidate_key_required", _blank("candidateKey")),
        ("error", "element_type_required", ~F.coalesce(F.col("elementType").isin(types), F.lit(False))),
        ("error", "bbox_invalid", ~F.col("__box")),
        ("error", "grid_region_invalid", ~F.coalesce(fits, F.lit(False))),
        ("error", "parent_missing", parent & F.col("__parent").isNull()),
        ("error", "parent_self", F.coalesce(F.col("parentId") == F.col("id"), F.lit(False))),
        ("error", "nested_owner_kind", parent & ~inside),
        ("error", "root_owner_kind", ~parent & inside),
        ("warning", "capability_missing", F.coalesce(F.size("capabilities") <= 0, F.lit(True))),
        ("warning", "review_pending", F.coalesce(F.col("reviewStatus") == "pending", F.lit(False))),
        ("warning", "model_bbox_clamped", risk("geometry-clamped-to-frame")),
        ("warning", "model_action_inconsistent", risk("model-action-inconsistent")),
    ]
    hits = F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, test in checks])
    return rows.select(F.col("id").alias("element"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.level", "h.code", "element")


def duplicate_keys(elements: DataFrame, keep: Keep) -> DataFrame:
    """level, code, element for elements that share a candidate key with another: on a common page (`..._current_page`), or with one on none of their pages (`..._other_page`).

    Elements of one key on the same pages are one class, and classes are compared, so a key that many elements have costs no pairs of elements.
    """
    rows = elements.select(F.col("id").alias("element"), F.col("parentId").alias("parent"), F.col("ownerKind").alias("owner_kind"), F.col("pageId").alias("page"), F.coalesce("availableOnPageIds", F.array().cast("array<string>")).alias("pages"))
    pages = availability(rows, keep, "draft").groupBy("element").agg(F.array_sort(F.collect_set("page")).alias("on"))
    named = elements.where(~_blank("candidateKey")).select(F.trim("candidateKey").alias("key"), F.col("id").alias("element")).join(pages.hint("merge"), "element", "left")
    named = named.withColumn("on", F.coalesce("on", F.array().cast("array<string>")))
    classes = named.groupBy("key", "on").agg(F.count("*").alias("n"))
    other = classes.select("key", F.col("on").alias("other_on"), F.col("n").alias("m"))
    met = classes.join(other.hint("merge"), "key").where("on <> other_on OR n > 1").withColumn("common", F.arrays_overlap("on", "other_on"))
    code = F.when(F.col("common"), "candidate_key_duplicate_current_page").otherwise("candidate_key_duplicate_other_page")
    found = met.select("key", "on", code.alias("code")).distinct()
    return named.join(found.hint("merge"), ["key", "on"]).select(F.lit("error").alias("level"), "code", "element")


def draft_issues(elements: DataFrame, types: list[str], keep: Keep) -> DataFrame:
    """All issues of a draft: level, code, element."""
    loops = leads_to_cycle(elements.select(F.col("id").alias("node"), F.nullif("parentId", F.lit("")).alias("parent")), keep)
    return element_issues(elements, types).union(duplicate_keys(elements, keep).select("level", "code", "element")).union(loops.select(F.lit("error"), F.lit("owner_cycle"), "node"))


def grouped_issues(issues: DataFrame) -> DataFrame:
    """level, code, n, elements: errors first, then by number, then by code."""
    grouped = issues.groupBy("level", "code").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("element")).alias("elements"))
    return grouped.orderBy(F.col("level") != "error", F.desc("n"), "code")


def page_status(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """page, status: `published`, `pending-recognition` (no elements), `pending-review`, or `ready`."""
    counts = elements.groupBy(F.col("pageId").alias("page")).agg(F.count("*").alias("n"), F.count_if(F.col("reviewStatus") == "pending").alias("open"))
    joined = pages.join(counts, "page", "left")
    status = F.when(F.col("publishedAt").isNotNull(), "published").when(F.coalesce("n", F.lit(0)) == 0, "pending-recognition").when(F.col("open") > 0, "pending-review").otherwise("ready")
    return joined.select("page", status.alias("status"))


def review_counts(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """page, reviewed (accepted or edited), pending, ignored (rejected): how the elements (pageId, reviewStatus) of each page stand, zeros included."""
    of = lambda *states: F.count_if(F.coalesce(F.col("reviewStatus").isin(*states), F.lit(False)))
    counts = elements.groupBy(F.col("pageId").alias("page")).agg(of("accepted", "edited").alias("reviewed"), of("pending").alias("pending"), of("rejected").alias("ignored"))
    return pages.select("page").join(counts, "page", "left").fillna(0)


def transition_issues(transitions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """transition, issue: one row for every rule that a transition breaks."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda v: v.isNotNull())
    return transitions.select(F.col("id").alias("transition"), F.explode(found).alias("issue"))


def draft_transition_issues(transitions: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """transition, issue: what a drafted transition lacks before it can count, a row for each of eleven rules.

    transitions: id, source, target, trigger, capability, before_frame, locator_frame, action_trace, after_frame, postcondition, assertions; pages: page; elements: id, capabilities.
    """
    known = pages.select("page").distinct()
    rows = transitions
    for end in ("source", "target"):
        rows = rows.join(known.select(F.col("page").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    asked = transitions.select("trigger").where("trigger IS NOT NULL").distinct()
    triggers = elements.select(F.col("id").alias("trigger"), F.col("capabilities").alias("__capabilities"), F.lit(True).alias("__trigger")).join(asked.hint("merge"), "trigger", "left_semi")  # those that are named alone
    rows = rows.join(triggers, "trigger", "left")
    has = lambda c: ~_blank(c)
    rules = {
        "source_missing": F.col("__source"),
        "target_missing": F.col("__target"),
        "trigger_missing": F.col("__trigger"),
        "capability_not_owned": F.col("__trigger").isNull() | F.array_contains("__capabilities", F.col("capability")),
        "before_frame_missing": has("before_frame"),
        "locator_frame_missing": has("locator_frame"),
        "locator_frame_differs": _blank("locator_frame") | F.col("before_frame").eqNullSafe(F.col("locator_frame")),
        "action_trace_missing": has("action_trace"),
        "after_frame_missing": has("after_frame"),
        "postcondition_open": F.col("postcondition") == "pass",
        "assertions_missing": F.exists(F.coalesce("assertions", F.array().cast("array<string>")), lambda a: F.coalesce(F.trim(a) != "", F.lit(False))),
    }
    return transition_issues(rows, rules)


def client_issues(elements: DataFrame, transitions: DataFrame, pages: DataFrame, keep: Keep) -> DataFrame:
    """level, code, element of an editor's own check: softer on types than `draft_issues`, and with rules on actions; element is null for transitions. elements: those of `element_issues` with actionEffects."""
    own = element_issues(elements, []).where("code NOT IN ('element_type_required', 'parent_self', 'nested_owner_kind', 'root_owner_kind')")
    caps, effects = F.coalesce(F.size("capabilities"), F.lit(0)), F.coalesce(F.size("actionEffects"), F.lit(0))
    checks = [
        ("error", "element_type_required", _blank("elementType") & ~F.col("reviewStatus").eqNullSafe(F.lit("rejected"))),
        ("error", "capability_none_conflict", F.coalesce(F.array_contains("capabilities", "none"), F.lit(False)) & (caps > 1)),
        ("warning", "action_effect_missing", effects != caps),
    ]
    hits = F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, test in checks])
    more = elements.select(F.col("id").alias("element"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.level", "h.code", "element")
    loops = leads_to_cycle(elements.select(F.col("id").alias("node"), F.nullif("parentId", F.lit("")).alias("parent")), keep)
    open_ = draft_transition_issues(transitions, pages, elements).select(F.lit("error"), F.lit("transition_evidence_incomplete"), F.lit(None).cast(elements.schema["id"].dataType))
    return own.union(more).union(duplicate_keys(elements, keep).select("level", "code", "element")).union(loops.select(F.lit("error"), F.lit("owner_cycle"), "node")).union(open_)


def grouped_duplicates(elements: DataFrame, keep: Keep) -> DataFrame:
    """code, key, pages, elements: the duplicate-key issues of a draft by key and the pages of their elements."""
    rows = elements.select(F.col("id").alias("element"), F.col("parentId").alias("parent"), F.col("ownerKind").alias("owner_kind"), F.col("pageId").alias("page"), F.coalesce("availableOnPageIds", F.array().cast("array<string>")).alias("pages"))
    on = availability(rows, keep, "draft").groupBy("element").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    keyed = duplicate_keys(elements, keep).join(elements.select(F.col("id").alias("element"), F.trim("candidateKey").alias("key")), "element").join(on, "element", "left")
    return keyed.groupBy("code", "key", F.coalesce("pages", F.array().cast("array<string>")).alias("pages")).agg(F.array_sort(F.collect_set("element")).alias("elements"))


def begin_capture(pages: DataFrame, elements: DataFrame, frame: str, current: str, new_id: str, new_page: bool = False) -> DataFrame:
    """pages (page, key, name, frames, published_at) after a frame was captured: the current page takes it if it has no elements yet, else a new page does (always where new_page is set)."""
    taken = elements.where(F.col("page") == current).limit(1).select(F.lit(True).alias("__taken"))
    now = pages.join(F.broadcast(taken), F.lit(True), "left")  # one row at most
    fits = (F.col("page") == current) & F.col("__taken").isNull() & F.lit(not new_page)
    now = now.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    kept = now.select("page", "key", "name", F.when(F.col("__fits"), F.array(F.lit(frame))).otherwise(F.col("frames")).alias("frames"), F.when(~F.col("__fits"), F.col("published_at")).alias("published_at"))
    used = now.agg(F.coalesce(F.bool_or("__fits"), F.lit(False)).alias("used")).where("NOT used")
    none = F.lit(None).cast(pages.schema["published_at"].dataType)
    return kept.unionByName(used.select(F.lit(new_id).alias("page"), F.concat(F.lit("page.capture."), F.substring(F.sha2(F.lit(new_id), 256), 1, 8)).alias("key"), F.lit("").alias("name"), F.array(F.lit(frame)).alias("frames"), none.alias("published_at")))


def shaped_elements(elements: DataFrame, edited: DataFrame, current: str, types: list[str], aliases: dict[str, str], known: list[str]) -> DataFrame:
    """elements (id, elementType, capabilities, interactionBoundary, bbox, gridColumns, gridRows, ownerKind, pageId, availableOnPageIds, source, reviewStatus, ...) with defaults filled in.

    Types and capabilities are normalised and grids computed anew; an edit that no record (edited: id) backs is an open answer of the model again.
    """
    grid = grid_for_box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.width"), F.col("bbox.height"), F.coalesce("gridColumns", F.lit(12)), F.coalesce("gridRows", F.lit(12)))
    backed = edited.select("id", F.lit(True).alias("__edited")).distinct()
    rows = elements.join(backed, "id", "left").withColumn("__grid", grid).withColumn("capabilities", capabilities(F.col("capabilities"), known))
    shared, application = F.coalesce(F.col("ownerKind").isin("application", "shared_component"), F.lit(False)), F.col("ownerKind").eqNullSafe(F.lit("application"))
    lapsed = ~(F.col("source").eqNullSafe(F.lit("human")) | F.col("__edited").isNotNull())
    none = F.array().cast("array<string>")
    shape = {
        "elementType": alias_of(F.col("elementType"), aliases, types),
        "interactionBoundary": interaction_boundary(F.col("interactionBoundary"), F.col("capabilities")),
        "gridColumns": F.col("__grid.columns"), "gridRows": F.col("__grid.rows"), "gridRegion": F.col("__grid.region"),
        "pageId": F.coalesce("pageId", F.when(~shared, F.lit(current))),
        "availableOnPageIds": F.coalesce("availableOnPageIds", F.when(application, F.array(F.lit(current))).otherwise(none)),
        "reviewStatus": F.when(lapsed & (F.col("reviewStatus") == "edited"), "pending").otherwise(F.col("reviewStatus")),
        "source": F.when(lapsed, "ai").otherwise(F.col("source")),
    }
    return rows.withColumns(shape).drop("__grid", "__edited")


def page_elements(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """page, elements: the ids of what each page owns and of what the application offers on it, in order of pos. elements: id, pos, pageId, ownerKind, availableOnPageIds."""
    offered = elements.where("ownerKind = 'application'").select("id", "pos", F.explode("availableOnPageIds").alias("page"))
    listed = elements.where("pageId IS NOT NULL").select("id", "pos", F.col("pageId").alias("page")).unionByName(offered).distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    found = listed.groupBy("page").agg(ids.alias("elements"))
    return pages.select("page").join(found, "page", "left").withColumn("elements", F.coalesce("elements", F.array().cast(found.schema["elements"].dataType)))


def owned(elements: DataFrame, application: str, current: str, keep: Keep) -> DataFrame:
    """id, pos, parent, owner_kind, owner, page, children after parents have been put in order: elements (id, pos, parent, owner_kind, page).

    An unknown parent is none. A child belongs to its parent; below what the application owns it is shared and on no page, else it is
    on the page of its topmost ancestor. Elements on or below a cycle of parents keep their page.
    """
    ids = elements.select(F.col("id").alias("parent")).distinct()
    rows = elements.join(ids.withColumn("__known", F.lit(True)).hint("merge"), "parent", "left").withColumn("parent", F.when(F.col("__known"), F.col("parent"))).drop("__known")
    tops = terminal_owner(rows.select(F.col("id").alias("node"), "parent"), keep).select(F.col("node").alias("id"), F.col("terminal").alias("__top"))
    top = rows.select(F.col("id").alias("__top"), F.col("owner_kind").alias("__kind"), F.col("page").alias("__page"))
    rows = rows.join(tops.hint("merge"), "id", "left").join(top.hint("merge"), "__top", "left")
    ofapp, child = F.col("__kind").eqNullSafe(F.lit("application")), F.col("parent").isNotNull()
    page = F.when(child & ofapp, F.lit(None)).when(child, F.coalesce("__page", "page", F.lit(current))).otherwise(F.col("page"))
    kind = F.when(child & ofapp, "shared_component").when(child, "component").when(ofapp, "application").otherwise("page")
    owner = F.when(child, F.col("parent")).when(ofapp, F.lit(application)).otherwise(F.coalesce("page", F.lit(current)))
    below = rows.where(child).groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("children"))
    out = rows.select("id", "pos", "parent", kind.alias("owner_kind"), owner.alias("owner"), page.alias("page")).join(below.hint("merge"), "id", "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast(below.schema["children"].dataType)))


# A UTC time, and a key of extensions under a reversed domain.
UTC_TIME, EXTENSION = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$", r"^(?:[a-z0-9][a-z0-9-]*\.){2,}[A-Za-z][A-Za-z0-9._-]*$"


def serialization_errors(records: DataFrame, key: str, column: str) -> DataFrame:
    """(rule, subject, detail) for every value inside JSON records.

    `time_invalid`: a field whose name ends in `At` and that is no UTC time (with milliseconds or none; null is none); `number_not_finite`; `extension_key`: a key of `extensions` without a reversed
    domain; `extensions_no_object`; `id_after_time`: a sortable identifier `id` made after `recordedAt`; `not_json`. Rules look at values in one walk.
    """
    found = walk(records, key, column)
    name = F.regexp_extract("path", r"([^.\[\]]+)$", 1)
    text, value = F.col("kind") == "string", F.col("value")
    time = F.when(text & value.rlike(UTC_TIME), F.try_to_timestamp(value))
    extension = F.regexp_extract("path", r"^\$\.extensions\.(.+)$", 1)
    own = (extension != "") & F.col("parent").eqNullSafe("$.extensions")
    checks = [
        ("not_json", F.col("kind") == "invalid"),
        ("time_invalid", (F.col("kind") != "invalid") & name.rlike("At$") & time.isNull()),
        ("number_not_finite", (F.col("kind") == "number") & value.isin("NaN", "Infinity", "-Infinity")),
        ("extension_key", own & ~extension.rlike(EXTENSION)),
        ("extensions_no_object", (F.col("path") == "$.extensions") & (F.col("kind") != "object")),
    ]
    hits = F.filter(F.array(*[F.when(test, F.lit(rule)) for rule, test in checks]), lambda r: r.isNotNull())
    wrong = found.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("subject"), F.col("path").alias("detail"))
    v = F.try_parse_json(column)
    made, recorded = id_time(F.try_variant_get(v, "$.id", "string")), F.try_variant_get(v, "$.recordedAt", "string")
    late = records.where(made > F.unix_millis(F.try_to_timestamp(recorded)))
    return wrong.unionByName(violations(late, "id_after_time", F.col(key), F.lit("$.id")))
