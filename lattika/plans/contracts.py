"""Certified contracts, their triggers and components, and what pages and paths must hold: rows of (rule, subject, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.operators.constraints import all_of, violations

# Parts of a certified component.
PARTS = ("visibleLabel", "actionableControl", "labelTextActionable", "containerElementRef", "labelElementRef", "triggerElementRef")


def missing_relations(elements: DataFrame, contracts: DataFrame) -> DataFrame:
    """Elements that do not name a contract which they trigger. elements: id, relations; contracts: id, trigger."""
    used = contracts.select(F.col("trigger").alias("element"), F.concat(F.lit("authority_contract:"), "id").alias("relation"))
    joined = elements.select(F.col("id").alias("element"), "relations").join(used, "element")
    return violations(joined.where(~F.coalesce(F.array_contains("relations", F.col("relation")), F.lit(False))), "relation_missing", F.col("element"), F.col("relation"))


def verification_errors(contracts: DataFrame, transitions: DataFrame) -> DataFrame:
    """Verified contracts without a transition of the same meaning, contradicted ones without a defect, unknown states.

    contracts: key, status, verified (a transition), pages (sources), trigger, capability, target, defect; transitions: id, source, trigger, capability, target.
    """
    t = transitions.select(F.col("id").alias("verified"), F.struct("source", "trigger", "capability", "target").alias("t"))
    joined = contracts.where("status = 'verified'").join(t, "verified", "left")
    same = F.array_contains("pages", F.col("t.source")) & F.col("trigger").eqNullSafe(F.col("t.trigger")) & F.col("capability").eqNullSafe(F.col("t.capability")) & F.col("target").eqNullSafe(F.col("t.target"))
    return all_of([
        violations(contracts.where("NOT coalesce(status IN ('pending', 'verified', 'contradicted'), false)"), "status_unknown", F.col("key"), F.col("status")),
        violations(joined.where("t IS NULL"), "transition_missing", F.col("key"), F.col("verified")),
        violations(joined.where(F.col("t").isNotNull() & ~F.coalesce(same, F.lit(False))), "transition_differs", F.col("key"), F.col("verified")),
        violations(contracts.where("status = 'contradicted' AND coalesce(defect, '') = ''"), "defect_missing", F.col("key"), F.col("status")),
    ])


def component_errors(contracts: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Certified components that are not built as certified: a container on the source page that owns just its label and its trigger.

    contracts: key, source (a page, or null), trigger, fact (map of PARTS; other contracts have none of them); elements: id, type, owner_kind, owner, children,
    capabilities, actionable; pages: id, elements. Elements and pages are as many as contracts, so joins merge: a task holds its own share of them and none passes through the driver.
    """
    given = contracts.where(F.arrays_overlap(F.map_keys("fact"), F.array(*map(F.lit, PARTS))))
    whole = F.size(F.array_except(F.array(*map(F.lit, PARTS)), F.map_keys("fact"))) == 0
    rows, key = given.where(whole), F.col("key")
    for name, part in (("container", PARTS[3]), ("label", PARTS[4]), ("certified", PARTS[5])):
        e = elements.select(F.col("id").alias(f"__{name}"), F.struct("*").alias(name))
        rows = rows.join(e.hint("merge"), F.col("fact")[part] == F.col(f"__{name}"), "left").drop(f"__{name}")
    rows = rows.join(pages.select(F.col("id").alias("source"), F.col("elements").alias("listed")).hint("merge"), "source", "left")
    found = rows.where("container IS NOT NULL AND label IS NOT NULL AND certified IS NOT NULL")
    on_page = F.col("listed").isNotNull()
    own = lambda e: F.col(f"{e}.owner_kind").eqNullSafe(F.lit("component")) & F.col(f"{e}.owner").eqNullSafe(F.col("container.id"))
    lists = lambda e: F.coalesce(F.array_contains("listed", F.col(f"{e}.id")), F.lit(False))
    checks = [
        ("children_differ", ~F.array_sort(F.array_distinct(F.coalesce("container.children", F.array().cast("array<string>")))).eqNullSafe(F.array_sort(F.array_distinct(F.array("label.id", "certified.id"))))),
        ("container_owner", on_page & ~(F.col("container.owner_kind").eqNullSafe(F.lit("page")) & F.col("container.owner").eqNullSafe(F.col("source")))),
        ("container_unlisted", on_page & ~lists("container")),
        ("child_listed", on_page & (lists("label") | lists("certified"))),
        ("child_owner", ~(own("label") & own("certified"))),
        ("label_kind", ~F.col("label.type").eqNullSafe(F.lit("text_label")) | (F.coalesce(F.size("label.capabilities"), F.lit(0)) > 0)),
        ("label_actionable", ~F.col("label.actionable").eqNullSafe(F.lit(False))),
        ("trigger_differs", ~F.col("certified.id").eqNullSafe(F.col("trigger"))),
    ]
    broken = F.filter(F.array(*[F.when(test, F.lit(rule)) for rule, test in checks]), lambda r: r.isNotNull())
    return all_of([
        violations(given.where(~whole), "fact_incomplete", key, F.lit("fact")),
        violations(rows.where(~F.col("fact")["labelTextActionable"].eqNullSafe(F.lit("false"))), "label_text_actionable", key, F.col("fact")["labelTextActionable"]),
        violations(rows.where("container IS NULL OR label IS NULL OR certified IS NULL"), "part_unresolved", key, F.lit("fact")),
        found.select(F.explode(broken).alias("rule"), key.cast("string").alias("subject"), F.col("container.id").cast("string").alias("detail")),
    ])


def trigger_errors(edges: DataFrame, elements: DataFrame, protected: DataFrame) -> DataFrame:
    """Triggers that may not act: protected ones, ones not marked as actionable, ones without the capability. edges: key, trigger, capability; elements: id, capabilities, actionable; protected: id."""
    joined = edges.join(elements.withColumnRenamed("id", "trigger").withColumnRenamed("capabilities", "owned"), "trigger")
    guarded = joined.join(protected.select(F.col("id").alias("trigger")).distinct(), "trigger", "left_semi")
    return all_of([
        violations(guarded, "trigger_protected", F.col("key"), F.col("trigger")),
        violations(joined.where("NOT coalesce(actionable, false)"), "trigger_not_actionable", F.col("key"), F.col("trigger")),
        violations(joined.where(~F.coalesce(F.array_contains("owned", F.col("capability")), F.lit(False))), "capability_missing", F.col("key"), F.col("capability")),
    ])


def page_element_errors(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that a page lists though it does not own them and the application does not offer them there. pages: id, elements; elements: id, owner_kind, owner, available."""
    listed = pages.select(F.col("id").alias("page"), F.explode("elements").alias("id"))
    joined = listed.join(elements.withColumn("__known", F.lit(True)), "id", "left")
    owned = (F.col("owner_kind") == "page") & (F.col("owner") == F.col("page"))
    offered = (F.col("owner_kind") == "application") & F.array_contains("available", F.col("page"))
    return all_of([
        violations(joined.where("__known IS NULL"), "element_missing", F.col("page"), F.col("id")),
        violations(joined.where(F.col("__known") & ~F.coalesce(owned, F.lit(False)) & ~F.coalesce(offered, F.lit(False))), "element_not_available", F.col("page"), F.col("id")),
    ])


def lost_ids(expected: DataFrame, actual: DataFrame, historical: DataFrame, key: str) -> DataFrame:
    """Ids that were to be kept and are neither among the records nor in their history."""
    return expected.select(key).distinct().join(actual.select(key).union(historical.select(key)).distinct(), key, "left_anti")


def path_errors(files: DataFrame) -> DataFrame:
    """Files that lie not one to three folders deep, or not where their record says. files: path (below its category), feature_path (folders)."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return all_of([
        violations(files.where(~F.size(folders).between(1, 3)), "path_depth", F.col("path"), F.size(folders)),
        violations(files.where(~folders.eqNullSafe(F.coalesce("feature_path", F.array().cast("array<string>")))), "path_differs", F.col("path"), F.array_join("feature_path", "/")),
        violations(files.where(~F.coalesce(F.size("feature_path"), F.lit(0)).between(1, 3)), "feature_path_length", F.col("path"), F.size("feature_path")),
    ])


def profile_counts(elements: DataFrame) -> DataFrame:
    """profile, n: elements of each composition profile, in order of profiles."""
    return elements.where("profile IS NOT NULL AND profile <> ''").groupBy("profile").agg(F.count("*").alias("n")).orderBy("profile")


def live_traces(bindings: DataFrame, actions: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, errors): binding -> its action -> the frame before by id and the frame after by state.

    bindings: transition, action, after_state; actions: action, status, passed, before_frame; frames: frame, state. An action that is not verified, and one that lacks a frame, are errors.
    """
    after = frames.select(F.col("state").alias("after_state"), F.col("frame").alias("after"))
    before = frames.select(F.col("frame").alias("before_frame"), F.col("frame").alias("before")).distinct()
    rows = bindings.join(actions, "action", "left").join(before, "before_frame", "left").join(after, "after_state", "left")
    verified = F.coalesce((F.col("status") == "executed_verified") & F.col("passed"), F.lit(False))
    rule = F.when(~verified, "action_not_verified").when(F.col("before").isNull() | F.col("after").isNull(), "frame_missing")
    rows = rows.withColumn("rule", rule)
    errors = rows.where("rule IS NOT NULL").select("rule", F.col("transition").cast("string").alias("subject"), F.col("action").cast("string").alias("detail"))
    return rows.where("rule IS NULL").select("transition", "action", "before", "after"), errors


def conflict_ledger(conflicts: DataFrame, transitions: DataFrame, actions: DataFrame) -> DataFrame:
    """transition, reason, source, target, evidence: a row per deprecated transition with the actions that speak against it, in order. conflicts: transition, reason, action; transitions: id, source, target; actions: action, status."""
    spoken = conflicts.join(actions, "action", "left").groupBy("transition", "reason").agg(F.array_sort(F.collect_list(F.struct("action", "status"))).alias("evidence"))
    return spoken.join(transitions.withColumnRenamed("id", "transition"), "transition", "left").select("transition", "reason", "source", "target", "evidence")
