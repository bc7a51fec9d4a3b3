"""Routes between pages over verified transitions and certified contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.functions.text import present
from lattika.operators.constraints import all_of, dangling, violations
from lattika.operators.graph import Keep, routes
from lattika.operators.merging import resolve_either

# What a risk adds to the cost of an action, what other risks add; profiles.
PENALTIES, OTHER_PENALTY = {"safe": 0, "low": 1, "medium": 4, "high": 16, "critical": 64}, 8
PROFILES = ("shortest", "low-risk")


def closed_transition() -> Column:
    """A transition with all three ends, a closed chain of evidence and a passed postcondition."""
    named = ["sourceRef", "targetRef", "triggerElementRef", "evidence.actionTraceRef", "evidence.beforeFrameRef", "evidence.afterFrameRef"]
    out = F.col("evidence.postcondition") == "pass"
    for c in named:
        out = out & present(F.col(c))
    return F.coalesce(out, F.lit(False))


def routable_contract() -> Column:
    """A certified contract that planning may use and that no run contradicts."""
    return F.coalesce(
        (F.col("edgeKind") == "authority_contract")
        & (F.col("authorityStatus") == "authority_certified")
        & F.col("planningEligible")
        & ~F.col("runtimeEvidenceStatus").eqNullSafe(F.lit("contradicted"))
        & F.col("sourceSelector.kind").isin("exact_page", "shared_availability")
        & (F.col("expectedTarget.kind") == "page"),
        F.lit(False),
    )


def edge_errors(transitions: DataFrame, contracts: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Ends of usable edges that do not resolve: (rule, subject, detail)."""
    used, agreed = transitions.where(closed_transition()), contracts.where(routable_contract())
    exact = agreed.where("sourceSelector.kind = 'exact_page'").withColumn("ref", F.col("sourceSelector.ref"))
    shared = agreed.where("sourceSelector.kind = 'shared_availability'").withColumn("ref", F.col("sourceSelector.ref"))
    roots = elements.where("owner.kind = 'application'")
    open_pages = shared.join(roots.select(F.col("id").alias("ref"), "availableOnPageRefs"), "ref")
    listed = open_pages.select("key", F.explode("availableOnPageRefs").alias("page"))
    target = agreed.withColumn("ref", F.col("expectedTarget.ref"))
    key = F.col("key")
    return all_of([
        violations(dangling(used, "sourceRef", pages, "id"), "source_unresolved", key, F.col("sourceRef")),
        violations(dangling(used, "targetRef", pages, "id"), "target_unresolved", key, F.col("targetRef")),
        violations(dangling(used, "triggerElementRef", elements, "id"), "trigger_unresolved", key, F.col("triggerElementRef")),
        violations(dangling(exact, "ref", pages, "id"), "selector_unresolved", key, F.col("ref")),
        violations(dangling(shared, "ref", roots, "id"), "shared_root_unresolved", key, F.col("ref")),
        violations(open_pages.where(F.coalesce(F.size("availableOnPageRefs") <= 0, F.lit(True))), "shared_root_without_pages", key, F.col("ref")),
        violations(dangling(listed, "page", pages, "id"), "shared_page_unresolved", key, F.col("page")),
        violations(dangling(target, "ref", pages, "id"), "expected_target_unresolved", key, F.col("ref")),
        violations(dangling(agreed, "triggerElementRef", elements, "id"), "contract_trigger_unresolved", key, F.col("triggerElementRef")),
    ])


def edges(transitions: DataFrame, contracts: DataFrame, elements: DataFrame, profile: str) -> DataFrame:
    """a, b, key, cost, kind, risk of every usable edge; a shared contract is an edge from each page where its root is available."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    walked = transitions.where(closed_transition()).select(F.col("sourceRef").alias("a"), F.col("targetRef").alias("b"), "key", "risk", F.lit("0").alias("kind"))
    agreed = contracts.where(routable_contract())
    exact = agreed.where("sourceSelector.kind = 'exact_page'").select(F.col("sourceSelector.ref").alias("a"), F.col("expectedTarget.ref").alias("b"), "key", "risk", F.lit("1").alias("kind"))
    roots = elements.select(F.col("id").alias("root"), F.explode("availableOnPageRefs").alias("a"))
    shared = agreed.where("sourceSelector.kind = 'shared_availability'").join(roots, F.col("sourceSelector.ref") == F.col("root"))
    shared = shared.select("a", F.col("expectedTarget.ref").alias("b"), "key", "risk", F.lit("1").alias("kind"))
    penalty = F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])[F.col("risk")], F.lit(OTHER_PENALTY))
    cost = 1 + penalty if profile == "low-risk" else F.lit(1)
    return walked.union(exact).union(shared).withColumn("cost", cost)


def find_routes(questions: DataFrame, pages: DataFrame, usable: DataFrame, keep: Keep) -> DataFrame:
    """questions (start, goal: ids or keys) with cost, steps and path; error says what could not be found.

    All questions are answered by one search from their distinct starts.
    """
    known = pages.select("id", "key")
    ends = resolve_either(questions, "start", known).withColumnRenamed("id", "start_id")
    ends = resolve_either(ends, "goal", known).withColumnRenamed("id", "goal_id")
    ends = keep(ends, "questions")
    asked = ends.where("start_id IS NOT NULL AND goal_id IS NOT NULL")
    best = routes(usable, asked.select(F.col("start_id").alias("node")), keep, asked.select(F.col("start_id").alias("start"), F.col("goal_id").alias("node")))
    found = ends.join(best.select(F.col("start").alias("start_id"), F.col("node").alias("goal_id"), "cost", "steps", "path"), ["start_id", "goal_id"], "left")
    error = F.when(F.col("start_id").isNull(), "start not found").when(F.col("goal_id").isNull(), "goal not found").when(F.col("cost").isNull(), "No verified route")
    return found.select("start", "goal", "cost", "steps", "path", error.alias("error"))


def as_document(found: DataFrame) -> DataFrame:
    """One JSON text per answered question."""
    return found.select(F.to_json(F.struct("start", "goal", "cost", "steps", F.transform("path", lambda k, i: F.struct((i + 1).alias("sequence"), k.alias("key"))).alias("route"), "error")).alias("value"))


def statistics(transitions: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: transitions, closed_transitions, contracts, routable_contracts, excluded."""
    a = transitions.agg(F.count("*").alias("transitions"), F.count_if(closed_transition()).alias("closed_transitions"))
    b = contracts.agg(F.count("*").alias("contracts"), F.count_if(routable_contract()).alias("routable_contracts"))
    total = F.col("transitions") + F.col("contracts") - F.col("closed_transitions") - F.col("routable_contracts")
    return a.crossJoin(F.broadcast(b)).withColumn("excluded", total)  # one row each
