"""Evidence behind elements and transitions: candidates, bindings, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.functions.geometry import closed_contains
from lattika.operators.selection import pattern_matches, top_one


def control_candidates(targets: DataFrame, controls: DataFrame, traces: DataFrame) -> DataFrame:
    """target, frame, captured_at, rect, origin of everything that may show a target, and which is the latest.

    targets: target, patterns; controls: key, frame, captured_at, locator, geometry (rects, the first that is known counts); traces: key, frame, captured_at, attempts
    (array of status, rect: the first that passed counts). Rows without a rect are left out.
    """
    seen = pattern_matches(targets, controls, "key").select("target", "frame", "captured_at", F.coalesce("locator", "geometry").alias("rect"), F.lit("control").alias("origin"))
    passed = F.get(F.filter("attempts", lambda a: a["status"] == "pass"), F.lit(0))["rect"]
    used = pattern_matches(targets, traces, "key").select("target", "frame", "captured_at", passed.alias("rect"), F.lit("trace").alias("origin"))
    both = seen.unionByName(used).where("rect IS NOT NULL")
    first = both.groupBy("target", "captured_at").agg(F.min(F.struct("origin", "frame")).alias("first"))
    best = first.groupBy("target").agg(F.max(F.struct("captured_at", "first")).alias("best"))  # a row per target; a null time is the least
    one = F.row_number().over(Window.partitionBy("target", "captured_at", "origin", "frame").orderBy("rect"))  # of rows that are equal in these one is the latest
    is_best = F.struct("captured_at", F.struct("origin", "frame")).eqNullSafe(F.col("best"))
    return both.withColumn("__one", one).join(F.broadcast(best), "target").withColumn("latest", is_best & (F.col("__one") == 1)).drop("best", "__one")


def matching_traces(transitions: DataFrame, traces: DataFrame) -> DataFrame:
    """transition, trace: the latest trace that fits each transition; none where none fits.

    transitions: transition, from_states, to_states (empty: any), key, operations, capability; traces: trace, from_state, to_state, key, operation, capability, ended_at.
    States must fit, and the key, the operation or the capability; two absent capabilities fit. Transitions are
    expanded by the key that makes them fit, so that Spark joins on equal values; of traces that are equal in it and in their states only
    the latest can be one's latest, and only that one is joined.
    """
    def fits(states: str, state: str) -> Column:
        return (F.size(states) == 0) | F.coalesce(F.array_contains(states, F.col(state)), F.lit(False))

    t = traces.select(*[F.col(c).alias(f"t_{c}") for c in traces.columns])
    newest = lambda c: top_one(t, [f"t_{c}", "t_from_state", "t_to_state"], F.col("t_ended_at").desc_nulls_last(), F.col("t_trace"))
    by_key = transitions.join(newest("key"), F.col("key") == F.col("t_key"))
    by_operation = transitions.withColumn("__op", F.explode("operations")).join(newest("operation"), F.col("__op") == F.col("t_operation")).drop("__op")
    by_capability = transitions.join(newest("capability"), F.col("capability").eqNullSafe(F.col("t_capability")))
    found = by_key.unionByName(by_operation).unionByName(by_capability).where(fits("from_states", "t_from_state") & fits("to_states", "t_to_state"))
    best = top_one(found, ["transition"], F.col("t_ended_at").desc_nulls_last(), F.col("t_trace")).select("transition", F.col("t_trace").alias("trace"))
    return transitions.select("transition").join(best, "transition", "left")


def live_bindings(states: DataFrame, frames: DataFrame, locators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, errors): state -> its frame -> the locator of each bound element; what does not resolve is an error row.

    states: state, frame, element; frames: frame, screenshot; locators: element, frame, screenshot, left, top, width, height, x, y. A locator must come from the
    frame's screenshot and hold its own centre.
    """
    framed = states.join(frames.withColumnRenamed("screenshot", "shot"), "frame", "left")
    bound = framed.join(locators, ["element", "frame"], "left")
    same = F.col("screenshot").eqNullSafe(F.col("shot"))
    inside = closed_contains(*[F.col(c) for c in ("left", "top", "width", "height", "x", "y")])
    rule = F.when(F.col("shot").isNull(), "frame_missing").when(F.col("left").isNull(), "locator_missing").when(~same, "screenshot_differs").when(~F.coalesce(inside, F.lit(False)), "centre_outside")
    checked = bound.withColumn("__rule", rule)
    errors = checked.where("__rule IS NOT NULL").select(F.col("__rule").alias("rule"), F.col("state").alias("subject"), F.col("element").alias("detail"))
    return checked.where("__rule IS NULL").drop("__rule", "shot"), errors


def preview(edges: DataFrame, observations: DataFrame) -> DataFrame:
    """edge, frame, rect: an observation of an edge's trigger, in the edge's own frame if there is one, else the latest with a rect.

    edges: edge, element, before_frame; observations: element, frame, observed_at, rect.
    """
    seen = observations.where("rect IS NOT NULL").select("element", "frame", "observed_at", "rect")
    when = F.col("observed_at").desc_nulls_last()
    own = top_one(seen, ["element", "frame"], when).select("element", F.col("frame").alias("before_frame"), F.struct("frame", "rect").alias("__own"))
    last = top_one(seen, ["element"], when, F.col("frame")).select("element", F.struct("frame", "rect").alias("__last"))
    best = F.coalesce("__own", "__last")
    return edges.join(own, ["element", "before_frame"], "left").join(last, "element", "left").select("edge", best["frame"].alias("frame"), best["rect"].alias("rect"))


def audit(raw: DataFrame, qualified: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: raw, qualified and rejected inputs, outputs and those still pending."""
    a = raw.agg(F.count("*").alias("raw"))
    b = qualified.agg(F.count("*").alias("qualified"))
    c = outputs.agg(F.count("*").alias("outputs"), F.count_if(F.col("pending")).alias("pending"))
    return a.crossJoin(b).crossJoin(c).withColumn("rejected", F.col("raw") - F.col("qualified"))  # one row each


def presentation_groups(instances: DataFrame, signature: list[str]) -> DataFrame:
    """group, members, representative: instances (id, is_primary, observed_at, signature fields) that look alike, the primary first, then by time and id."""
    hashed = instances.withColumn("group", F.sha2(F.to_json(F.struct(*sorted(signature))), 256))
    members = F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "observed_at", "id")))
    return hashed.groupBy("group").agg(F.transform(members, lambda m: m["id"]).alias("members")).withColumn("representative", F.get("members", F.lit(0)))


def partition_errors(groups: DataFrame, instances: DataFrame) -> DataFrame:
    """Violations of a partition: members of no group, of several, or unknown. groups: group, members; instances: id."""
    placed = groups.select("group", F.explode("members").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    joined = instances.select("id", F.lit(True).alias("known")).join(placed, "id", "full_outer")
    rule = F.when(F.col("known").isNull(), "member_unknown").when(F.col("n").isNull(), "member_missing").when(F.col("n") > 1, "member_repeated")
    rows = joined.withColumn("rule", rule).where("rule IS NOT NULL")
    return rows.select("rule", F.col("id").cast("string").alias("subject"), F.col("n").cast("string").alias("detail"))


def checkpoint_summary(elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, covered (how far down the elements reach, 0 to 1), n, completed (their candidate keys in order)."""
    return elements.groupBy(*keys).agg(F.coalesce(F.max(F.least(F.lit(1.0), F.col("y") + F.col("height"))), F.lit(0.0)).alias("covered"), F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("completed"))


def confidence(*values: str) -> Column:
    """The least of the confidences that are known."""
    return F.array_min(F.array(*[F.col(v) for v in values]))
