"""Validation of a typed project graph against a model: one table of (rule, subject, detail).

Inputs are tables: records (recordKind, id, entityType, projectRef, key, label, summary, lifecycleStatus, attributes as JSON text, knowledge,
uri, capturedAt, subjectRef, payload as JSON text, evidenceRefs), relations (id, relationType, projectRef, sourceRef, targetRef, knowledge), and the
model of `merged_model`. Every rule is a filter, a join or an aggregate, so rules run as one plan over all projects at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions.text import present
from lattika.operators.constraints import all_of, several_parents, violations
from lattika.operators.graph import Keep, on_cycles

# What the states of knowledge may be, and the types of attribute values.
KNOWLEDGE = {
    "origin": ["manual", "ai_inferred", "imported", "system_generated"],
    "reviewStatus": ["pending", "confirmed", "rejected"],
    "validationStatus": ["unverified", "observed", "runtime_verified", "contradicted"],
}
VALUE_TYPES = ["string", "text", "integer", "number", "boolean", "date", "datetime", "option", "multi_option", "entity_ref", "entity_ref_list", "object", "object_list"]
ID = r"^[a-z][a-z0-9_-]*:[A-Za-z0-9][A-Za-z0-9._:-]*$"
REQUIRED = ["key", "label", "summary", "lifecycleStatus", "knowledge"]


@dataclass
class Model:
    """Tables of a model: entity_types (key), relation_types (key, sourceTypes, targetTypes), options (setKey, value, label, status, pos), fields."""

    entity_types: DataFrame
    relation_types: DataFrame
    options: DataFrame
    fields: DataFrame


def merged_model(spark: SparkSession, core: dict, project: dict) -> Model:
    """A core model with a project's overlay.

    Types are replaced by key; an option set's `options` replace, its `addOptions` follow; fields are merged by key, the overlay winning.
    Models are small documents, so this happens on the driver.
    """
    entity = {**core.get("entityTypes", {}), **project.get("entityTypes", {})}
    relation = {**core.get("relationTypes", {}), **project.get("relationTypes", {})}
    options = {k: list(v.get("options", [])) for k, v in core.get("optionSets", {}).items()}
    for key, change in project.get("optionSets", {}).items():
        options[key] = list(change.get("options", options.get(key, []))) + list(change.get("addOptions", []))
    fields: dict[str, dict] = {}
    for field in [*core.get("fields", []), *project.get("fields", [])]:
        if field.get("key"):
            fields[field["key"]] = fields.get(field["key"], {}) | field
    rows = [(k, o.get("value"), o.get("label"), o.get("status", "active"), i) for k, v in options.items() for i, o in enumerate(v)]
    return Model(
        spark.createDataFrame([(k,) for k in entity], "key string"),
        spark.createDataFrame([(k, list(v.get("sourceTypes", [])), list(v.get("targetTypes", []))) for k, v in relation.items()], "key string, sourceTypes array<string>, targetTypes array<string>"),
        spark.createDataFrame(rows, "setKey string, value string, label string, status string, pos int"),
        spark.createDataFrame(
            [(f["key"], list(f.get("appliesTo", [])), f.get("valueType"), f.get("optionSetRef"), bool(f.get("required")), "defaultValue" in f, bool(f.get("allowCustomOptions")), [(c["key"], c.get("valueType"), bool(c.get("required"))) for c in f.get("itemFields", [])]) for f in fields.values()],
            "key string, appliesTo array<string>, valueType string, optionSetRef string, required boolean, hasDefault boolean, allowCustomOptions boolean, itemFields array<struct<key:string,valueType:string,required:boolean>>",
        ),
    )


def model_errors(model: Model) -> DataFrame:
    """Broken parts of a model itself."""
    known = model.entity_types.agg(F.collect_set("key").alias("types"))  # one row
    sets = model.options.select(F.col("setKey")).distinct()
    fields, rel = model.fields, model.relation_types
    stray = lambda c: F.array_except(F.array_except(c, F.col("types")), F.array(F.lit("*")))
    subject = F.lit("model")
    sides = rel.select("key", F.explode(F.create_map(F.lit("sourceTypes"), F.col("sourceTypes"), F.lit("targetTypes"), F.col("targetTypes"))).alias("side", "listed")).crossJoin(F.broadcast(known))
    applied = fields.crossJoin(F.broadcast(known)).withColumn("listed", F.array_except("appliesTo", "types")).where(F.size("listed") > 0)
    return all_of([
        violations(model.options.where(~present(F.col("value")) | ~present(F.col("label")) | F.col("value").isNull() | F.col("label").isNull()), "option_incomplete", subject, F.col("setKey")),
        violations(model.options.groupBy("setKey", "value").count().where("count > 1"), "option_duplicate", subject, F.concat_ws("=", "setKey", "value")),
        violations(fields.where(~F.coalesce(F.col("valueType").isin(VALUE_TYPES), F.lit(False))), "field_type_unsupported", subject, F.col("key")),
        violations(applied, "field_applies_to_unknown", subject, F.col("key")),
        violations(fields.where("optionSetRef IS NOT NULL").join(sets, F.col("optionSetRef") == F.col("setKey"), "left_anti"), "field_option_set_unknown", subject, F.col("key")),
        violations(sides.where(F.size(stray(F.col("listed"))) > 0), "relation_type_unknown", subject, F.concat_ws(".", "key", "side")),
    ])


def typed(value: Column, kind: Column) -> Column:
    """A JSON variant has the type that a field declares."""
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    whole, decimal = shape == "BIGINT", shape.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    is_list, is_object, is_text = shape.startswith("ARRAY"), shape.startswith("OBJECT"), shape == "STRING"
    words = F.try_variant_get(value, "$", "array<string>")
    members = F.try_variant_get(value, "$", "array<variant>")
    all_text = is_list & F.forall(members, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.when(kind.isin("string", "text", "date", "datetime", "option"), is_text)
        .when(kind == "integer", whole)
        .when(kind == "number", decimal)
        .when(kind == "boolean", shape == "BOOLEAN")
        .when(kind == "multi_option", all_text)
        .when(kind == "entity_ref", is_text & text.rlike(ID))
        .when(kind == "entity_ref_list", all_text & F.forall(words, lambda v: v.rlike(ID)))
        .when(kind == "object", is_object)
        .when(kind == "object_list", is_list & F.forall(members, lambda v: F.schema_of_variant(v).startswith("OBJECT"))),
        F.lit(False),
    )


def attribute_errors(entities: DataFrame, model: Model) -> DataFrame:
    """Undeclared, missing, mistyped attributes and unknown options of entities."""
    parsed = entities.select("id", "entityType", F.try_parse_json("attributes").alias("v"))
    shaped = parsed.withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    declared = model.fields.select("key", F.explode("appliesTo").alias("entityType"), "valueType", "optionSetRef", "required", "hasDefault", "allowCustomOptions", "itemFields")
    given = shaped.where("ok").select("id", "entityType", F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e")).select("id", "entityType", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    joined = given.join(declared, ["entityType", "key"])
    wrong = joined.where(~typed(F.col("value"), F.col("valueType")))
    right = joined.where(typed(F.col("value"), F.col("valueType")))
    allowed = model.options.where("status = 'active'").groupBy(F.col("setKey").alias("optionSetRef")).agg(F.collect_set("value").alias("allowed"))
    chosen = F.coalesce(F.try_variant_get("value", "$", "array<string>"), F.array(F.try_variant_get("value", "$", "string")))
    options = right.where("optionSetRef IS NOT NULL AND NOT allowCustomOptions").join(allowed, "optionSetRef", "left").withColumn("unknown", F.array_except(chosen, F.coalesce("allowed", F.array().cast("array<string>")))).where(F.size("unknown") > 0)
    missing = shaped.where("ok").join(declared.where("required AND NOT hasDefault"), "entityType").join(given.select("id", "key"), ["id", "key"], "left_anti")
    items = right.where("valueType = 'object_list' AND size(itemFields) > 0").select("id", "key", "itemFields", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("n", "item"))
    parts = items.select("id", "key", "n", F.try_variant_get("item", "$", "map<string,variant>").alias("item"), F.inline("itemFields").alias("child", "childType", "childRequired"))
    part = F.concat("key", F.lit("["), F.col("n").cast("string"), F.lit("]."), "child")
    held = F.map_contains_key("item", F.col("child"))
    detail = F.col("key")
    return all_of([
        violations(parts.where(F.col("childRequired") & ~held), "item_missing", F.col("id"), part),
        violations(parts.where(held & ~typed(F.element_at("item", F.col("child")), F.col("childType"))), "item_type", F.col("id"), part),
        violations(shaped.where("NOT ok"), "attributes_not_object", F.col("id"), F.lit("attributes")),
        violations(given.join(declared, ["entityType", "key"], "left_anti"), "attribute_undeclared", F.col("id"), detail),
        violations(missing, "attribute_missing", F.col("id"), detail),
        violations(wrong, "attribute_type", F.col("id"), detail),
        violations(options, "option_unknown", F.col("id"), F.concat(detail, F.lit("="), F.array_join("unknown", ","))),
    ])


def knowledge_errors(rows: DataFrame) -> DataFrame:
    """Entities and relations: (id, knowledge)."""
    k = F.col("knowledge")
    states = [violations(rows.where(k.isNotNull() & ~F.coalesce(k[f].isin(v), F.lit(False))), f"knowledge_{f}", F.col("id"), k[f]) for f, v in KNOWLEDGE.items()]
    return all_of([
        violations(rows.where(k.isNull()), "knowledge_missing", F.col("id"), F.lit("knowledge")),
        *states,
        violations(rows.where(k.isNotNull() & k["evidenceRefs"].isNull()), "knowledge_evidence", F.col("id"), F.lit("evidenceRefs")),
        violations(rows.where((k["confidence"] < 0) | (k["confidence"] > 1)), "knowledge_confidence", F.col("id"), k["confidence"]),
    ])


def graph_errors(records: DataFrame, relations: DataFrame, model: Model, keep: Keep, project: str | None = None) -> DataFrame:
    """All violations of a graph: (rule, subject, detail). A record without a usable id is reported once and left out of other rules.

    project: the graph's own projectRef, which every row must name; where it is not given, tables may hold several graphs and rows are not held against one.
    """
    both = records.select("id", "projectRef", "recordKind").unionByName(relations.select("id", "projectRef", F.lit("Relation").alias("recordKind")))
    valid = F.coalesce(F.col("id").rlike(ID), F.lit(False))
    good, edges = records.where(valid), relations.where(valid)
    entities, evidence = good.where("recordKind = 'Entity'"), good.where("recordKind = 'Evidence'").select(F.col("id").alias("ref"))
    kinds = entities.select(F.col("id").alias("__id"), F.col("entityType").alias("__type")).distinct()
    named = good.where("recordKind = 'Entity'").select("id", F.explode(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda v: v.isNotNull())).alias("field"))
    known_edges = edges.join(model.relation_types.withColumnRenamed("key", "relationType"), "relationType")

    def side(ref: str, types: str, rule: str) -> list[DataFrame]:
        ends = known_edges.join(kinds, F.col(ref) == F.col("__id"), "left")
        outside = ends.where(F.col("__id").isNotNull() & ~F.array_contains(types, "*") & ~F.array_contains(types, F.col("__type")))
        return [violations(ends.where("__id IS NULL"), f"{rule}_unresolved", F.col("id"), F.col(ref)), violations(outside, f"{rule}_type", F.col("id"), F.col("__type"))]

    observed = good.where("recordKind = 'Observation'")
    parts = observed.select("id", F.explode(F.try_variant_get(F.try_parse_json("payload"), "$.elements", "array<variant>")).alias("e")).select("id", F.try_variant_get("e", "$.elementRef", "string").alias("ref"))
    entity_ids = kinds.select(F.col("__id").alias("ref")).distinct()
    held = all_of([good.select("id", "knowledge"), edges.select("id", "knowledge")])
    refs = all_of([held.select("id", F.explode("knowledge.evidenceRefs").alias("ref")), good.select("id", F.explode("evidenceRefs").alias("ref"))])
    contains = relations.where("relationType = 'contains'")
    no_refs = F.coalesce(F.size("knowledge.evidenceRefs") <= 0, F.lit(True))
    astray = [violations(both.where(valid & ~F.col("projectRef").eqNullSafe(F.lit(project))), "project_differs", F.col("id"), F.col("projectRef"))] if project is not None else []
    return all_of([
        model_errors(model),
        violations(both.where(~valid), "id_invalid", F.coalesce("id", F.lit("")), F.col("recordKind")),
        violations(both.where(valid).groupBy("id").count().where("count > 1"), "id_duplicate", F.col("id"), F.col("count")),
        *astray,
        violations(good.where(~F.coalesce(F.col("recordKind").isin("Entity", "Observation", "Evidence"), F.lit(False))), "kind_unknown", F.col("id"), F.col("recordKind")),
        violations(entities.join(model.entity_types.select(F.col("key").alias("entityType")), "entityType", "left_anti"), "entity_type_unknown", F.col("id"), F.col("entityType")),
        violations(named, "field_missing", F.col("id"), F.col("field")),
        knowledge_errors(all_of([entities.select("id", "knowledge"), edges.select("id", "knowledge")])),
        attribute_errors(entities, model),
        violations(edges.join(model.relation_types.select(F.col("key").alias("relationType")), "relationType", "left_anti"), "relation_type_unknown", F.col("id"), F.col("relationType")),
        *side("sourceRef", "sourceTypes", "source"),
        *side("targetRef", "targetTypes", "target"),
        violations(observed.join(entity_ids, F.col("subjectRef") == F.col("ref"), "left_anti"), "subject_unresolved", F.col("id"), F.col("subjectRef")),
        violations(parts.join(entity_ids, "ref", "left_anti"), "element_unresolved", F.col("id"), F.col("ref")),
        violations(good.where((F.col("recordKind") == "Evidence") & ~(F.coalesce(present(F.col("uri")) & present(F.col("capturedAt")), F.lit(False)))), "evidence_incomplete", F.col("id"), F.lit("uri, capturedAt")),
        violations(refs.join(evidence, "ref", "left_anti"), "evidence_unresolved", F.col("id"), F.col("ref")),
        violations(held.where((F.col("knowledge.validationStatus") == "runtime_verified") & no_refs), "verified_without_evidence", F.col("id"), F.lit("evidenceRefs")),
        violations(several_parents(contains, "targetRef", "sourceRef"), "several_parents", F.col("targetRef"), F.array_join("parents", ",")),
        violations(on_cycles(contains.select(F.col("sourceRef").alias("a"), F.col("targetRef").alias("b")), keep), "containment_cycle", F.col("node"), F.lit("contains")),
    ])


def report(errors: DataFrame) -> DataFrame:
    """A line per violation, in order: `subject: rule detail`."""
    return errors.orderBy("rule", "subject", "detail").select(F.concat(F.col("subject"), F.lit(": "), F.col("rule"), F.lit(" "), F.coalesce("detail", F.lit(""))).alias("value"))
