"""Rules of a graph of pages, elements, transitions and contracts, as rows for the rule compiler.

`TABLES` names the columns of the tables; the manifest is one row. `completed` adds what a graph lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.operators.graph import Keep, availability, terminal_owner
from lattika.operators.rules import Facts, Rule, facts_table, looked_up, violations_of

# Which roles the profiles of setting rows need and allow, which of them act and which must not, the role that the row itself may play and the one that may share its element with that.
PROFILES = [
    ("toggle_row", ["label", "settingControl"], ["secondaryText"], ["settingControl"], ["label", "secondaryText"], None, None),
    ("selector_row", ["label", "currentValue", "settingTrigger"], ["affordance", "secondaryText"], ["settingTrigger"], ["label", "currentValue", "secondaryText"], "settingTrigger", "affordance"),
    ("help_toggle_row", ["label", "helpTrigger", "helpPopover", "settingControl"], ["secondaryText"], ["helpTrigger", "settingControl"], ["label", "helpPopover", "secondaryText"], None, None),
    ("action_row", ["explanatoryContent", "actionTrigger"], ["secondaryText"], ["actionTrigger"], ["explanatoryContent", "secondaryText"], None, None),
]
# States of runtime evidence, element types of setting rows, the source of materialised elements.
EVIDENCE_STATES, ROW_TYPES, MATERIALISED = ("pending", "verified", "contradicted"), ("list_entry", "toggle"), "verified_legacy_midscene_evidence"

#: The columns of each table.
TABLES = {
    "applications": "id string, key string",
    "manifest": "entityIds array<string>, graphRevision string",
    "pages": "id string, key string, label string, featurePath array<string>, elementRefs array<string>, inboundTransitionRefs array<string>, outboundTransitionRefs array<string>, inboundContractRefs array<string>, outboundContractRefs array<string>, frames array<string>, states array<struct<key:string,frameRefs:array<string>>>",
    "elements": "id string, key string, label string, status string, role string, elementType string, featurePath array<string>, owner struct<kind:string,ref:string>, parentElementRef string, childElementRefs array<string>, relationshipRefs array<string>, availableOnPageRefs array<string>, capabilities array<string>, actionable boolean, sourceType string, observations array<struct<frameRef:string,rect:string,failed:boolean,redboxRef:string>>, composition struct<profile:string,roles:map<string,string>>",
    "transitions": "id string, key string, sourceRef string, targetRef string, triggerElementRef string, capability string, evidence struct<postcondition:string,actionTraceRef:string>",
    "contracts": "id string, key string, edgeKind string, sourceSelector struct<kind:string,ref:string>, expectedTarget struct<kind:string,ref:string>, triggerElementRef string, capability string, sourceType string, authorityStatus string, runtimeEvidenceStatus string, verifiedTransitionRef string, defectRef string",
}

_PARTS = "owner.kind IN ('component', 'shared_component')"
_REFS = "coalesce(map_values(roles), array())"
_ROLE = "coalesce(map_entries(roles), array())"
_KIDS = "coalesce(childElementRefs, array())"
_RELATED = "coalesce(relationshipRefs, array())"
_SELF = "(p.self_role IS NOT NULL AND roles[p.self_role] <=> id)"


def _ids(table: str, kind: str) -> list[Rule]:
    """An id and a key belong to one record, whatever its type."""
    return [
        Rule(f"{kind}_id_repeated", table, "f.n > 1", "id", to="entity", ref="id"),
        Rule(f"{kind}_key_repeated", table, "f.n > 1", "key", to="key", ref="key"),
        Rule(f"{kind}_not_in_manifest", table, "f IS NULL", "id", to="manifest", ref="id"),
    ]


def _missing(code: str, table: str, to: str, ref: str, each: str | None = None, **more) -> Rule:
    """A reference must name a record or an edge."""
    return Rule(code, table, "f IS NULL", more.pop("detail", ref), each, to, ref, **more)


GRAPH = [
    Rule("application_count", "manifest", "f IS NULL OR f.n <> 1", to="all applications", ref="'*'"),
    Rule("revision_missing", "manifest", "coalesce(graphRevision, '') = ''"),
    _missing("manifest_extra", "manifest", "entity", "x", "entityIds"),
    *_ids("applications", "application"), *_ids("pages", "page"), *_ids("elements", "element"), *_ids("transitions", "transition"), *_ids("contracts", "contract"),
]

PAGES = [
    Rule("page_feature_path", "pages", "NOT coalesce(size(featurePath) BETWEEN 1 AND 3, false)"),
    Rule("page_unobserved", "pages", "coalesce(size(frames), 0) < 1"),
    Rule("page_state_frames", "pages", "size(array_except(coalesce(x.frameRefs, array()), coalesce(frames, array()))) > 0", "x.key", "states"),
    _missing("page_element_missing", "pages", "element", "x", "elementRefs"),
    _missing("page_element_not_available", "pages", "on page", "x || '>' || id", "elementRefs", detail="x", unless="page_element_missing"),
    _missing("page_inbound_extra", "pages", "arrives", "x || '>' || id", "inboundTransitionRefs", detail="x"),
    _missing("page_outbound_extra", "pages", "leaves", "x || '>' || id", "outboundTransitionRefs", detail="x"),
    _missing("page_inbound_contract_extra", "pages", "contract arrives", "x || '>' || id", "inboundContractRefs", detail="x"),
    _missing("page_outbound_contract_extra", "pages", "contract leaves", "x || '>' || id", "outboundContractRefs", detail="x"),
]

OWNERS = [
    Rule("owner_kind", "elements", "NOT coalesce(owner.kind IN ('application', 'page', 'component', 'shared_component'), false)", "owner.kind"),
    Rule("owner_application_missing", "elements", "row.owner.kind = 'application' AND f IS NULL", "owner.ref", to="application", ref="owner.ref"),
    Rule("owner_page_missing", "elements", "row.owner.kind = 'page' AND f IS NULL", "owner.ref", to="page", ref="owner.ref"),
    Rule("owner_element_missing", "elements", "row.owner.kind IN ('component', 'shared_component') AND f IS NULL", "owner.ref", to="element", ref="owner.ref"),
    Rule("owner_by_key", "elements", "row.owner.kind = 'shared_component' AND f IS NOT NULL", "owner.ref", to="element key", ref="owner.ref", unless="owner_element_missing"),
    Rule("owned_with_parent", "elements", "owner.kind IN ('application', 'page') AND parentElementRef IS NOT NULL", "parentElementRef"),
    Rule("page_path_differs", "elements", "row.owner.kind = 'page' AND f IS NOT NULL AND NOT f.featurePath <=> row.featurePath", "owner.ref", to="page", ref="owner.ref"),
    Rule("page_lacks_element", "elements", "row.owner.kind = 'page' AND f IS NULL", "owner.ref", to="page element", ref="owner.ref || '>' || id", unless="owner_page_missing"),
    Rule("page_label_chain", "elements", f"row.owner.kind = 'page' AND row.sourceType = '{MATERIALISED}' AND NOT startswith(coalesce(row.label, ''), coalesce(f.label, '') || '-') AND f IS NOT NULL", "owner.ref", to="page", ref="owner.ref"),
    Rule("parent_not_owner", "elements", "row.owner.kind IN ('component', 'shared_component') AND f IS NOT NULL AND NOT row.parentElementRef <=> ref", "parentElementRef", to="element", ref="owner.ref"),
    Rule("parent_relation_missing", "elements", "row.owner.kind IN ('component', 'shared_component') AND f IS NOT NULL AND NOT row.says_parent", "owner.ref", to="element", ref="owner.ref"),
    Rule("component_path_differs", "elements", "row.owner.kind = 'component' AND f IS NOT NULL AND NOT f.featurePath <=> row.featurePath", "owner.ref", to="element", ref="owner.ref"),
    Rule("component_label_chain", "elements", "row.owner.kind = 'component' AND f IS NOT NULL AND NOT startswith(coalesce(row.label, ''), coalesce(f.label, '') || '-')", "owner.ref", to="element", ref="owner.ref"),
    Rule("shared_path_extension", "elements", "row.owner.kind = 'shared_component' AND f IS NOT NULL AND (size(coalesce(row.featurePath, array())) > 3 OR slice(coalesce(row.featurePath, array()), 1, size(coalesce(f.featurePath, array()))) <> coalesce(f.featurePath, array()))", "owner.ref", to="element", ref="owner.ref"),
    Rule("owner_chain", "elements", "terminal_state <> 'ok'", "terminal_state"),
    Rule("component_ends_elsewhere", "elements", "terminal_state = 'ok' AND owner.kind = 'component' AND NOT terminal_kind <=> 'page'", "terminal_ref"),
    Rule("component_end_missing", "elements", "row.terminal_state = 'ok' AND row.owner.kind = 'component' AND row.terminal_kind = 'page' AND f IS NULL", "terminal_ref", to="page", ref="terminal_ref"),
    Rule("shared_ends_elsewhere", "elements", "terminal_state = 'ok' AND owner.kind = 'shared_component' AND NOT terminal_kind <=> 'application'", "terminal_ref"),
    Rule("shared_end_missing", "elements", "row.terminal_state = 'ok' AND row.owner.kind = 'shared_component' AND row.terminal_kind = 'application' AND f IS NULL", "terminal_ref", to="application", ref="terminal_ref"),
    Rule("owner_relation_missing", "elements", "NOT says_owner", "owner.ref"),
    Rule("not_among_children", "elements", "row.owner.kind IN ('component', 'shared_component') AND f IS NULL", "owner.ref", to="child", ref="owner.ref || '>' || id", unless="owner_element_missing"),
    Rule("not_in_child_relations", "elements", "row.owner.kind IN ('component', 'shared_component') AND f IS NULL", "owner.ref", to="relation", ref="owner.ref || '>child:' || id", unless="owner_element_missing"),
]

ELEMENTS = [
    Rule("element_feature_path", "elements", "NOT coalesce(size(featurePath) BETWEEN 1 AND 3, false)"),
    _missing("available_page_missing", "elements", "page", "x", "availableOnPageRefs"),
    _missing("availability_not_reciprocal", "elements", "page element", "x || '>' || id", "availableOnPageRefs", detail="x", unless="available_page_missing"),
    Rule("parent_missing", "elements", "row.parentElementRef IS NOT NULL AND f IS NULL", "parentElementRef", to="element", ref="parentElementRef"),
    _missing("child_missing", "elements", "element", "x", "childElementRefs"),
    Rule("child_owner", "elements", "f IS NOT NULL AND NOT (row.terminal_state = 'ok' AND f.ownerRef <=> row.id AND f.ownerKind <=> CASE WHEN row.terminal_kind = 'page' THEN 'component' ELSE 'shared_component' END)", "x", "childElementRefs", "element"),
    Rule("child_parent", "elements", "f IS NOT NULL AND NOT f.parent <=> row.id", "x", "childElementRefs", "element"),
    Rule("child_relation_missing", "elements", "true", "substring(x, 7)", f"array_except(transform({_KIDS}, c -> 'child:' || c), {_RELATED})", unless="child_missing"),
    Rule("element_orphaned", "elements", f"size({_RELATED}) = 0"),
    Rule("element_without_status", "elements", "coalesce(status, '') = ''"),
    Rule("element_unobserved", "elements", "coalesce(size(observations), 0) < 1"),
    Rule("locator_incomplete", "elements", "coalesce(x.failed, false) OR x.rect IS NULL", "x.frameRef", "observations"),
]

COMPOSITIONS = [
    Rule("flat_setting_row", "elements", f"composition IS NULL AND owner.kind = 'page' AND role = 'setting' AND elementType IN {ROW_TYPES}"),
    Rule("roles_empty", "elements", "composition IS NOT NULL AND coalesce(size(roles), 0) < 1"),
    Rule("role_outside", "elements", "x <> id", "x", f"array_sort(array_except({_REFS}, {_KIDS}))"),
    Rule("children_without_role", "elements", "size(roles) > 0", "x", f"array_sort(array_except({_KIDS}, filter({_REFS}, r -> r <> id)))"),
    Rule("role_shared", "elements", f"size(roles) > 0 AND composition.profile IS NULL AND size(array_distinct({_REFS})) < size({_REFS})"),
    Rule("profile_unknown", "elements", "size(roles) > 0 AND composition.profile IS NOT NULL AND p IS NULL", "composition.profile"),
    Rule("role_missing", "elements", "true", "x", "CASE WHEN size(roles) > 0 THEN array_sort(array_except(p.required, map_keys(roles))) END"),
    Rule("role_unexpected", "elements", "true", "x", "array_sort(array_except(map_keys(roles), p.required || p.optional))"),
    Rule("role_is_container", "elements", "x.value = id AND NOT x.key <=> p.self_role", "x.key", f"CASE WHEN p IS NOT NULL THEN {_ROLE} END"),
    Rule("roles_incompatible", "elements", "size(x.keys) > 1 AND NOT coalesce(x.ref <> id AND x.keys = array_sort(array(p.lone_role, p.self_role)), false)", "array_join(x.keys, ',')",
         f"CASE WHEN p IS NOT NULL THEN transform(array_distinct({_REFS}), r -> named_struct('ref', r, 'keys', array_sort(map_keys(map_filter(roles, (k, v) -> v = r))))) END"),
    Rule("passive_role_capable", "elements", "f.capable", "x.key", f"filter({_ROLE}, x -> array_contains(p.passive, x.key))", "element", "x.value"),
    Rule("passive_role_actionable", "elements", "f IS NOT NULL AND NOT f.actionable <=> false", "x.key", f"filter({_ROLE}, x -> array_contains(p.passive, x.key))", "element", "x.value"),
    Rule("acting_role_incapable", "elements", "f IS NOT NULL AND NOT f.capable", "x.key", f"filter({_ROLE}, x -> array_contains(p.acting, x.key))", "element", "x.value"),
    Rule("acting_role_not_actionable", "elements", "f IS NOT NULL AND NOT f.actionable <=> true", "x.key", f"filter({_ROLE}, x -> array_contains(p.acting, x.key))", "element", "x.value"),
    Rule("lone_role_capable", "elements", "f.capable", "x.key", f"filter({_ROLE}, x -> x.key = p.lone_role AND NOT x.value <=> roles[p.self_role])", "element", "x.value"),
    Rule("lone_role_actionable", "elements", "f IS NOT NULL AND NOT f.actionable <=> false", "x.key", f"filter({_ROLE}, x -> x.key = p.lone_role AND NOT x.value <=> roles[p.self_role])", "element", "x.value"),
    Rule("container_capable", "elements", f"p IS NOT NULL AND size(roles) > 0 AND NOT {_SELF} AND size(coalesce(capabilities, array())) > 0"),
    Rule("container_actionable", "elements", f"p IS NOT NULL AND size(roles) > 0 AND NOT {_SELF} AND NOT actionable <=> false"),
]


def _triggers(table: str, kind: str) -> list[Rule]:
    """What a trigger of an edge must be."""
    trigger = {"to": "element", "ref": "triggerElementRef"}
    return [
        Rule(f"{kind}_trigger_missing", table, "f IS NULL", "triggerElementRef", **trigger),
        Rule(f"{kind}_trigger_passive", table, "f IS NOT NULL", "triggerElementRef", to="passive part", ref="triggerElementRef", unless=f"{kind}_trigger_missing"),
        Rule(f"{kind}_trigger_not_actionable", table, "f IS NOT NULL AND NOT f.actionable <=> true", "triggerElementRef", **trigger),
        Rule(f"{kind}_capability_not_owned", table, "f IS NULL", "triggerElementRef", to="capability", ref="triggerElementRef || '>' || coalesce(capability, '')", unless=f"{kind}_trigger_missing"),
        Rule(f"{kind}_not_on_trigger", table, "f IS NULL", "triggerElementRef", to="relation", ref=f"triggerElementRef || '>{'transition' if kind == 'transition' else 'authority_contract'}:' || id", unless=f"{kind}_trigger_missing"),
    ]


TRANSITIONS = [
    _missing("source_missing", "transitions", "page", "sourceRef"),
    _missing("target_missing", "transitions", "page", "targetRef"),
    *_triggers("transitions", "transition"),
    Rule("trigger_not_available", "transitions", "f IS NULL AND row.sourceRef IS NOT NULL", "triggerElementRef", to="available", ref="triggerElementRef || '>' || sourceRef", unless="transition_trigger_missing"),
    Rule("evidence_not_passed", "transitions", "NOT evidence.postcondition <=> 'pass' OR coalesce(evidence.actionTraceRef, '') = ''"),
    Rule("not_among_outbound", "transitions", "f IS NULL AND row.sourceRef IS NOT NULL", "sourceRef", to="outbound", ref="sourceRef || '>' || id", unless="source_missing"),
    Rule("not_among_inbound", "transitions", "f IS NULL AND row.targetRef IS NOT NULL", "targetRef", to="inbound", ref="targetRef || '>' || id", unless="target_missing"),
]

CONTRACTS = [
    Rule("selector_kind", "contracts", "NOT coalesce(sourceSelector.kind IN ('exact_page', 'shared_availability'), false)", "sourceSelector.kind"),
    Rule("exact_source_missing", "contracts", "row.sourceSelector.kind = 'exact_page' AND f IS NULL", "sourceSelector.ref", to="page", ref="sourceSelector.ref"),
    Rule("shared_source_missing", "contracts", "row.sourceSelector.kind = 'shared_availability' AND (f IS NULL OR NOT f.ownerKind <=> 'application')", "sourceSelector.ref", to="element", ref="sourceSelector.ref"),
    Rule("shared_source_nowhere", "contracts", "row.sourceSelector.kind = 'shared_availability' AND f IS NULL", "sourceSelector.ref", to="scope", ref="id", unless="shared_source_missing"),
    Rule("edge_kind", "contracts", "NOT edgeKind <=> 'authority_contract'", "edgeKind"),
    Rule("contract_target", "contracts", "NOT row.expectedTarget.kind <=> 'page' OR f IS NULL", "expectedTarget.ref", to="page", ref="expectedTarget.ref"),
    *_triggers("contracts", "contract"),
    Rule("contract_trigger_not_available", "scopes", "row.known AND f IS NULL", "page", to="available", ref="triggerElementRef || '>' || page"),
    Rule("contract_source_type", "contracts", "NOT sourceType <=> 'user_context'", "sourceType"),
    Rule("not_certified", "contracts", "NOT authorityStatus <=> 'authority_certified'", "authorityStatus"),
    Rule("evidence_state", "contracts", f"NOT coalesce(runtimeEvidenceStatus IN {EVIDENCE_STATES}, false)", "runtimeEvidenceStatus"),
    Rule("verified_without_transition", "contracts", "row.runtimeEvidenceStatus = 'verified' AND f IS NULL", "verifiedTransitionRef", to="transition", ref="verifiedTransitionRef"),
    Rule("verified_otherwise", "contracts", "row.runtimeEvidenceStatus = 'verified' AND f IS NOT NULL AND NOT (f.trigger <=> row.triggerElementRef AND f.capability <=> row.capability AND f.target <=> row.expectedTarget.ref)", "verifiedTransitionRef", to="transition", ref="verifiedTransitionRef"),
    _missing("verified_elsewhere", "verified", "scope page", "id || '>' || coalesce(sourceRef, '')", detail="sourceRef"),
    Rule("contradicted_without_defect", "contracts", "runtimeEvidenceStatus = 'contradicted' AND coalesce(defectRef, '') = ''"),
]

RULES = [*GRAPH, *PAGES, *OWNERS, *ELEMENTS, *COMPOSITIONS, *TRANSITIONS, *CONTRACTS]

_RECORD = ("entity",)
FACTS = [
    Facts("applications", (*_RECORD, "application")),
    Facts("applications", ("key",), "key"),
    Facts("applications", ("all applications",), "'*'"),
    Facts("manifest", edges=(("manifest", "entityIds"),)),
    Facts("pages", (*_RECORD, "page"), columns=(("label", "label"), ("featurePath", "featurePath")), edges=(
        ("key", "array(key)"), ("page element", "transform(elementRefs, x -> id || '>' || x)"), ("inbound", "transform(inboundTransitionRefs, x -> id || '>' || x)"), ("outbound", "transform(outboundTransitionRefs, x -> id || '>' || x)"))),
    Facts("elements", (*_RECORD, "element"),
        columns=(("label", "label"), ("featurePath", "featurePath"), ("ownerKind", "owner.kind"), ("ownerRef", "owner.ref"), ("parent", "parentElementRef"), ("actionable", "actionable"), ("capable", "size(coalesce(capabilities, array())) > 0")),
        edges=(("key", "array(key)"), ("element key", "array(key)"), ("child", "transform(childElementRefs, x -> id || '>' || x)"), ("relation", "transform(relationshipRefs, x -> id || '>' || x)"), ("capability", "transform(capabilities, x -> id || '>' || x)"),
            ("on page", "CASE owner.kind WHEN 'page' THEN array(id || '>' || owner.ref) WHEN 'application' THEN transform(availableOnPageRefs, x -> id || '>' || x) END"),
            ("passive part", f"transform(filter({_ROLE}, x -> array_contains(p.passive, x.key) OR (x.key = p.lone_role AND NOT x.value <=> roles[p.self_role])), x -> x.value)"))),
    Facts("transitions", (*_RECORD, "transition"), columns=(("target", "targetRef"), ("trigger", "triggerElementRef"), ("capability", "capability")),
        edges=(("key", "array(key)"), ("arrives", "array(id || '>' || targetRef)"), ("leaves", "array(id || '>' || sourceRef)"))),
    Facts("contracts", _RECORD, edges=(("key", "array(key)"), ("contract arrives", "array(id || '>' || expectedTarget.ref)"), ("contract leaves", "array(id || '>' || sourceSelector.ref)"))),
    Facts("available", edges=(("available", "array(element || '>' || page)"),)),
    Facts("scopes", edges=(("scope", "array(id)"), ("scope page", "array(id || '>' || page)"))),
]

SUBJECTS = {"applications": "key", "manifest": "'manifest'", "pages": "key", "elements": "key", "transitions": "key", "contracts": "key", "scopes": "key", "verified": "key"}
CARRIES = {
    "scopes": ["known"],
    "elements": ["id", "owner", "label", "featurePath", "sourceType", "parentElementRef", "terminal_state", "terminal_kind", "terminal_ref", "says_parent"],
    "transitions": ["sourceRef", "targetRef"],
    "contracts": ["sourceSelector", "expectedTarget", "triggerElementRef", "capability", "runtimeEvidenceStatus"],
}


def completed(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables with all columns: absent tables are empty, absent columns null."""

    def whole(name: str, shape: str) -> DataFrame:
        empty = spark.createDataFrame([], shape)
        given = tables.get(name, empty)
        return given.select(*[(F.col(c.name) if c.name in given.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in empty.schema])

    return {name: whole(name, shape) for name, shape in TABLES.items()}


def with_ends(elements: DataFrame, keep: Keep) -> DataFrame:
    """elements with what the rules need besides: where the chain of owners ends, whether the relations say owner and parent, the roles and the rules of the profile `p`."""
    spark, part = elements.sparkSession, F.col("owner.kind").isin("component", "shared_component")
    up = F.when(part, F.col("owner.ref"))
    ends = terminal_owner(elements.select(F.col("id").alias("node"), up.alias("parent")), keep)
    last = elements.select(F.col("id").alias("terminal"), F.col("owner.kind").alias("terminal_kind"), F.col("owner.ref").alias("terminal_ref"))
    found = ends.join(last.hint("merge"), "terminal", "left").select(F.col("node").alias("id"), F.when(F.col("state") == "root", "ok").otherwise(F.col("state")).alias("terminal_state"), "terminal_kind", "terminal_ref")
    profiles = spark.createDataFrame(PROFILES, "profile string, required array<string>, optional array<string>, acting array<string>, passive array<string>, self_role string, lone_role string")
    rows = elements.join(found.hint("merge"), "id", "left").join(F.broadcast(profiles.select(F.col("profile").alias("__profile"), F.struct("*").alias("p"))), F.col("composition.profile") == F.col("__profile"), "left").drop("__profile")  # a row for each profile above
    says = lambda prefix: F.coalesce(F.array_contains("relationshipRefs", F.concat(F.lit(prefix), F.col("owner.ref"))), F.lit(False))
    return rows.withColumns({"roles": F.col("composition.roles"), "says_owner": says("owner:"), "says_parent": says("parent:")})


def shared_places(elements: DataFrame) -> DataFrame:
    """(rule, subject, detail): containers whose members, themselves included, are seen at one place of a frame, or in one picture: `locator_reused`, `picture_reused`."""
    members = elements.where("size(composition.roles) > 0").select(F.col("key").alias("subject"), F.explode(F.array_distinct(F.concat(F.array("id"), F.coalesce("childElementRefs", F.array().cast("array<string>"))))).alias("id"))
    seen = elements.select("id", "key", F.explode("observations").alias("o")).where("o.frameRef IS NOT NULL")
    place = lambda rule, c: F.struct(F.lit(rule).alias("rule"), F.concat_ws("@", c, "o.frameRef").alias("detail"), c.alias("at"))
    at = seen.select("id", "key", F.explode(F.array(place("locator_reused", F.col("o.rect")), place("picture_reused", F.col("o.redboxRef")))).alias("p")).where("p.at IS NOT NULL").select("id", "key", "p.rule", "p.detail")
    return members.join(at, "id").groupBy("rule", "subject", "detail").agg(F.count_distinct("key").alias("n")).where("n > 1").drop("n")


def graph_errors(tables: dict[str, DataFrame], keep: Keep, rules: list[Rule] = RULES) -> DataFrame:
    """(rule, subject, detail): all that is wrong with a graph. See the module for the tables. Facts and availability that no rule looks up are not gathered."""
    elements = keep(with_ends(tables["elements"], keep), "elements")
    listed = F.concat(F.coalesce("availableOnPageRefs", F.array().cast("array<string>")), F.when(F.col("owner.kind") == "page", F.array("owner.ref")).otherwise(F.array().cast("array<string>")))
    chain = elements.select(F.col("id").alias("element"), F.when(F.expr(_PARTS), F.col("owner.ref")).alias("parent"), F.col("owner.kind").alias("owner_kind"), F.lit(None).cast("string").alias("page"), listed.alias("pages"))
    contracts = tables["contracts"]
    exact = contracts.where("sourceSelector.kind = 'exact_page'").join(tables["pages"].select("id").withColumnRenamed("id", "page"), F.col("sourceSelector.ref") == F.col("page")).select("id", "key", "triggerElementRef", "page")
    sources = elements.where("owner.kind = 'application'").select(F.col("id").alias("__source"), F.explode("availableOnPageRefs").alias("page")).join(tables["pages"].select(F.col("id").alias("page")), "page", "left_semi")
    wide = contracts.where("sourceSelector.kind = 'shared_availability'").join(sources, F.col("sourceSelector.ref") == F.col("__source")).select("id", "key", "triggerElementRef", "page")
    known = elements.select(F.col("id").alias("triggerElementRef"), F.lit(True).alias("known"))
    scopes = keep(exact.unionByName(wide).join(known, "triggerElementRef", "left"), "scopes")
    verified = contracts.where("runtimeEvidenceStatus = 'verified'").select("id", "key", F.col("verifiedTransitionRef").alias("__t")).join(tables["transitions"].select(F.col("id").alias("__t"), "sourceRef"), "__t")
    given = {**tables, "verified": verified, "elements": elements, "scopes": scopes}
    facts = looked_up(FACTS, rules)
    if any(f.table == "available" for f in facts):
        given["available"] = keep(availability(chain, keep), "available")
    found = violations_of([r for r in rules if r.table in given], given, SUBJECTS, CARRIES, facts_table(facts, given))
    return found.unionByName(shared_places(elements))
