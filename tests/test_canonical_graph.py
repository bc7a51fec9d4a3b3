import copy

from lattika.operators.rounds import keep
from lattika.plans.canonical_graph import RULES, completed, graph_errors
from lattika.plans.canonical_graph import TABLES as SCHEMAS

def sound(g):
    """A graph without a fault: two pages, a setting row whose trigger leads from one to the other, and a shared bar with an entry."""

    def element(name, owner, children=(), capabilities=(), composition=None, available=(), path=("F",), **more):
        kind, ref = owner
        parent = ref if kind in ("component", "shared_component") else None
        related = [f"owner:{ref}", *([f"parent:{ref}"] if parent else []), *[f"child:{g}{c}" for c in children]]
        return {
            "id": g + name, "key": f"k.{g}{name}", "label": "", "status": "active", "role": "part", "elementType": "text", "featurePath": list(path), "owner": {"kind": kind, "ref": ref}, "parentElementRef": parent,
            "childElementRefs": [g + c for c in children], "relationshipRefs": related, "availableOnPageRefs": [g + p for p in available], "capabilities": list(capabilities), "actionable": bool(capabilities),
            "sourceType": "manual", "observations": [{"frameRef": g + "f1", "rect": f"{g}{name}", "failed": False, "redboxRef": f"{g}{name}.png"}], "composition": composition,
        } | more

    page = lambda name, elements, **refs: {"id": g + name, "key": f"k.{g}{name}", "label": "P", "featurePath": ["F"], "elementRefs": [g + e for e in elements], "frames": [g + "f1"], "states": [{"key": "s", "frameRefs": [g + "f1"]}]} | {f"{way}{kind}Refs": [g + r for r in refs.get(way + kind, [])] for way in ("inbound", "outbound") for kind in ("Transition", "Contract")}
    row = {"profile": "selector_row", "roles": {"label": g + "label", "currentValue": g + "value", "settingTrigger": g + "trigger"}}
    of_row = ("component", g + "row")
    elements = [
        element("row", ("page", g + "p1"), ("label", "value", "trigger"), composition=row, label="P-row"),
        element("label", of_row, label="P-row-label"), element("value", of_row, label="P-row-value"), element("trigger", of_row, capabilities=("tap",), label="P-row-go"),
        element("bar", ("application", "app"), ("entry",), available=("p1", "p2"), label="bar"),
        element("entry", ("shared_component", g + "bar"), capabilities=("tap",), path=("F", "sub"), label="bar-e"),
    ]
    elements[3]["relationshipRefs"] += [f"transition:{g}t", f"authority_contract:{g}c"]
    elements[5]["relationshipRefs"] += [f"authority_contract:{g}d"]
    contract = {"edgeKind": "authority_contract", "expectedTarget": {"kind": "page", "ref": g + "p2"}, "capability": "tap", "sourceType": "user_context", "authorityStatus": "authority_certified", "runtimeEvidenceStatus": "pending", "verifiedTransitionRef": None, "defectRef": None}
    return {
        "pages": [
            page("p1", ["row", "bar"], outboundTransition=["t"], outboundContract=["c"]),
            page("p2", ["bar"], inboundTransition=["t"], inboundContract=["c", "d"]),
        ],
        "elements": elements,
        "transitions": [{"id": g + "t", "key": f"k.{g}t", "sourceRef": g + "p1", "targetRef": g + "p2", "triggerElementRef": g + "trigger", "capability": "tap", "evidence": {"postcondition": "pass", "actionTraceRef": "trace"}}],
        "contracts": [
            {"id": g + "c", "key": f"k.{g}c", "sourceSelector": {"kind": "exact_page", "ref": g + "p1"}, "triggerElementRef": g + "trigger", **contract, "runtimeEvidenceStatus": "verified", "verifiedTransitionRef": g + "t"},
            {"id": g + "d", "key": f"k.{g}d", "sourceSelector": {"kind": "shared_availability", "ref": g + "bar"}, "triggerElementRef": g + "entry", **contract},
        ],
    }


P1, P2 = ("pages", 0), ("pages", 1)
ROW, LABEL, VALUE, TRIGGER, BAR, ENTRY = (("elements", i) for i in range(6))
T, C, D = ("transitions", 0), ("contracts", 0), ("contracts", 1)


def put(where, **values):
    """A fault: other values; a function of the old value and the graph's prefix, or the value itself, in which % is the prefix."""

    def change(graph, g):
        row = graph[where[0]][where[1]]
        for name, v in values.items():
            row[name] = v(row[name], g) if callable(v) else _named(v, g)

    return change


def _named(v, g):
    if isinstance(v, str):
        return v.replace("%", g)
    if isinstance(v, dict):
        return {k: _named(x, g) for k, x in v.items()}
    return [_named(x, g) for x in v] if isinstance(v, list) else v


def roles(profile="selector_row", **more):
    return {"profile": profile, "roles": {"label": "%label", "currentValue": "%value", "settingTrigger": "%trigger"} | more}


less = lambda gone: lambda old, g: [x for x in old if x != _named(gone, g)]
more = lambda new: lambda old, g: [*(old or []), _named(new, g)]

#: What is changed, and all that must be found then.
FAULTS = [
    ([], set()),
    ([put(P1, featurePath=[])], {"page_feature_path", "page_path_differs"}),
    ([put(P1, frames=None)], {"page_unobserved", "page_state_frames"}),
    ([put(P1, states=[{"key": "s", "frameRefs": ["%f1", "%f2"]}])], {"page_state_frames"}),
    ([put(P1, elementRefs=more("%gone"))], {"page_element_missing"}),
    ([put(P2, elementRefs=more("%label"))], {"page_element_not_available"}),
    ([put(P1, elementRefs=less("%row"))], {"page_lacks_element"}),
    ([put(P2, elementRefs=less("%bar"))], {"availability_not_reciprocal"}),
    ([put(P1, inboundTransitionRefs=more("%t"))], {"page_inbound_extra"}),
    ([put(P2, outboundTransitionRefs=more("%t"))], {"page_outbound_extra"}),
    ([put(P1, inboundContractRefs=more("%c"))], {"page_inbound_contract_extra"}),
    ([put(P2, outboundContractRefs=more("%gone"))], {"page_outbound_contract_extra"}),
    ([put(P1, outboundTransitionRefs=[])], {"not_among_outbound"}),
    ([put(P2, inboundTransitionRefs=None)], {"not_among_inbound"}),
    ([put(BAR, owner={"kind": "odd", "ref": "app"}, relationshipRefs=["owner:app", "child:%entry"])], {"owner_kind", "shared_ends_elsewhere", "page_element_not_available", "shared_source_missing"}),
    ([put(BAR, owner={"kind": "application", "ref": "%other"}, relationshipRefs=more("owner:%other"))], {"owner_application_missing", "shared_end_missing"}),
    ([put(ROW, owner={"kind": "page", "ref": "%gone"}, relationshipRefs=more("owner:%gone"))], {"owner_page_missing", "component_end_missing", "page_element_not_available", "trigger_not_available", "contract_trigger_not_available"}),
    ([put(LABEL, owner={"kind": "component", "ref": "%gone"}, parentElementRef="%gone", relationshipRefs=["owner:%gone", "parent:%gone"])], {"owner_element_missing", "parent_missing", "owner_chain", "child_owner", "child_parent"}),
    ([put(ROW, key="%row2"), put(ENTRY, owner={"kind": "shared_component", "ref": "%row2"}, relationshipRefs=more("owner:%row2"))], {"owner_element_missing", "owner_chain", "child_owner", "contract_trigger_not_available"}),
    ([put(VALUE, key="%bar")], {"owner_by_key"}),
    ([put(BAR, parentElementRef="%row")], {"owned_with_parent"}),
    ([put(ROW, sourceType="verified_legacy_midscene_evidence", label="row"), put(LABEL, label="row-"), put(VALUE, label="row-"), put(TRIGGER, label="row-")], {"page_label_chain"}),
    ([put(LABEL, parentElementRef="%value")], {"parent_not_owner", "child_parent"}),
    ([put(LABEL, relationshipRefs=less("parent:%row"))], {"parent_relation_missing"}),
    ([put(LABEL, featurePath=["G"])], {"component_path_differs"}),
    ([put(LABEL, label="row-x")], {"component_label_chain"}),
    ([put(ENTRY, featurePath=["sub", "F"])], {"shared_path_extension"}),
    ([put(ENTRY, featurePath=["F", "a", "b", "c"])], {"shared_path_extension", "element_feature_path"}),
    ([put(ENTRY, owner={"kind": "component", "ref": "%bar"}, featurePath=["F"])], {"component_ends_elsewhere", "child_owner"}),
    ([put(LABEL, owner={"kind": "shared_component", "ref": "%row"})], {"shared_ends_elsewhere", "child_owner"}),
    ([put(LABEL, relationshipRefs=less("owner:%row"))], {"owner_relation_missing"}),
    ([put(ENTRY, relationshipRefs=[])], {"owner_relation_missing", "parent_relation_missing", "element_orphaned", "contract_not_on_trigger"}),
    ([put(BAR, childElementRefs=[])], {"not_among_children"}),
    ([put(BAR, relationshipRefs=less("child:%entry"))], {"not_in_child_relations", "child_relation_missing"}),
    ([put(BAR, availableOnPageRefs=more("%gone"))], {"available_page_missing"}),
    ([put(BAR, childElementRefs=more("%gone"))], {"child_missing"}),
    ([put(BAR, status="")], {"element_without_status"}),
    ([put(ENTRY, observations=[])], {"element_unobserved"}),
    ([put(ENTRY, observations=[{"frameRef": "%f1", "rect": "r", "failed": True, "redboxRef": None}])], {"locator_incomplete"}),
    ([put(BAR, role="setting", elementType="toggle")], set()),
    ([put(ROW, composition=None, role="setting", elementType="toggle")], {"flat_setting_row"}),
    ([put(ROW, composition={"profile": "selector_row", "roles": {}})], {"roles_empty"}),
    ([put(ROW, composition=roles(secondaryText="%entry"))], {"role_outside", "passive_role_capable", "passive_role_actionable", "contract_trigger_passive"}),
    ([put(ROW, composition={"profile": None, "roles": {"a": "%label", "b": "%value"}})], {"children_without_role"}),
    ([put(ROW, composition={"profile": None, "roles": {"a": "%label", "b": "%value", "c": "%trigger", "d": "%value"}})], {"role_shared"}),
    ([put(ROW, composition=roles("odd"))], {"profile_unknown"}),
    ([put(ROW, composition={"profile": "selector_row", "roles": {"label": "%label", "secondaryText": "%value", "settingTrigger": "%trigger"}})], {"role_missing"}),
    ([put(ROW, composition=roles(extra="%label"))], {"role_unexpected", "roles_incompatible"}),
    ([put(ROW, composition=roles(secondaryText="%row"))], {"role_is_container"}),
    ([put(ROW, composition=roles(affordance="%trigger"))], set()),
    ([put(ROW, composition=roles(affordance="%label"))], {"roles_incompatible"}),
    ([put(LABEL, capabilities=["tap"], actionable=None)], {"passive_role_capable", "passive_role_actionable"}),
    ([put(TRIGGER, capabilities=[], actionable=False)], {"acting_role_incapable", "acting_role_not_actionable", "transition_trigger_not_actionable", "transition_capability_not_owned", "contract_trigger_not_actionable", "contract_capability_not_owned"}),
    ([put(ROW, composition={"profile": "selector_row", "roles": {"label": "%label", "currentValue": "%value", "settingTrigger": "%row", "affordance": "%trigger"}}, capabilities=["tap"], actionable=True)],
        {"lone_role_capable", "lone_role_actionable", "transition_trigger_passive", "contract_trigger_passive"}),
    ([put(ROW, capabilities=["tap"], actionable=True)], {"container_capable", "container_actionable"}),
    ([put(LABEL, observations=[{"frameRef": "%f1", "rect": "%value", "failed": False, "redboxRef": "%row.png"}])], {"locator_reused", "picture_reused"}),
    ([put(T, sourceRef="%gone"), put(P1, outboundTransitionRefs=[])], {"source_missing", "trigger_not_available", "verified_elsewhere"}),
    ([put(T, targetRef="%gone"), put(P2, inboundTransitionRefs=[])], {"target_missing", "verified_otherwise"}),
    ([put(T, triggerElementRef="%gone")], {"transition_trigger_missing", "verified_otherwise"}),
    ([put(T, evidence={"postcondition": "pass", "actionTraceRef": ""})], {"evidence_not_passed"}),
    ([put(TRIGGER, relationshipRefs=less("transition:%t"))], {"transition_not_on_trigger"}),
    ([put(T, capability="drag")], {"transition_capability_not_owned", "verified_otherwise"}),
    ([put(C, sourceSelector={"kind": "some_page", "ref": "%p1"})], {"selector_kind", "verified_elsewhere"}),
    ([put(C, sourceSelector={"kind": "exact_page", "ref": "%gone"}), put(P1, outboundContractRefs=[])], {"exact_source_missing", "verified_elsewhere"}),
    ([put(D, sourceSelector={"kind": "shared_availability", "ref": "%row"})], {"shared_source_missing"}),
    ([put(BAR, availableOnPageRefs=[]), put(P1, elementRefs=less("%bar")), put(P2, elementRefs=[])], {"shared_source_nowhere"}),
    ([put(D, edgeKind="edge")], {"edge_kind"}),
    ([put(D, expectedTarget={"kind": "page", "ref": "%gone"}), put(P2, inboundContractRefs=less("%d"))], {"contract_target"}),
    ([put(D, triggerElementRef="%gone")], {"contract_trigger_missing"}),
    ([put(D, triggerElementRef="%trigger"), put(TRIGGER, relationshipRefs=more("authority_contract:%d"))], {"contract_trigger_not_available"}),
    ([put(D, sourceType=None)], {"contract_source_type"}),
    ([put(D, authorityStatus="no")], {"not_certified"}),
    ([put(D, runtimeEvidenceStatus="new")], {"evidence_state"}),
    ([put(C, verifiedTransitionRef="%gone")], {"verified_without_transition"}),
    ([put(D, runtimeEvidenceStatus="contradicted")], {"contradicted_without_defect"}),
    ([put(LABEL, key="k.%value")], {"element_key_repeated"}),
    ([put(ENTRY, key="k.%p1")], {"element_key_repeated", "page_key_repeated"}),
]


def test_every_fault_is_found_and_nothing_else(spark):
    rows = {name: [] for name in SCHEMAS} | {"applications": [{"id": "app", "key": "k.app"}]}
    ids = ["app", "only in the manifest"]
    for i, (changes, _) in enumerate(FAULTS):
        graph = copy.deepcopy(sound(f"g{i}_"))
        for change in changes:
            change(graph, f"g{i}_")
        for name, found in graph.items():
            rows[name] += found
            ids += [r["id"] for r in found]
    ids.remove("g0_label")
    rows["manifest"] = [{"entityIds": ids, "graphRevision": None}]
    tables = {name: spark.createDataFrame([tuple(r.get(c) for c in spark.createDataFrame([], SCHEMAS[name]).columns) for r in rows[name]], SCHEMAS[name]) for name in SCHEMAS}
    errors = graph_errors(tables, keep)
    found = {}
    owner = {r["key"]: int(r["id"][1:].split("_")[0]) for n in ("pages", "elements", "transitions", "contracts") for r in rows[n]}
    for r in errors.collect():
        found.setdefault(owner.get(r.subject, r.subject), set()).add(r.rule)
    assert found.pop("manifest") == {"manifest_extra", "revision_missing"} and found.pop(0) == {"element_not_in_manifest"}
    differing = {i: (sorted(found.get(i, set()) - want), sorted(want - found.get(i, set()))) for i, (_, want) in enumerate(FAULTS) if found.get(i, set()) != want}
    assert differing == {}
    reached = set().union(*(w for _, w in FAULTS)) | {"manifest_extra", "revision_missing", "element_not_in_manifest"}
    assert len(RULES) >= 75 and {r.code for r in RULES if not r.code.endswith(("_id_repeated", "_key_repeated", "_not_in_manifest"))} - reached == {"application_count"}
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") < 30


def test_two_applications_and_none(spark):
    none = completed(spark, {})
    manifest = spark.createDataFrame([([], "r")], SCHEMAS["manifest"])
    for rows, want in (([], {("application_count", "manifest")}), ([("a", "k"), ("b", "l")], {("application_count", "manifest"), ("application_not_in_manifest", "k"), ("application_not_in_manifest", "l")})):
        tables = none | {"manifest": manifest, "applications": spark.createDataFrame(rows, SCHEMAS["applications"])}
        assert {(r.rule, r.subject) for r in graph_errors(tables, keep).collect()} == want
