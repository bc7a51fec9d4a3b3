import json

import pytest
from pyspark.sql import functions as F

from lattika.plans import drafts, project_graph, route, versions
from lattika.operators.rounds import keep

KNOWLEDGE = "struct<origin:string,reviewStatus:string,validationStatus:string,confidence:double,evidenceRefs:array<string>>"
RECORD = f"recordKind string, id string, entityType string, projectRef string, key string, label string, summary string, lifecycleStatus string, attributes string, knowledge {KNOWLEDGE}, uri string, capturedAt string, subjectRef string, payload string, evidenceRefs array<string>"
RELATION = f"id string, relationType string, projectRef string, sourceRef string, targetRef string, knowledge {KNOWLEDGE}"
GOOD = ("manual", "confirmed", "observed", 0.5, [])
CORE = {
    "entityTypes": {"Page": {}, "Element": {}},
    "relationTypes": {"contains": {"sourceTypes": ["*"], "targetTypes": ["*"]}, "shows": {"sourceTypes": ["Page"], "targetTypes": ["Element"]}},
    "optionSets": {"risk": {"options": [{"value": "low", "label": "Low"}, {"value": "old", "label": "Old", "status": "retired"}]}},
    "fields": [
        {"key": "risk", "appliesTo": ["Element"], "valueType": "option", "optionSetRef": "risk", "required": True},
        {"key": "size", "appliesTo": ["Element"], "valueType": "integer"},
        {"key": "tags", "appliesTo": ["Page"], "valueType": "multi_option"},
        {"key": "open", "appliesTo": ["Page"], "valueType": "boolean", "required": True, "defaultValue": True},
    ],
}
PROJECT = {"optionSets": {"risk": {"addOptions": [{"value": "high", "label": "High"}]}}, "fields": [{"key": "size", "valueType": "number"}]}


def entity(id_, kind, attributes, knowledge=GOOD, project="project:x", label="l"):
    return ("Entity", id_, kind, project, "k", label, "s", "active", json.dumps(attributes) if attributes is not None else None, knowledge, None, None, None, None, None)


def other(kind, id_, **v):
    return (kind, id_, None, "project:x", None, None, None, None, None, v.get("knowledge"), v.get("uri"), v.get("capturedAt"), v.get("subjectRef"), v.get("payload"), v.get("evidenceRefs"))


def errors(spark, records, relations, core=CORE, project=PROJECT):
    model = project_graph.merged_model(spark, core, project)
    found = project_graph.graph_errors(spark.createDataFrame(records, RECORD), spark.createDataFrame(relations, RELATION), model, keep, "project:x")
    return {(r.rule, r.subject, r.detail) for r in found.collect()}


BASE = [
    entity("page:a", "Page", {"tags": ["x"], "open": False}),
    entity("page:b", "Page", {}),
    entity("element:e", "Element", {"risk": "high", "size": 1.5}),
    other("Evidence", "evidence:1", uri="u", capturedAt="t"),
    other("Observation", "observation:1", subjectRef="page:a", payload=json.dumps({"elements": [{"elementRef": "element:e"}]}), evidenceRefs=["evidence:1"]),
]
EDGES = [("relation:1", "contains", "project:x", "page:a", "page:b", GOOD), ("relation:2", "shows", "project:x", "page:a", "element:e", GOOD)]


def test_a_valid_graph_has_no_errors(spark):
    assert errors(spark, BASE, EDGES) == set()


def test_every_rule_finds_its_violation(spark):
    records = BASE + [
        entity("page:a", "Page", {}),
        entity("Bad id", "Page", {}),
        entity("page:c", "Ghost", {}),
        entity("page:d", "Page", None),
        entity("page:e", "Page", {"other": 1, "tags": [1], "open": "yes"}),
        entity("page:f", "Page", {}, project="project:y"),
        entity("page:g", "Page", {}, label=None),
        entity("element:f", "Element", {"risk": "old"}),
        entity("element:g", "Element", {}),
        entity("page:h", "Page", {}, knowledge=None),
        entity("page:i", "Page", {}, knowledge=("magic", "confirmed", "runtime_verified", 1.5, None)),
        entity("page:j", "Page", {}, knowledge=("manual", "pending", "observed", None, ["evidence:9"])),
        other("Evidence", "evidence:2", uri="", capturedAt="t"),
        other("Observation", "observation:2", subjectRef="page:z", payload=json.dumps({"elements": [{"elementRef": "element:z"}]})),
        other("Riddle", "riddle:1"),
    ]
    edges = EDGES + [
        ("relation:3", "contains", "project:x", "page:b", "page:a", GOOD),
        ("relation:4", "contains", "project:x", "element:e", "page:b", GOOD),
        ("relation:5", "shows", "project:x", "element:e", "page:z", GOOD),
        ("relation:6", "hides", "project:x", "page:a", "page:b", GOOD),
    ]
    want = {
        ("id_duplicate", "page:a", "2"), ("id_invalid", "Bad id", "Entity"), ("entity_type_unknown", "page:c", "Ghost"), ("attributes_not_object", "page:d", "attributes"),
        ("attribute_undeclared", "page:e", "other"), ("attribute_type", "page:e", "tags"), ("attribute_type", "page:e", "open"), ("project_differs", "page:f", "project:y"),
        ("field_missing", "page:g", "label"), ("option_unknown", "element:f", "risk=old"), ("attribute_missing", "element:g", "risk"),
        ("field_missing", "page:h", "knowledge"), ("knowledge_missing", "page:h", "knowledge"), ("knowledge_origin", "page:i", "magic"), ("knowledge_confidence", "page:i", "1.5"), ("knowledge_evidence", "page:i", "evidenceRefs"),
        ("verified_without_evidence", "page:i", "evidenceRefs"), ("evidence_unresolved", "page:j", "evidence:9"), ("evidence_incomplete", "evidence:2", "uri, capturedAt"),
        ("subject_unresolved", "observation:2", "page:z"), ("element_unresolved", "observation:2", "element:z"), ("kind_unknown", "riddle:1", "Riddle"),
        ("several_parents", "page:b", "element:e,page:a"), ("containment_cycle", "page:a", "contains"), ("containment_cycle", "page:b", "contains"),
        ("source_type", "relation:5", "Element"), ("target_unresolved", "relation:5", "page:z"), ("relation_type_unknown", "relation:6", "hides"),
    }
    assert errors(spark, records, edges) == want


def test_options_and_items(spark):
    """A set without active options allows none; items of a list have fields of their own."""
    core = CORE | {
        "optionSets": {"risk": {"options": [{"value": "old", "label": "Old", "status": "retired"}]}},
        "fields": [{"key": "risk", "appliesTo": ["Element"], "valueType": "option", "optionSetRef": "risk"}, {"key": "rows", "appliesTo": ["Element"], "valueType": "object_list", "itemFields": [{"key": "n", "valueType": "integer", "required": True}, {"key": "t", "valueType": "string"}]}],
    }
    records = [entity("element:a", "Element", {"risk": "old"}), entity("element:b", "Element", {"rows": [{"n": 1, "t": "x"}, {"t": 2}, {"n": "1"}]})]
    found = errors(spark, records, [], core, {})
    assert found == {("option_unknown", "element:a", "risk=old"), ("item_missing", "element:b", "rows[1].n"), ("item_type", "element:b", "rows[1].t"), ("item_type", "element:b", "rows[2].n")}


def test_several_graphs_are_not_held_against_one(spark):
    model = project_graph.merged_model(spark, CORE, PROJECT)
    records = spark.createDataFrame([entity("page:a", "Page", {}), entity("page:b", "Page", {}, project="project:y")], RECORD)
    assert project_graph.graph_errors(records, spark.createDataFrame([], RELATION), model, keep).isEmpty()


def test_model_errors(spark):
    core = {"entityTypes": {"A": {}}, "relationTypes": {"r": {"sourceTypes": ["B"], "targetTypes": ["*"]}}, "optionSets": {"o": {"options": [{"value": "v", "label": "x"}, {"value": "v", "label": ""}]}}, "fields": [{"key": "f", "appliesTo": ["C"], "valueType": "magic", "optionSetRef": "none"}]}
    found = project_graph.model_errors(project_graph.merged_model(spark, core, {}))
    assert {(r.rule, r.detail) for r in found.collect()} == {("option_incomplete", "o"), ("option_duplicate", "o=v"), ("field_type_unsupported", "f"), ("field_applies_to_unknown", "f"), ("field_option_set_unknown", "f"), ("relation_type_unknown", "r.sourceTypes")}


TRANSITION = "key string, sourceRef string, targetRef string, triggerElementRef string, risk string, evidence struct<actionTraceRef:string,beforeFrameRef:string,afterFrameRef:string,postcondition:string>"
CONTRACT = "key string, edgeKind string, authorityStatus string, planningEligible boolean, runtimeEvidenceStatus string, sourceSelector struct<kind:string,ref:string>, expectedTarget struct<kind:string,ref:string>, triggerElementRef string, risk string"
PASS = ("t", "f", "g", "pass")


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame([("page:1", "root"), ("page:2", "follow"), ("page:3", "settings"), ("page:4", "people")], "id string, key string")
    elements = spark.createDataFrame([("element:1", ("application", "app"), ["page:1", "page:4"])], "id string, owner struct<kind:string,ref:string>, availableOnPageRefs array<string>")
    transitions = spark.createDataFrame([("root.open", "page:1", "page:2", "element:1", "high", PASS), ("follow.settings", "page:2", "page:3", "element:1", "safe", PASS), ("broken", "page:1", "page:3", "element:1", "safe", ("t", "", "g", "pass")), ("failed", "page:1", "page:3", "element:1", "safe", ("t", "f", "g", "fail"))], TRANSITION)
    yes = ("authority_contract", "authority_certified", True)
    contracts = spark.createDataFrame([("shared", *yes, None, ("shared_availability", "element:1"), ("page", "page:3"), "element:1", "critical"), ("no", *yes, "contradicted", ("exact_page", "page:1"), ("page", "page:3"), "element:1", "safe"), ("lost", *yes, "verified", ("exact_page", "page:9"), ("page", "page:8"), "element:7", "safe")], CONTRACT)
    return pages, elements, transitions, contracts


def test_routes(spark, site):
    pages, elements, transitions, contracts = site
    ask = spark.createDataFrame([("root", "settings"), ("page:1", "root"), ("settings", "root"), ("nowhere", "root"), ("people", "page:3")], "start string, goal string")
    found = {(r.start, r.goal): r for r in route.find_routes(ask, pages, route.edges(transitions, contracts, elements, "low-risk"), keep).collect()}
    assert found["root", "settings"].path == ["root.open", "follow.settings"] and found["root", "settings"].cost == 18
    assert (found["page:1", "root"].steps, found["page:1", "root"].path) == (0, [])
    assert found["settings", "root"].error == "No verified route" and found["nowhere", "root"].error == "start not found"
    assert found["people", "page:3"].path == ["shared"] and found["people", "page:3"].cost == 65
    short = route.find_routes(ask, pages, route.edges(transitions, contracts, elements, "shortest"), keep)
    assert {(r.start, r.goal): r.steps for r in short.collect()}["root", "settings"] == 1
    text = json.loads(route.as_document(short.where("start = 'people'")).first().value)
    assert text["route"] == [{"sequence": 1, "key": "shared"}]
    with pytest.raises(ValueError):
        route.edges(transitions, contracts, elements, "common")
    assert tuple(route.statistics(transitions, contracts).first()) == (4, 2, 3, 2, 3)
    assert {(r.rule, r.subject) for r in route.edge_errors(transitions, contracts, pages, elements).collect()} == {("selector_unresolved", "lost"), ("expected_target_unresolved", "lost"), ("contract_trigger_unresolved", "lost")}


ELEMENT = "id string, label string, candidateKey string, elementType string, bbox struct<x:double,y:double,width:double,height:double>, gridColumns int, gridRows int, gridRegion int, parentId string, ownerKind string, ownerRef string, pageId string, availableOnPageIds array<string>, capabilities array<string>, reviewStatus string, riskSignals array<string>"


def element(id_, key=None, parent=None, owner="page", page="p1", available=None, box=(0.1, 0.2, 0.2, 0.1), grid=(3, 6, 4), **v):
    return (id_, v.get("label", "L"), key or id_, v.get("kind", "image"), box, *grid, parent, owner, None, page, available, v.get("capabilities", ["tap"]), v.get("review", "accepted"), v.get("risk"))


def issues(spark, rows):
    return {(r.code, r.element) for r in drafts.draft_issues(spark.createDataFrame(rows, ELEMENT), ["image"], keep).collect()}


def test_draft_issues(spark):
    assert issues(spark, [element("a")]) == set()
    found = issues(spark, [element("a", parent="b", owner="component", box=(0.1, 0.2, 2.0, 0.1)), element("b", parent="a", owner="component")])
    assert found == {("bbox_invalid", "a"), ("grid_region_invalid", "a"), ("owner_cycle", "a"), ("owner_cycle", "b")}
    found = issues(spark, [element("a", key="k"), element("b", key=" k "), element("c", key="k", page="p2"), element("d", owner="application", page=None, available=["p2"], key="k")])
    assert found == {(f"candidate_key_duplicate_{w}_page", e) for e in "abcd" for w in ("current", "other")}
    found = issues(spark, [element("a", label=" ", kind="zzz", parent="gone", capabilities=[], review="pending", risk=["geometry-clamped-to-frame", "model-action-inconsistent"], grid=(1, 1, 2)), element("b", owner="component"), element("c", parent="c", owner="component", label="", review="rejected")])
    assert found == {(c, "a") for c in ("label_required", "element_type_required", "parent_missing", "nested_owner_kind", "capability_missing", "review_pending", "model_bbox_clamped", "model_action_inconsistent", "grid_region_invalid")} | {("root_owner_kind", "b"), ("parent_self", "c"), ("owner_cycle", "c")}
    grouped = drafts.grouped_issues(drafts.draft_issues(spark.createDataFrame([element("a", capabilities=[]), element("b", capabilities=[], label="")], ELEMENT), ["image"], keep)).collect()
    assert [(g.level, g.code, g.n) for g in grouped] == [("error", "label_required", 1), ("warning", "capability_missing", 2)]


def test_page_status(spark):
    pages = spark.createDataFrame([("p1", None), ("p2", None), ("p3", None), ("p4", "now")], "page string, publishedAt string")
    rows = spark.createDataFrame([element("a", page="p1", review="pending"), element("b", page="p2")], ELEMENT)
    assert {tuple(r) for r in drafts.page_status(pages, rows).collect()} == {("p1", "pending-review"), ("p2", "ready"), ("p3", "pending-recognition"), ("p4", "published")}


def test_versions(spark):
    active = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    files = spark.createDataFrame([("s1", "a", "2", "t1", 0), ("s1", "b", "1", "t1", 1), ("s2", "a", "3", "t2", 0), ("s2", "c", "1", "t2", 1), ("s3", "c", "1", "t3", 0)], "stageId string, path string, hash string, createdAt string, pos int")
    merged, conflicts = versions.merge_stages(files, active)
    assert {tuple(r) for r in merged.select("path", "hash", "stageId").collect()} == {("a", "3", "s2"), ("b", "1", None), ("c", "1", "s3")}
    assert [(r.path, r.previous, r.hash) for r in conflicts.collect()] == [("a", "2", "3")]
    assert {tuple(r) for r in versions.changes(active, merged).collect()} == {("a", "update"), ("c", "add"), ("manifest", "update")}
    assert [tuple(r) for r in versions.changes(active, merged.where("false")).collect()] == [("manifest", "update")]
    stages = spark.createDataFrame([("s1", "x", "draft", "R", "1", True), ("s2", "x", "draft", "old", "2", True), ("s3", "x", "published", "R", "3", True), ("s4", "x", "draft", "R", "4", False)], "stageId string, appKey string, status string, baseRootHash string, graphRevision string, valid boolean")
    now = spark.createDataFrame([("x", "3", "R")], "appKey string, graphRevision string, rootHash string")
    status = {r.stageId: (r.is_current, r.is_stale) for r in versions.stage_status(stages, now).collect()}
    assert status == {"s1": (False, False), "s2": (False, True), "s3": (True, False), "s4": (False, False)}
    after = lambda s: {r.stageId: r.status for r in versions.publish(stages, now, s).collect()}
    assert after("s1") == {"s1": "published", "s2": "draft", "s3": "archived", "s4": "draft"}
    assert after("s2") == after("s4") == {"s1": "draft", "s2": "draft", "s3": "published", "s4": "draft"}
    roots = [r.root_hash for r in versions.root_hashes(versions.rollback(files, "s1", "s9").unionByName(files.where("stageId = 's1'")), "stageId").collect()]
    assert len(roots) == 2 and roots[0] == roots[1]
