"""Recognition answers, contracts and draft shaping on hand-made rows."""

import json

from pyspark.sql import functions as F

from lattika.operators import evidence
from lattika.plans import contracts, drafts, recognition
from lattika.operators.rounds import keep


def answers(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(rows)], "id int, element string")


def test_meaning_keeps_what_it_cannot_read(spark):
    odd = {
        "status": "known", "description": None, "basis": "b", "mood": 1, "riskSignals": ["r"], "confidence": "high",
        "evidence": {"visibleTexts": "one", "visibleIcons": {"a": 1}, "visibleStates": [" on ", "on", 4], "userContext": 7, "unclassified": [{"type": " t ", "detail": "d"}, {"type": ""}, {"type": "t", "detail": "d"}], "extra": None},
    }
    found = recognition.normalized(answers(spark, {"meaning": odd, "confidence": 0.5, "riskSignals": ["q"]}), ["image"], {}).first()
    m = found.meaning
    assert (m.status, m.description, m.user_context) == ("known", None, None)
    assert m.evidence == {"visibleTexts": ["one"], "visibleIcons": [], "visibleStates": ["on"], "visualCues": []}
    assert [(n.type, n.detail) for n in m.unclassified] == [
        ("visibleIcons-invalid", '{"a":1}'), ("visibleStates-invalid", "4"), ("userContext-invalid", "7"), ("t", "d"), ("unclassified-invalid", '{"type":""}'), ("extra", None), ("model-basis", "b"),
        ("meaning.confidence", "high"), ("meaning.mood", "1"),
    ]
    assert found.risk_signals == ["q", "r", "meaning-evidence-needs-review"] and found.confidence == 0.5 and "riskSignals is moved up" in found.issues


def test_weak_and_missing_meanings(spark):
    rows = recognition.normalized(answers(spark, {"meaning": {"status": "known", "description": 1, "evidence": {"x": 1}}}, {}, "no json", "[1]"), ["image"], {}).orderBy("id").collect()
    assert rows[0].meaning.status == "candidate" and rows[0].meaning.description is None and "description is unreadable" in rows[0].issues
    assert rows[1].meaning.status == "unknown" and rows[1].candidate_key is None and rows[1].element_type is None
    assert rows[2].meaning is None and rows[3].issues is None
    assert recognition.normalized(answers(spark).where("false"), [], {}).count() == 0


def test_comparisons(spark):
    rows = [("not-requested", '["a"]'), ("done", '["a",{"x":1}]'), ("done", "[]"), (None, '[{"x":1}]')]
    df = spark.createDataFrame(rows, "status string, c string").withColumn("c", F.try_variant_get(F.parse_json("c"), "$", "array<variant>"))
    found = df.select(recognition.normalized_comparison(F.col("status"), F.col("c")).alias("r")).select(F.to_json("r.changes").alias("changes"), "r.repaired").collect()
    assert [(r.changes, r.repaired) for r in found] == [("[]", True), ('[{"summary":"a"},{"x":1}]', True), ("[]", False), ('[{"x":1}]', False)]


def test_failures_and_implementations(spark):
    df = spark.createDataFrame([("AssertionError", None), ("E", "assertion failed: x"), ("E", "other"), (None, None)], "n string, m string")
    assert [r.s for r in df.select(recognition.failure_status(F.col("n"), F.col("m")).alias("s")).collect()] == ["fail", "fail", "unknown", "unknown"]
    nodes = spark.createDataFrame([("a", "ReactRootView", None), ("b", None, "x.webview"), ("c", "View", None)], "frame string, class string, package string")
    frames = spark.createDataFrame([("a", None, None), ("b", None, None), ("c", None, None), ("d", None, None), ("e", None, "H5Activity")], "frame string, package string, activity string")
    assert {tuple(r) for r in recognition.implementation(nodes, frames).collect()} == {("a", "rn"), ("b", "h5"), ("c", "native"), ("d", "unknown"), ("e", "h5")}


def test_contracts_without_rows_and_with_nulls(spark):
    none = spark.createDataFrame([], "id string, relations array<string>")
    assert contracts.missing_relations(none, spark.createDataFrame([("c", "e")], "id string, trigger string")).count() == 0
    elements = spark.createDataFrame([("e", None)], "id string, relations array<string>")
    assert [r.detail for r in contracts.missing_relations(elements, spark.createDataFrame([("c", "e"), ("d", None)], "id string, trigger string")).collect()] == ["authority_contract:c"]
    agreed = spark.createDataFrame([("k", "verified", "t", None, "e", "c", "p", None)], "key string, status string, verified string, pages array<string>, trigger string, capability string, target string, defect string")
    moves = spark.createDataFrame([("t", "s", "e", "c", "p")], "id string, source string, trigger string, capability string, target string")
    assert [r.rule for r in contracts.verification_errors(agreed, moves).collect()] == ["transition_differs"]
    files = spark.createDataFrame([("a/b.yaml", ["a"]), ("b.yaml", None), ("a/b.yaml", ["x"])], "path string, feature_path array<string>")
    assert sorted((r.rule, r.subject) for r in contracts.path_errors(files).collect()) == [("feature_path_length", "b.yaml"), ("path_depth", "b.yaml"), ("path_differs", "a/b.yaml")]


def test_owners_below_cycles_and_unknown_parents(spark):
    data = [("app", 0, None, "application", None), ("x", 1, "app", "page", "p1"), ("y", 2, "x", "page", "p2"), ("a", 3, "b", "page", "p3"), ("b", 4, "a", "page", None), ("z", 5, "gone", "component", None), ("w", 6, "z", "page", "p9")]
    rows = drafts.owned(spark.createDataFrame(data, "id string, pos int, parent string, owner_kind string, page string"), "root", "now", keep)
    found = {r.id: (r.parent, r.owner_kind, r.owner, r.page, r.children) for r in rows.collect()}
    assert found["app"] == (None, "application", "root", None, ["x"]) and found["y"] == ("x", "shared_component", "x", None, [])
    assert found["a"] == ("b", "component", "b", "p3", ["b"]) and found["b"][3] == "now"
    assert found["z"] == (None, "page", "now", None, ["w"]) and found["w"] == ("z", "component", "z", "p9", [])


def test_previews_and_traces(spark):
    edges = spark.createDataFrame([("1", "e", "f1"), ("2", "e", None), ("3", "x", "f1")], "edge string, element string, before_frame string")
    seen = spark.createDataFrame([("e", "f1", "t1", "r1"), ("e", "f2", "t2", "r2"), ("e", "f3", "t3", None)], "element string, frame string, observed_at string, rect string")
    assert sorted((r.edge, r.frame) for r in evidence.preview(edges, seen).collect()) == [("1", "f1"), ("2", "f2"), ("3", None)]
