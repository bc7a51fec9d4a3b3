import json

from pyspark.sql import functions as F

from lattika.sources.session_files import FORMAT, evidence_maps, session_records


def fill(folder):
    files = {
        "a/sessions/s1/raw-session.json": {"id": "S1"},
        "a/sessions/s1/raw-frames.jsonl": [{"id": "f1", "n": 1}, {"id": "f2", "n": 1}, {"id": "f1", "n": 2}],
        "a/sessions/s1/raw-observations.jsonl": [{"frameRef": "f1", "ok": False}],
        "a/sessions/s2/raw-session.json": {"id": "S2", "executionAuthorization": {"offlineFixture": True}},
        "a/sessions/s2/raw-frames.jsonl": [{"id": "f1", "n": 9}],
        "b/sessions/s3/raw-session.json": {"id": "S3"},
        "b/sessions/s3/raw-frames.jsonl": [{"id": "f2", "n": 3}],
        "b/sessions/s3/raw-observations.jsonl": [{"frameRef": "f1", "ok": True}],
        "b/sessions/s3/raw-action-traces.jsonl": [{"id": "t"}, {"id": "t"}],
        "b/sessions/incomplete/raw-frames.jsonl": [{"id": "f7"}],
    }
    for name, value in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n\n".join(map(json.dumps, value)) if isinstance(value, list) else json.dumps(value))
    (folder / "b/sessions/s3/odd.json").write_text("[1]")
    (folder / "b/sessions/s3/broken.jsonl").write_bytes(b'{"a": 1}\nno\n\xff')
    (folder / "b/sessions/s3/lines.jsonl").write_text('{"a": 1}\nno\n')
    return f"file://{folder}"


def test_records_errors_and_maps(spark, tmp_path):
    records = session_records(spark, fill(tmp_path))
    found = {(r.session, r.file, r.pos): (r.record, r.error is not None) for r in records.collect()}
    assert {s for s, _, _ in found} == {"s1", "s2", "s3"} and found["s3", "odd.json", 0] == (None, True) and found["s3", "broken.jsonl", -1] == (None, True)
    assert found["s3", "lines.jsonl", 0] == ('{"a": 1}', False) and found["s3", "lines.jsonl", 1] == (None, True) and found["s1", "raw-frames.jsonl", 4][0] == '{"id": "f1", "n": 2}'
    sessions, frames, observations, traces = evidence_maps(records)
    assert sorted((r.session, r.id) for r in sessions.collect()) == [("s1", "S1"), ("s3", "S3")]
    assert {r.id: (r.session, r.n) for r in frames.select("id", "session", F.variant_get("record", "$.n", "int").alias("n")).collect()} == {"f1": ("s1", 2), "f2": ("s3", 3)}
    assert [(r.id, r.session) for r in observations.collect()] == [("f1", "s3")] and traces.count() == 2


def test_filters_prune_folders(spark, tmp_path):
    root = fill(tmp_path)
    records = session_records(spark, root)
    assert records.rdd.getNumPartitions() == 3
    for condition, left in (("session = 's3'", 1), ("session IN ('s1', 's2') AND pos = 0", 2), ("session LIKE 's%'", 3), ("session = 'none'", 1)):
        part = records.where(condition)
        assert part.rdd.getNumPartitions() == left
        assert {r.session for r in part.collect()} == {s for s in ("s1", "s2", "s3") if s in condition or "%" in condition}
    plan = records.where("session = 's3'")._jdf.queryExecution().executedPlan().toString()
    assert FORMAT in plan and "session" in plan.split("PushedFilters")[-1]
    assert session_records(spark, f"{root}/nothing").count() == 0
