import hashlib
import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lattika.operators import hashing
from lattika.sources import readers, writers
from lattika.sources.manifests import Conflict, VersionedTable
from lattika.streaming import sessions


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return f"file://{folder}"


def test_yaml_and_json_files(spark, tmp_path):
    root = write(tmp_path, {"a/x.yaml": "base: &b {entityType: Page, id: 1}\n---\n<<: {entityType: Page}\nid: 2\n---\n- list\n", "b/y.YML": "k: [", "manifest.yaml": "a: 1", "c/z.json": '{"a": 1, "a": 2}', "c/w.json": '{"a": {"b": 1}}', "c/v.json": "[1]"})
    found = readers.yaml_records(spark, root).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.pos, r.error is not None) for r in sorted(found, key=lambda r: (r.path, r.pos))] == [("x.yaml", 0, False), ("x.yaml", 1, False), ("x.yaml", 2, True), ("y.YML", -1, True)]
    assert readers.of_type(readers.yaml_records(spark, root), "Page").count() == 1
    strict = {r.path.rsplit("/", 1)[-1]: (r.record, r.error) for r in readers.strict_json(spark, root).collect()}
    assert strict == {"z.json": (None, "repeated key"), "w.json": ('{"a": {"b": 1}}', None), "v.json": (None, "root is not a map")}


def test_logs_and_lines(spark, tmp_path):
    root = write(tmp_path, {"s1/raw.jsonl": '{"id": 1}\n\n{"id": 2}\n', "s2/raw.jsonl": '{"id": 3}\n'})
    found = readers.session_logs(spark, f"{root}/*/raw.jsonl", "id long")
    assert sorted((r.session, r.id) for r in found.where("id IS NOT NULL").collect()) == [("s1", 1), ("s1", 2), ("s2", 3)]


def test_markdown_and_html(spark):
    texts = spark.createDataFrame([("n/a.md", "---\nk: v\n---\nsee [[b|B]] and [[x/c#part]] not ![[img.png]]"), ("n/b.md", "plain"), ("x/c.md", "[[gone]]")], "path string, text string")
    parts = {r.path: (r.header, r.body) for r in readers.front_matter(texts, "text").collect()}
    assert parts["n/a.md"][0] == "k: v" and parts["n/b.md"] == (None, "plain")
    links = readers.resolve_links(readers.wiki_links(texts, "path", "text").withColumnRenamed("path", "source"), texts, "n")
    assert sorted(((r.source, r.target, r.path) for r in links.collect()), key=str) == [("n/a.md", "b", "n/b.md"), ("n/a.md", "x/c", "x/c.md"), ("x/c.md", "gone", None)]
    dumps = spark.createDataFrame([(1, '<h><n b="1"><m/></n><!-- c --><n/></h>'), (2, "<broken"), (3, None)], "id long, xml string")
    assert [(r.node, r.parent, r.depth) for r in readers.hierarchy_rows(dumps, "id", "xml").where("node IS NOT NULL").orderBy("node").collect()] == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 0, 1)]
    assert [(r.id, "error" in r.attributes) for r in readers.hierarchy_rows(dumps, "id", "xml").where("node IS NULL").collect()] == [(2, True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "k string, f array<string>")
    writers.by_feature(df, f"file://{tmp_path}/f", "f")
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/f").select("k", "feature_l1", "feature_l3").collect()) == [("a", "x", "_"), ("b", "_", "_")]
    writers.create(df, f"file://{tmp_path}/c")
    with pytest.raises(AnalysisException):
        writers.create(df, f"file://{tmp_path}/c")
    one, two = (writers.evidence(df.repartition(n), f"file://{tmp_path}/e{n}").first() for n in (1, 2))
    assert one.rows == 2 and one.root_hash == two.root_hash


def test_batch_sessions(spark):
    events = spark.createDataFrame([("s", 2, "nk>b</thi"), ("s", 1, "a<thi"), ("s", 3, "nk>c"), ("t", 1, None)], "session string, id long, text string")
    assert {tuple(r) for r in sessions.accumulated(events).collect()} == {("s", "a<think>b</think>c"), ("t", "")}
    assert {tuple(r) for r in sessions.visible_and_inner(events).collect()} == {("s", "ac", "b"), ("t", "", "")}
    seen = spark.createDataFrame([("r", "s", 1), ("q", "s", None)], "reader string, session string, last_id long")
    assert sorted((r.reader, r.id) for r in sessions.replay(events, seen).collect()) == [("q", 1), ("q", 2), ("q", 3), ("r", 2), ("r", 3)]
    tries = [("a", i, i in (2,), i == 4) for i in range(1, 6)] + [("b", i, False, False) for i in range(1, 9)]
    found = sessions.resumption(spark.createDataFrame(tries, "session string, n int, got_content boolean, done boolean")).orderBy("session", "n").collect()
    assert [(r.session, r.n, r.retry, r.state) for r in found] == [("a", 1, 1, "running"), ("a", 2, 1, "running"), ("a", 3, 2, "running"), ("a", 4, 2, "completed")] + [("b", i, i, "running") for i in range(1, 6)] + [("b", 6, 6, "failed")]
    part = lambda *k: spark.createDataFrame([(x, i) for i, x in enumerate(k)], "k string, pos int")
    assert sorted(r.k for r in sessions.continuation(part("a", "b"), part("b", "c"), ["k"]).collect()) == ["a", "b", "c"]
    table = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], "k string, revision long, payload string")
    now, refused = sessions.apply_if_current(table, spark.createDataFrame([("x", 1, "n"), ("y", 1, "n")], "k string, revision long, payload string"), "k")
    assert sorted(tuple(r) for r in now.collect()) == [("x", 2, "n"), ("y", 2, "q")] and [tuple(r) for r in refused.collect()] == [("y", 1, "n")]


def test_one_of_two_writes_on_a_revision_wins(spark):
    table = spark.createDataFrame([("x", 1, "p")], "k string, revision long, payload string")
    now, refused = sessions.apply_if_current(table, spark.createDataFrame([("x", 1, "b"), ("x", 1, "a"), ("z", 1, "c")], table.schema), "k")
    assert [tuple(r) for r in now.collect()] == [("x", 2, "a")] and sorted(r.payload for r in refused.collect()) == ["b", "c"]
    now, refused = sessions.apply_if_current(table, spark.createDataFrame([("new", None, "b"), ("x", None, "a"), ("x", 9, "c")], table.schema), "k")
    assert now.exceptAll(table).isEmpty() and table.exceptAll(now).isEmpty() and refused.count() == 3


def test_sessions_listed_and_written_in_turn(spark, tmp_path):
    of = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "session string, at long")
    found = sessions.listed(of("a", "b"), of("b", "c"))
    assert sorted((r.session, r.running) for r in found.collect()) == [("a", True), ("b", True), ("c", False)]
    of("a", "b").write.parquet(f"{tmp_path}/in")
    seen = []
    q = sessions.write_in_turn(spark.readStream.schema("session string, at long").parquet(f"{tmp_path}/in"), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen and sum(n for _, n in seen) == 2


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = VersionedTable(spark, path)
    assert table.current() == 0 and table.versions() == []
    assert writers.replace(spark.range(3), path) == 1 and writers.replace(table.read().where("id > 0"), path) == 2
    pinned = table.read()
    assert sorted(r.id for r in pinned.collect()) == [1, 2] and table.read(1).count() == 3
    with pytest.raises(Exception):
        writers.replace(spark.range(3).selectExpr("raise_error('no') AS x"), path)
    assert table.read().count() == 2
    writers.replace(spark.range(0).selectExpr("id", "id AS more"), path)
    assert pinned.count() == 2 and table.read().columns == ["id", "more"] and table.read().count() == 0
    assert table.vacuum(keep=2) == [1] and table.versions() == [2, 3] and pinned.count() == 2 and len(os.listdir(tmp_path / "t/data")) == 2


def test_one_of_two_writers_succeeds(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.write(spark.range(1))
    mine, theirs = table.prepare(spark.range(2)), table.prepare(spark.range(3))
    assert table.publish(theirs, expected=1) == 2
    for late in (1, 0, 5):
        with pytest.raises(Conflict):
            table.publish(mine, expected=late)
    with ThreadPoolExecutor(8) as pool:  # all start from version 2
        won = [f for f in [pool.submit(table.publish, mine, 2) for _ in range(16)] if f.exception() is None]
    assert len(won) == 1 and table.current() == 3 and table.read().count() == 2 and not [n for n in os.listdir(tmp_path / "t/_versions") if "draft" in n and not n.endswith(".crc")]


@pytest.mark.parametrize("step", ["prepare", "publish", "_appears"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/t"
    writers.replace(spark.range(3), path)

    def dies(self, *args):
        if step == "prepare":
            spark.range(9).write.parquet(f"{self.path}/data/half")
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(VersionedTable, step, dies)
        writers.replace(spark.range(7), path)
    table = VersionedTable(spark, path)
    assert table.versions() == [1] and table.read().count() == 3
    assert writers.replace(spark.range(4), path) == 2 and table.read().count() == 4


def test_readers_never_miss_a_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.write(spark.range(1))
    seen, stop = [], threading.Event()

    def reader():
        own = VersionedTable(spark, table.path)
        while not stop.is_set():
            seen.append(own.read().selectExpr("max(id) - min(id) + 1 = count(*)").first()[0])

    thread = threading.Thread(target=reader)
    thread.start()
    for n in range(2, 32):
        table.write(spark.range(n, 2 * n))
    stop.set()
    thread.join()
    assert table.current() == 31 and len(seen) > 5 and all(seen)


def test_ordered_hashes(spark, monkeypatch, tmp_path):
    """One state over sorted rows, whatever the partitions, pieces and batches; against hashlib."""
    monkeypatch.setattr(hashing, "PIECE", 7)
    rnd = random.Random(1)
    rows = [(k, f"p{i:03d}", rnd.randbytes(rnd.choice([0, 1, 7, 8, 50]))) for k in ("a", "b", None) for i in range(40)] + [("a", "p000", None), ("c", "x", None), ("d", "same", b"0123456789" * 3), ("d", "same", b"0123456789" * 3)]
    df = spark.createDataFrame(rows, "k string, path string, content binary").repartition(5)
    want = {}
    for k, p, c in sorted(rows, key=lambda r: (str(r[0]), r[1], hashlib.sha256(r[2] or b"").hexdigest())):
        want.setdefault(k, hashlib.sha256()).update(c or b"")
    assert {r.k: r.hash for r in hashing.ordered_hash(df, ["k"], ["path"], F.col("content")).collect()} == {k: h.hexdigest() for k, h in want.items()}
    one = hashlib.sha256(b"".join(p.encode() + b"\0" + (c or b"") + b"\0" for k, p, c in sorted(rows[:40], key=lambda r: r[1]))).hexdigest()
    assert hashing.files_hash(df.where("k = 'a' AND NOT (path = 'p000' AND content IS NULL)")).first()[0] == one
    assert hashing.files_hash(df.limit(0)).count() == 0
    monkeypatch.setattr(hashing, "PIECE", 4_096)
    root = write(tmp_path, {f"f/{i:02d}.bin": "x" * (i * 100_000) for i in range(1, 12)})
    found = hashing.files_hash(readers.files(spark, root, "*.bin").withColumn("path", F.substring_index("path", "/", -2)))
    assert found.first()[0] == hashlib.sha256(b"".join(f"f/{i:02d}.bin".encode() + b"\0" + b"x" * (i * 100_000) + b"\0" for i in range(1, 12))).hexdigest()


def test_streamed_sessions(spark, tmp_path):
    rows = [("t", "w", "s1", "start", 1), ("t", "w", "s2", "start", 2), ("t", "w", "s1", "completed", 3), ("t", "w", "s2", "start", 4), ("t", "v", "s3", "work", 1)]
    schema = "target string, workspace string, session string, event string, ts timestamp"
    plain = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long"))
    plain.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = sessions.lifecycle(stream).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    found = [(r.workspace, r.session, r.event, r.accepted) for r in spark.table("admitted").collect()]
    assert sorted(found) == sorted([("w", "s1", "start", True), ("w", "s2", "start", False), ("w", "s1", "completed", True), ("w", "s2", "start", True), ("v", "s3", "work", False)])


def test_deduplicated_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('s', 1L, TIMESTAMP '2026-01-01 00:00:00'), ('s', 1L, TIMESTAMP '2026-01-01 00:01:00'), ('s', 2L, TIMESTAMP '2026-01-01 00:01:00') t(session, id, ts)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.deduplicated(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2]
