"""Steps that grow no faster than their input."""

from pyspark.sql import functions as F

from lattika.operators import graph, matching, rounds
from lattika.operators.rules import Facts, Rule, looked_up


def kept_plans(plans):
    def keep(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return rounds.keep(df, label)

    return keep


def test_many_sessions_share_a_task(spark, tmp_path):
    import json

    from lattika.sources.session_files import TOGETHER, SessionReader, session_records

    n = 300
    for i in range(n):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}/raw-session.json").write_text(json.dumps({"id": i}))
        (tmp_path / f"s{i}/raw-frames.jsonl").write_text("{}\n{}")
    records = session_records(spark, f"file://{tmp_path}")
    assert records.rdd.getNumPartitions() <= 64 and records.count() == 3 * n and records.select("session").distinct().count() == n
    reader = SessionReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert max(len(p.sessions) for p in parts) <= TOGETHER and sum(len(list(reader.read(p))) for p in parts) == 3 * n



def test_facts_that_no_rule_looks_up_are_left_out():
    facts = [Facts("a", ("x", "y"), edges=(("u", "array(id)"),)), Facts("b", edges=(("v", "array(id)"),))]
    assert looked_up(facts, [Rule("r", "a", "f IS NULL", to="x")]) == [Facts("a", ("x",))]
    assert looked_up(facts, [Rule("r", "a", "f IS NULL", to="v")]) == facts[1:] and len(looked_up(facts, [Rule("r", "a", "true")])) == 1



def test_owners_are_done_when_no_pointer_moves(spark):
    plans = []
    nodes = spark.range(100).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 1, F.col("id") - 1).when(F.col("id") == 98, 99).when(F.col("id") == 96, 500).alias("parent"))
    found = {r.node: (r.terminal, r.hops, r.state) for r in graph.terminal_owner(nodes, kept_plans(plans)).collect()}
    assert found[4] == (4, 0, "root") and found[5] == (4, 1, "root") and found[96] == (500, 1, "missing") and found[97] == (500, 2, "missing") and found[98] == (None, None, "cycle") and found[99] == (None, None, "cycle")
    assert len(plans) <= 4  # log n rounds would be seven



def test_crowded_and_sparse_frames_match_alike(spark, monkeypatch):
    k = spark.range(60)
    rows = k.select((F.col("id") % 3).alias("frame"), F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 50).alias("y"), F.lit(0.2).alias("width"), F.lit(0.3).alias("height"))
    found = []
    for few in (0, 16):
        monkeypatch.setattr(matching, "FEW", few)
        found.append(sorted(map(tuple, matching.compare_boxes(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0"), "frame", rounds.keep).collect()), key=str))
    assert found[0] == found[1] and any(r[3] == "place" for r in found[0])
    monkeypatch.setattr(matching, "FEW", 16)
    plans = []
    alone = rows.where("pos >= 30").withColumn("frame", F.lit(None).cast("long"))
    out = matching.compare_boxes(rows.where("pos < 30").unionByName(alone), rows.where("pos >= 20").unionByName(alone), "frame", kept_plans(plans))
    assert sorted(r.how for r in out.where("frame IS NULL").collect()) == ["left"] * 30 + ["right"] * 30 and out.where("how = 'key'").count() == 10
    assert [label for label, _ in plans].count("sides") == 1



def test_checks_of_a_draft_broadcast_no_table_of_elements(spark):
    from lattika.plans import drafts

    none = F.lit(None).cast("string")
    rows = spark.range(40).select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit("").alias("label"), F.concat(F.lit("k"), F.col("id") % 20).alias("candidateKey"), F.lit("image").alias("elementType"), F.struct(*[F.lit(0.1).alias(c) for c in matching.BOX]).alias("bbox"),
        *[F.lit(1).alias(c) for c in ("gridColumns", "gridRows", "gridRegion")], none.alias("parentId"), F.lit("page").alias("ownerKind"), F.lit("p").alias("pageId"), F.array().cast("array<string>").alias("availableOnPageIds"),
        F.array(F.lit("tap")).alias("capabilities"), F.lit("accepted").alias("reviewStatus"), F.array().cast("array<string>").alias("riskSignals"),
    )
    for found in (drafts.element_issues(rows, ["image"]), drafts.duplicate_keys(rows, rounds.keep)):
        assert found.count() >= 40 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()



def test_small_files_of_many_rows_are_not_broadcast_and_skew_is_dealt_out(spark, tmp_path):
    from lattika.plans.catalogue import read

    spark.range(2_000_000).select(F.lit(7).alias("k"), F.lit("x").alias("v")).write.parquet(f"{tmp_path}/t.parquet")
    names = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    before = [spark.conf.get(n) for n in names]
    read(spark, str(tmp_path), "t")
    assert [float(spark.conf.get(names[0])), int(spark.conf.get(names[1]))] == [rounds.UNPACKED, rounds.SKEWED_BYTES]
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_edges_are_read_once_for_both_ways(spark, tmp_path):
    from lattika.operators.components import connected_components

    plans = []
    spark.range(20).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).write.parquet(f"{tmp_path}/e.parquet")
    found = connected_components(spark.read.parquet(f"{tmp_path}/e.parquet"), "x", "y", kept_plans(plans))
    assert found.count() == 21 and found.where("component = 0").count() == 21
    assert dict(plans)["edges"].count("FileScan") == 1


def test_whole_texts_cross_shuffles_as_frames(spark):
    import random

    from lattika.llm.minhash import drop_near_duplicates
    from lattika.llm.mixing import take

    rnd = random.Random(2)
    texts = [" ".join("%08x" % rnd.getrandbits(32) for _ in range(4_500)) + " " for _ in range(40)]
    rows = [(i, t * 3, "ab"[i % 2], i) for i, t in enumerate(texts)] + [(100, texts[0] * 3, "a", 0), (101, None, None, 0), (None, "x y", "b", 1), (3, "of an id twice", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    whole = sum(len(t or "") for _, t, *_ in rows)
    sc = spark.sparkContext

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = rounds.keep(docs, "docs")
    try:
        began = sent()
        kept = drop_near_duplicates(docs).collect()
        dropped = sent()
        mixed = take(docs).collect()
        assert max(dropped - began, sent() - dropped) < 1.5 * whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = {i: t for i, t, *_ in rows if i != 3}
    assert sorted((str(r.doc_id), r.n) for r in kept if r.doc_id != 3) == sorted((str(i), n) for i, _, _, n in rows if i not in (100, 3)) and all(r.text == text[r.doc_id] for r in kept if r.doc_id != 3)
    assert len([r for r in kept if r.doc_id == 3]) == 1 and all(text[r.doc_id].startswith(r.text) for r in mixed if r.doc_id != 3)
    assert sum(len(r.text.split()) for r in mixed) == 3 * sum(len((t or "").split()) for _, t, *_ in rows) // 2


def test_one_stream_is_hashed_by_many_tasks(spark, monkeypatch):
    import hashlib
    import random

    from lattika.operators import hashing

    rnd, turns, plan = random.Random(4), [], hashing._turns
    rows = [(f"p{rnd.randrange(400):03d}", rnd.randbytes(rnd.choice([0, 1, 63, 64, 500]))) for _ in range(300)] + [("q", rnd.randbytes(5_000)), ("r", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + (c or b"") + b"\0" for p, c in sorted(rows, key=lambda r: (r[0], hashlib.sha256(r[0].encode() + b"\0" + (r[1] or b"") + b"\0").hexdigest())))).hexdigest()
    for name, value in (("PIECE", 100), ("STRETCH", 12_000), ("RANGE_BYTES", 3_000), ("RANGE_ROWS", 50)):
        monkeypatch.setattr(hashing, name, value)
    monkeypatch.setattr(hashing, "_turns", lambda sizes: turns.extend([sizes, plan(sizes)]) or turns[1])
    assert hashing.files_hash(df).first()[0] == want
    sizes, found = turns
    assert len(found) > 2 and [p for low, high in found for p, _ in sizes if low <= p <= high] == [p for p, _ in sizes]
    assert max(sum(n for p, n in sizes if low <= p <= high) for low, high in found) <= 12_000
