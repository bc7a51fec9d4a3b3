"""Plans whose tasks do not grow with the input."""

from pyspark.sql import functions as F

from lattika.operators import graph, rounds
from lattika.plans import recognition

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_shuffles_have_partitions_by_the_size_of_a_table(spark, tmp_path, monkeypatch):
    spark.range(5000).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(rounds, "PARTITION_BYTES", 1000)
    before, advised = spark.conf.get(INITIAL, None), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        rounds.partitions_for(spark.read.parquet(f"{tmp_path}/t.parquet"))
        assert int(spark.conf.get(INITIAL)) >= 20
    finally:
        spark.conf.unset(INITIAL) if before is None else spark.conf.set(INITIAL, before)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)


def test_rows_are_dealt_out_whatever_their_bytes(spark):
    rows = rounds.spread(spark.range(1000), "id", 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000


def test_an_element_is_parsed_once():
    assert str(recognition.complete(F.col("element"))._jc.toString()).count("parse_json") == 1


def test_rounds_send_no_table_through_the_driver(spark, tmp_path):
    plans = []

    def keep(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rounds.keep(df, label)

    spark.range(64).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")).write.parquet(f"{tmp_path}/n.parquet")
    nodes = spark.read.parquet(f"{tmp_path}/n.parquet")
    assert graph.terminal_owner(nodes, keep).where("terminal = 0").count() == 64
    ring = nodes.select(F.col("node").alias("a"), F.coalesce("parent", F.lit(63)).alias("b"))
    assert graph.on_cycles(ring, keep).count() == 64
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_no_window_holds_all_rows_of_a_target(spark):
    from lattika.operators.evidence import control_candidates

    targets = spark.createDataFrame([("t", ["k"])], "target string, patterns array<string>")
    controls = spark.createDataFrame([("k", f, at, 1.0, None) for f, at in ((3, 5), (2, 7), (2, 7), (4, 7), (1, None))], "key string, frame long, captured_at int, locator double, geometry double")
    traces = spark.createDataFrame([], "key string, frame long, captured_at int, attempts array<struct<status:string,rect:double>>")
    found = control_candidates(targets, controls, traces)
    assert sorted((r.frame, r.latest) for r in found.collect()) == [(1, False), (2, False), (2, True), (3, False), (4, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window [" in line and line.count("#") and "[target" in line and "captured_at" not in line.split("], [")[1] for line in plan.splitlines() if "Window [" in line)


def test_certified_components_are_not_broadcast(spark):
    from lattika.plans.contracts import component_errors

    fact = "map('visibleLabel', 'v', 'actionableControl', 'a', 'labelTextActionable', 'false', 'containerElementRef', concat('c', id), 'labelElementRef', concat('l', id), 'triggerElementRef', concat('b', id))"
    k = spark.range(20)
    agreed = k.selectExpr("id AS key", "concat('p', id) AS source", "concat('b', id) AS trigger", f"{fact} AS fact")
    common = "array() AS capabilities", "id < 0 AS actionable"
    parts = k.selectExpr("concat('c', id) AS id", "'container' AS type", "'page' AS owner_kind", "concat('p', id) AS owner", "array(concat('l', id), concat('b', id)) AS children", *common)
    for x, kind in (("l", "text_label"), ("b", "button")):
        parts = parts.union(k.selectExpr(f"concat('{x}', id)", f"'{kind}'", "'component'", "concat('c', id)", "array()", *common))
    pages = k.selectExpr("concat('p', id) AS id", "array(if(id = 3, 'x', concat('c', id))) AS elements")
    found = component_errors(agreed, parts, pages)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("container_unlisted", "3", "c3")]


def test_a_task_reads_a_bounded_part_of_a_table(spark, tmp_path):
    from lattika.operators.rounds import READ_BYTES
    from lattika.plans.catalogue import read

    name = "spark.sql.files.maxPartitionBytes"
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    for before, after in (("128m", str(READ_BYTES)), ("1m", "1m")):
        spark.conf.set(name, before)
        assert read(spark, str(tmp_path), "t").count() == 3 and spark.conf.get(name) == after
    spark.conf.unset(name)
