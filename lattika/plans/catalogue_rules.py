"""Queries for geometry, texts, streams, files and versions that no other catalogue reaches, on rows made from the driver's tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattika.functions import geometry as G
from lattika.functions import text as T
from lattika.operators import hashing, merging, selection
from lattika.operators.rounds import keep, shared_folder, spread
from lattika.plans import drafts, invalidations, project_graph, views
from lattika.plans.catalogue import query, read
from lattika.sources import readers, session_files, writers
from lattika.sources.manifests import VersionedTable
from lattika.streaming import sessions, splitting


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _folder(spark, label: str) -> str:
    """A new folder below the shared one, which outlives the query as what it returns reads it."""
    return f"{shared_folder(spark)}/lattika/{label}-{uuid.uuid4().hex}"


def _lines(spark, d):
    """Line items as boxes of whole numbers, one row for each order and line: the least."""
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    box = F.struct((F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"))
    return rows.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min(box).alias("b")).select("k", "n", "b.*")


_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, b.x AS x, b.y AS y, b.w AS w FROM (SELECT l_orderkey, l_linenumber, min({'x': CAST(l_partkey % 50 AS DOUBLE), 'y': CAST(l_suppkey % 50 AS DOUBLE), 'w': CAST(l_quantity AS DOUBLE)}) AS b FROM lineitem GROUP BY ALL)"


# --- geometry --------------------------------------------------------------------------------------------------------


@query(f"""
WITH l AS ({_LINES})
SELECT k, n, CASE WHEN n = 3 THEN 'frame_differs' WHEN n = 4 THEN 'ratio_invalid' WHEN w <= 10 THEN 'size_invalid' WHEN x + w - 10 > 60 OR y + w - 10 > 70 THEN 'outside_viewport' WHEN NOT (25 BETWEEN x AND x + w - 10 AND 25 BETWEEN y AND y + w - 10) THEN 'centre_outside' END AS error FROM l""")
def q_locator_errors(spark, d):
    """Line items as locators in a frame of 60 by 70: the first thing that is wrong with each."""
    r, n = _lines(spark, d), F.col("n")
    size = F.col("w") - 10
    locator = F.struct(F.when(n == 3, "other").otherwise("f").alias("frame"), F.col("x").alias("left"), F.col("y").alias("top"), size.alias("width"), size.alias("height"), F.lit(25.0).alias("x"), F.lit(25.0).alias("y"))
    frame = F.struct(F.lit("f").alias("frame"), F.lit(60.0).alias("width"), F.lit(70.0).alias("height"), F.when(n == 4, 0.0).otherwise(2.0).alias("ratio"))
    return r.select("k", "n", G.locator_error(locator, frame).alias("error"))


@query(f"""
WITH l AS ({_LINES})
SELECT k, n, 25 >= x AND 25 < x + w - 10 AND 30 >= y AND 30 < y + w - 10 AS half_open, 25 >= x AND 25 <= x + w - 10 AND 30 >= y AND 30 <= y + w - 10 AS closed, w > 10 AS valid, x >= 10 AND y >= 10 AND x + w - 10 <= 50 AND y + w - 10 <= 50 AS within,
  x < 30 AND 20 < x + w - 10 AND y < 30 AND 20 < y + w - 10 AS meets FROM l""")
def q_rectangles(spark, d):
    """A point in line items as rectangles with and without their far edges; which are valid, lie inside a larger one, and meet a selection."""
    r = _lines(spark, d)
    x, y, size = F.col("x"), F.col("y"), F.col("w") - 10
    right, bottom, px, py = x + size, y + size, F.lit(25.0), F.lit(30.0)
    return r.select(
        "k", "n", G.half_open_contains(x, y, right, bottom, px, py).alias("half_open"), G.closed_contains(x, y, size, size, px, py).alias("closed"), G.valid_half_open(x, y, right, bottom).alias("valid"),
        G.rect_within((x, y, right, bottom), tuple(map(F.lit, (10.0, 10.0, 50.0, 50.0)))).alias("within"), G.boxes_intersect((x, y, size, size), tuple(map(F.lit, (20.0, 20.0, 10.0, 10.0)))).alias("meets"),
    )


@query(f"""
WITH l AS ({_LINES}), t AS (SELECT k, n, x, y, 2 + n AS a, 1 + w / 100 AS e, x / 1000 AS g FROM l)
SELECT k, n, round((a * 3 + 5) / (g * 3 + 1), 9) AS px, round((e * 4 - 7) / (g * 3 + 1), 9) AS py, round(a * e - 5 * e * g, 9) AS det, round(((a * 3 + 5) / (g * 3 + 1)) - ((a * 3 + 5) / (g * 3 + 1)) + 3, 6) AS back_x, 4.0::DOUBLE AS back_y FROM t""")
def q_projections(spark, d):
    """A point under projective matrices made of line items, and back under their inverses."""
    r, n = _lines(spark, d), F.col("n")
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array((n + 2).cast("double"), zero, F.lit(5.0), zero, 1 + F.col("w") / 100, F.lit(-7.0), F.col("x") / 1000, zero, one)
    r = r.withColumn("m", matrix).withColumn("p", G.project_point(F.col("m"), F.lit(3.0), F.lit(4.0)))
    back = G.project_point(G.inverse(F.col("m")), F.col("p.x"), F.col("p.y"))
    return r.select("k", "n", F.round("p.x", 9).alias("px"), F.round("p.y", 9).alias("py"), F.round(G.determinant(F.col("m")), 9).alias("det"), F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 6).alias("back_y"))


@query(f"""
WITH l AS ({_LINES}), t AS (SELECT k, n, x / 40 - 0.1 AS x, y / 60 AS y, w / 90 AS w FROM l), c AS (SELECT *, greatest(0.01, least(1.0, w)) AS side FROM t)
SELECT k, n, greatest(0.0, least(1 - side, x)) AS left_, greatest(0.0, least(1 - side, y)) AS top, side AS width, side AS height, CASE WHEN n % 3 > 0 THEN x END AS named_left FROM c""")
def q_clamped_boxes(spark, d):
    """Line items as boxes moved into the unit square, and rectangles whose place is named in two ways or not at all."""
    r, n = _lines(spark, d), F.col("n")
    x, y, w = F.col("x") / 40 - 0.1, F.col("y") / 60, F.col("w") / 90
    one = lambda left, top: F.create_map(F.lit(left), x, F.lit(top), y, F.lit("width"), w, F.lit("height"), w)
    rect = F.when(n % 3 == 1, one("left", "top")).when(n % 3 == 2, one("x", "y")).otherwise(one("other", "y"))
    return r.withColumn("c", G.clamp_box(x, y, w, w)).select("k", "n", F.col("c.x").alias("left_"), F.col("c.y").alias("top"), "c.width", "c.height", G.normalized_rect(rect)["left"].alias("named_left"))


@query(f"""
WITH b AS ({_LINES}), h AS (SELECT o_orderkey AS point, o_custkey % 7 AS chosen, n, row_number() OVER (PARTITION BY o_orderkey ORDER BY w * w, n) AS place, count(*) OVER (PARTITION BY o_orderkey) AS many FROM orders JOIN b ON k = o_orderkey WHERE 30 BETWEEN x AND x + w AND 35 BETWEEN y AND y + w),
c AS (SELECT *, coalesce(max(CASE WHEN n = chosen THEN place END) OVER (PARTITION BY point), 0) AS at_ FROM h)
SELECT point, n AS element FROM c WHERE place = at_ % many + 1""")
def q_clicks(spark, d):
    """What a click into each order's boxes takes while one of its lines is selected."""
    boxes = _lines(spark, d).select(F.col("k").alias("frame"), F.col("n").alias("element"), "x", "y", F.col("w").alias("width"), F.col("w").alias("height"))
    points = read(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("point"), F.lit(30.0).alias("px"), F.lit(35.0).alias("py"), (F.col("o_custkey") % 7).cast("int").alias("selected"))
    return views.clicked(boxes, points)


# --- texts -----------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS k, p_size, unnest(CASE WHEN p_size % 2 = 0 THEN ['tap', 'drag', 'fly'] ELSE ['none', 'input'] END) AS action FROM part)
SELECT k, action, CASE WHEN action = 'tap' AND p_size % 3 = 0 THEN 'goes' WHEN action = 'drag' THEN '拖拽 card 或其中的目标对象' WHEN action = 'none' THEN 'card 仅展示或承载内容，不触发交互' WHEN action = 'input' THEN '向 card 输入文本或数值' ELSE '点击 card 触发对应操作' END AS effect FROM p""")
def q_action_effects(spark, d):
    """What the actions of parts as cards do: what is told of them, else what such actions do."""
    size = F.col("p_size")
    caps = F.when(size % 2 == 0, F.array(*map(F.lit, ("tap", "drag", "fly")))).otherwise(F.array(*map(F.lit, ("none", "input"))))
    told = F.array(F.struct(F.lit("tap").alias("action"), F.when(size % 3 == 0, "goes").otherwise("").alias("effect")), F.struct(F.lit("drag").alias("action"), F.lit(None).cast("string").alias("effect")))
    found = read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), F.explode(T.action_effects(caps, told, F.lit("card"))).alias("e"))
    return found.select("k", "e.action", "e.effect")


@query("""SELECT o_orderkey AS k, left(o_orderpriority, 3) AS short, o_orderstatus <> 'O' AS lists_differ, false AS sets_differ, o_orderkey % 2 = 1 AS objects_differ,
  CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2026-01-02 03:04:05.5' END AS at_, CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'unknown' END AS failure FROM orders""")
def q_values(spark, d):
    """Orders: texts cut short, lists and objects compared, times that are UTC times, kinds of failure."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    a, b = F.array(F.lit("x"), F.lit("y")), F.when(status == "O", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x"), F.lit("y")))
    thing = lambda v: F.struct(F.lit(1).alias("a"), v.alias("b"))
    time = F.when(k % 3 == 0, "2026-01-02T03:04:05.500Z").when(k % 3 == 1, "2026-01-02 03:04:05").otherwise("2026-13-02T03:04:05Z")
    failure = F.when(F.when(status == "F", "AssertionError").otherwise("TypeError") == "AssertionError", "fail").otherwise("unknown")
    return read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        k.alias("k"), T.shortened(F.col("o_orderpriority"), 3).alias("short"), T.stable_differs(a, b).alias("lists_differ"), T.stable_differs(a, b, as_sets=True).alias("sets_differ"), T.stable_differs(thing(F.lit(0)), thing((k % 2).cast("int"))).alias("objects_differ"),
        T.utc_time(time).cast("timestamp_ntz").alias("at_"), failure.alias("failure"),
    )


@query("SELECT CAST(row_number() OVER (ORDER BY lower(v), v DESC) AS INTEGER) AS place, v FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS v FROM part)")
def q_collated(spark, d):
    """Brands in small and capital letters in the order of a language: letters before their case, small ones first."""
    from pyspark.sql import Window

    brands = read(spark, d, "part", "p_partkey", "p_brand").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("v")).distinct()
    return brands.withColumn("place", F.row_number().over(Window.orderBy(T.localized(F.col("v"))))).select("place", "v")  # a row for each brand


# --- drafts and graphs -----------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT p_partkey AS k, p_size AS s, p_size % 7 AS t FROM part)
SELECT i.l AS level, i.c AS code, 'e' || k AS element FROM (SELECT k, unnest([
  CASE WHEN s % 5 = 0 AND s % 9 <> 0 THEN {'l': 'error', 'c': 'label_required'} END, CASE WHEN t = 0 THEN {'l': 'error', 'c': 'candidate_key_required'} END, CASE WHEN t = 1 THEN {'l': 'error', 'c': 'element_type_required'} END,
  CASE WHEN t = 2 THEN {'l': 'error', 'c': 'bbox_invalid'} END, CASE WHEN t IN (2, 3) THEN {'l': 'error', 'c': 'grid_region_invalid'} END, CASE WHEN t = 4 AND k % 2 = 0 THEN {'l': 'error', 'c': 'parent_missing'} END, CASE WHEN t = 4 AND k % 2 = 1 THEN {'l': 'error', 'c': 'parent_self'} END,
  CASE WHEN t = 4 AND k % 2 = 1 THEN {'l': 'error', 'c': 'owner_cycle'} END, CASE WHEN t = 4 THEN {'l': 'error', 'c': 'nested_owner_kind'} END, CASE WHEN t = 5 THEN {'l': 'error', 'c': 'root_owner_kind'} END, CASE WHEN t = 6 THEN {'l': 'warning', 'c': 'capability_missing'} END,
  CASE WHEN s % 4 = 0 AND s % 9 <> 0 THEN {'l': 'warning', 'c': 'review_pending'} END, CASE WHEN s % 3 = 0 THEN {'l': 'warning', 'c': 'model_bbox_clamped'} END, CASE WHEN s % 3 = 1 THEN {'l': 'warning', 'c': 'model_action_inconsistent'} END]) AS i FROM e) WHERE i IS NOT NULL""")
def q_draft_issues(spark, d):
    """Parts as elements of a draft, with what is wrong with each by the server's rules."""
    p, k, s = read(spark, d, "part", "p_partkey", "p_size", "p_name"), F.col("p_partkey"), F.col("p_size")
    t = s % 7
    box = F.struct(F.when(t == 2, 0.95).otherwise(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    rows = p.select(
        _name("e", k).alias("id"), F.when(s % 5 == 0, " ").otherwise(F.col("p_name")).alias("label"), F.when(t == 0, "").otherwise(_name("key", k)).alias("candidateKey"), F.when(t == 1, "odd").otherwise("image").alias("elementType"), box.alias("bbox"),
        F.when((t == 4) & (k % 2 == 0), "gone").when(t == 4, _name("e", k)).alias("parentId"), F.when(t == 5, "component").otherwise("page").alias("ownerKind"), F.lit("p").alias("pageId"), F.array().cast("array<string>").alias("availableOnPageIds"),
        F.when(t == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("tap"))).alias("capabilities"), F.when(s % 9 == 0, "rejected").when(s % 4 == 0, "pending").otherwise("accepted").alias("reviewStatus"),
        F.array(F.when(s % 3 == 0, "geometry-clamped-to-frame").when(s % 3 == 1, "model-action-inconsistent")).alias("riskSignals"), (t == 3).alias("off"),
    )
    grid = G.grid_for_box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.width"), F.col("bbox.height"), F.lit(12), F.lit(12))
    rows = rows.withColumn("g", grid).withColumns({"gridColumns": F.col("g.columns"), "gridRows": F.col("g.rows"), "gridRegion": F.col("g.region") + F.when(F.col("off"), 1).otherwise(0)})
    return drafts.draft_issues(rows, ["image"], keep)


@query("SELECT n_nationkey AS page, count(*) FILTER (c_acctbal >= 5000) AS reviewed, count(*) FILTER (c_acctbal < 0) AS pending, count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 1000) AS ignored FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def q_review_counts(spark, d):
    """How many customers of each nation are reviewed, pending and ignored."""
    balance = F.col("c_acctbal")
    status = F.when(balance >= 5000, F.when(F.col("c_custkey") % 2 == 0, "accepted").otherwise("edited")).when(balance < 0, "pending").when(balance < 1000, "rejected")
    elements = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(F.col("c_nationkey").alias("pageId"), status.alias("reviewStatus"))
    return drafts.review_counts(read(spark, d, "nation", "n_nationkey").toDF("page"), elements)


_KNOWN = "struct<origin:string,reviewStatus:string,validationStatus:string,confidence:double,evidenceRefs:array<string>>"


@query("""
WITH c AS (SELECT c_custkey AS k, 'page:' || c_custkey AS id, c_custkey % 17 AS f, c_nationkey AS n FROM customer), r AS (SELECT o_orderkey AS k, 'relation:' || o_orderkey AS id, o_orderkey % 13 AS f, 'page:' || o_custkey AS a, 'element:' || o_orderkey % (SELECT count(*) FROM supplier) AS b FROM orders)
SELECT 'option_duplicate' AS rule, 'model' AS subject, 'risk=low' AS detail
UNION ALL SELECT 'entity_type_unknown', id, 'Ghost' FROM c WHERE f = 1 UNION ALL SELECT 'attributes_not_object', id, 'attributes' FROM c WHERE f = 2 UNION ALL SELECT 'attribute_undeclared', id, 'other' FROM c WHERE f = 3
UNION ALL SELECT 'attribute_type', id, 'open' FROM c WHERE f = 4 UNION ALL SELECT 'option_unknown', id, 'risk=old' FROM c WHERE f = 5 UNION ALL SELECT 'attribute_missing', id, 'risk' FROM c WHERE f = 6 UNION ALL SELECT 'field_missing', id, 'label' FROM c WHERE f = 7
UNION ALL SELECT 'knowledge_origin', id, 'magic' FROM c WHERE f = 8 UNION ALL SELECT 'evidence_unresolved', id, 'evidence:none' FROM c WHERE f = 9 UNION ALL SELECT 'verified_without_evidence', id, 'evidenceRefs' FROM c WHERE f = 10
UNION ALL SELECT 'project_differs', id, 'other' FROM c WHERE f = 11 UNION ALL SELECT 'id_invalid', 'bad ' || k, 'Entity' FROM c WHERE f = 12
UNION ALL SELECT 'source_unresolved', r.id, a FROM r LEFT JOIN c ON a = c.id AND c.f <> 12 WHERE c.id IS NULL AND r.f <> 2 UNION ALL SELECT 'target_unresolved', id, 'page:none' FROM r WHERE f = 1
UNION ALL SELECT 'source_type', r.id, 'Ghost' FROM r JOIN c ON a = c.id WHERE c.f = 1 AND r.f <> 2 UNION ALL SELECT 'relation_type_unknown', id, 'hides' FROM r WHERE f = 2 UNION ALL SELECT 'target_type', id, 'Page' FROM r WHERE f = 3 AND EXISTS (SELECT 1 FROM c WHERE c.id = 'page:5' AND c.f NOT IN (1, 12))
UNION ALL SELECT 'evidence_incomplete', 'evidence:' || n_nationkey, 'uri, capturedAt' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'subject_unresolved', 'observation:' || n_nationkey, 'page:none' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'element_unresolved', 'observation:' || n_nationkey, 'element:none' FROM nation WHERE n_nationkey % 4 = 0""")
def q_project_errors(spark, d):
    """Customers as pages, suppliers as elements, orders as relations and nations as evidence of a project, with faults by their numbers."""
    core = {
        "entityTypes": {"Page": {}, "Element": {}}, "relationTypes": {"shows": {"sourceTypes": ["Page"], "targetTypes": ["Element"]}},
        "optionSets": {"risk": {"options": [{"value": "low", "label": "Low"}, {"value": "low", "label": "Low"}, {"value": "old", "label": "Old", "status": "retired"}]}},
        "fields": [{"key": "risk", "appliesTo": ["Page"], "valueType": "option", "optionSetRef": "risk", "required": True}, {"key": "open", "appliesTo": ["Page"], "valueType": "boolean"}],
    }
    model = project_graph.merged_model(spark, core, {})
    none = F.lit(None).cast("string")
    no_refs = F.array().cast("array<string>")

    def known(origin=F.lit("manual"), state=F.lit("observed"), refs=no_refs):
        return F.struct(origin.alias("origin"), F.lit("confirmed").alias("reviewStatus"), state.alias("validationStatus"), F.lit(0.5).alias("confidence"), refs.alias("evidenceRefs")).cast(_KNOWN)

    def record(df, kind, id_, entity_type=none, project=F.lit("x"), label=F.lit("l"), attributes=none, knowledge=None, uri=none, subject=none, payload=none):
        parts = {"recordKind": F.lit(kind), "id": id_, "entityType": entity_type, "projectRef": project, "key": F.lit("k"), "label": label, "summary": F.lit("s"), "lifecycleStatus": F.lit("active"), "attributes": attributes,
            "knowledge": F.lit(None).cast(_KNOWN) if knowledge is None else knowledge, "uri": uri, "capturedAt": uri, "subjectRef": subject, "payload": payload, "evidenceRefs": no_refs}
        return df.select(*[v.cast("string").alias(k) if k not in ("knowledge", "evidenceRefs") else v.alias(k) for k, v in parts.items()])

    k, f = F.col("c_custkey"), F.col("c_custkey") % 17
    attributes = F.when(f == 1, "{}").when(f == 2, "[1]").when(f == 3, '{"risk":"low","other":1}').when(f == 4, '{"risk":"low","open":"yes"}').when(f == 5, '{"risk":"old"}').when(f == 6, '{"open":true}').otherwise('{"risk":"low","open":false}')
    refs = F.when(f == 9, F.array(F.lit("evidence:none"))).when(f == 10, no_refs).otherwise(F.array(F.lit("evidence:1")))
    pages = record(
        read(spark, d, "customer", "c_custkey"), "Entity", F.when(f == 12, _name("bad ", k)).otherwise(_name("page:", k)), F.when(f == 1, "Ghost").otherwise("Page"), F.when(f == 11, "other").otherwise("x"), F.when(f != 7, "l"), attributes,
        known(F.when(f == 8, "magic").otherwise("manual"), F.when(f == 10, "runtime_verified").otherwise("observed"), refs),
    )
    elements = record(read(spark, d, "supplier", "s_suppkey"), "Entity", _name("element:", "s_suppkey"), F.lit("Element"), attributes=F.lit("{}"), knowledge=known())
    nations, n = read(spark, d, "nation", "n_nationkey"), F.col("n_nationkey")
    evidence = record(nations, "Evidence", _name("evidence:", n), uri=F.when(n % 5 == 0, "").otherwise("u"))
    seen = F.concat(F.lit('{"elements":[{"elementRef":"element:'), F.when(n % 4 == 0, "none").otherwise("1"), F.lit('"}]}'))
    observations = record(nations, "Observation", _name("observation:", n), subject=F.when(n % 3 == 0, "page:none").otherwise("page:2"), payload=seen)
    suppliers, o = read(spark, d, "supplier", "s_suppkey").count(), read(spark, d, "orders", "o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    target = F.when(key % 13 == 1, "page:none").when(key % 13 == 3, "page:5").otherwise(_name("element:", key % suppliers))
    relations = o.select(_name("relation:", key).alias("id"), F.when(key % 13 == 2, "hides").otherwise("shows").alias("relationType"), F.lit("x").alias("projectRef"), _name("page:", "o_custkey").alias("sourceRef"), target.alias("targetRef"), known().alias("knowledge"))
    records = pages.unionByName(elements).unionByName(evidence).unionByName(observations)
    return project_graph.graph_errors(records, relations, model, keep, "x")


@query("""
WITH e AS (SELECT 's' || s_suppkey AS id, CAST(NULL AS VARCHAR) AS parent, 'p' || s_nationkey AS page, CASE WHEN s_suppkey % 4 = 0 THEN ['p' || (s_nationkey + 1) % 25] ELSE [] END AS pages, s_suppkey % 19 AS f FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 's' || c_custkey % 150, NULL, [], c_custkey % 97 + 100 FROM customer),
b AS (SELECT id, unnest(list_concat([page], pages)) AS page FROM e WHERE parent IS NULL UNION ALL SELECT c.id, unnest(list_concat([s.page], s.pages)) FROM e c JOIN e s ON c.parent = s.id),
a AS (SELECT id, unnest(list_concat([page], pages, CASE WHEN f = 3 THEN ['p0'] ELSE [] END)) AS page FROM e WHERE parent IS NULL UNION ALL SELECT c.id, unnest(list_concat([s.page], s.pages, CASE WHEN s.f = 3 THEN ['p0'] ELSE [] END)) FROM e c JOIN e s ON c.parent = s.id),
hit AS (SELECT b.page FROM b JOIN e USING (id) WHERE f IN (1, 3, 105) UNION SELECT a.page FROM a JOIN e USING (id) WHERE f IN (1, 3, 105) UNION SELECT page FROM (FROM a EXCEPT FROM b) UNION SELECT page FROM (FROM b EXCEPT FROM a)
  UNION SELECT 'p' || o_custkey % 25 FROM orders WHERE o_orderkey % 5000 = 7 UNION SELECT 'p' || o_orderkey % 25 FROM orders WHERE o_orderkey % 5000 = 7 UNION SELECT 'p24')
SELECT 'p' || n_nationkey AS page, CASE WHEN n_nationkey % 4 = 1 OR 'p' || n_nationkey IN (SELECT page FROM hit) THEN NULL ELSE 'then' END AS published_at FROM nation""")
def q_invalidated_pages(spark, d):
    """Nations as pages after edits of suppliers and customers as elements, of orders as transitions and of a page: which stay published."""
    none = F.lit(None).cast("string")
    n, s = F.col("n_nationkey"), read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    pages = read(spark, d, "nation", "n_nationkey").select(_name("p", n).alias("page"), F.when(n % 4 != 1, "then").alias("published_at"), F.lit("t").alias("title"))
    key, f = F.col("s_suppkey"), F.col("s_suppkey") % 19
    empty = F.array().cast("array<string>")
    own = s.select(_name("s", key).alias("element"), none.alias("parent"), _name("p", "s_nationkey").alias("page"), F.when(key % 4 == 0, F.array(_name("p", (F.col("s_nationkey") + 1) % 25))).otherwise(empty).alias("pages"), F.lit("l").alias("label"), f.alias("f"))
    inside = read(spark, d, "customer", "c_custkey").select(_name("c", "c_custkey").alias("element"), _name("s", F.col("c_custkey") % 150).alias("parent"), none.alias("page"), empty.alias("pages"), F.lit("l").alias("label"), (F.col("c_custkey") % 97 + 100).alias("f"))
    elements = own.unionByName(inside)
    after = elements.withColumns({"label": F.when(F.col("f").isin(1, 105), "new").otherwise(F.col("label")), "pages": F.when(F.col("f") == 3, F.concat("pages", F.array(F.lit("p0")))).otherwise(F.col("pages"))})
    o = read(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), _name("p", F.col("o_custkey") % 25).alias("source"), _name("p", F.col("o_orderkey") % 25).alias("target"), F.lit(0).alias("n"))
    moved = o.withColumn("n", F.when(F.col("id") % 5000 == 7, 1).otherwise(0))
    before = invalidations.Site(pages, elements, o)
    now = invalidations.Site(pages.withColumn("title", F.when(F.col("page") == "p24", "new").otherwise(F.col("title"))), after, moved)
    return invalidations.invalidated(before, now, keep).select("page", "published_at")


# --- files and versions ----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, 'Page' AS kind, n_name AS label, ['r' || n_regionkey, n_name] AS folders, 0 AS pos FROM nation UNION ALL SELECT n_nationkey + 100, 'Note', 'about ' || n_name, ['r' || n_regionkey, n_name], 1 FROM nation")
def q_yaml_records(spark, d):
    """Nations written as YAML files of two documents each, a folder for each region, and read back."""
    root = _folder(spark, "yaml")
    nation = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    page = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.lit("Page").alias("entityType"), F.col("n_name").alias("label")))
    note = F.to_json(F.struct((F.col("n_nationkey") + 100).alias("id"), F.lit("Note").alias("recordType"), F.concat(F.lit("about "), "n_name").alias("label")))
    docs = nation.select(F.concat_ws("/", _name("r", "n_regionkey"), "n_name", F.lit("record.yaml")).alias("path"), F.array(page, note).alias("documents"))
    written = writers.yaml_files(docs, root)
    assert written.count() == docs.count()
    records = readers.yaml_records(spark, root)
    both = readers.of_type(records, "Page").withColumn("kind", F.lit("Page")).unionByName(readers.of_type(records, "Note").withColumn("kind", F.lit("Note")))
    v = F.parse_json("record")
    folders = F.slice(F.reverse(F.split("path", "/")), 2, 2)
    return both.select(F.variant_get(v, "$.id", "int").alias("id"), "kind", F.variant_get(v, "$.label", "string").alias("label"), F.reverse(folders).alias("folders"), "pos")


@query("""SELECT conv_id AS session, count(*) AS turns, max(turn) AS last FROM conversations WHERE conv_id % 5 > 0 GROUP BY 1""")
def q_session_files(spark, d):
    """Conversations written as session folders and read back as a data source; every fifth session was made up and is left out with all it holds."""
    root = _folder(spark, "sessions")
    turns = read(spark, d, "conversations", "conv_id", "turn", "text")
    lines = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.to_json(F.struct(F.concat(F.lit("f"), t["turn"].cast("string")).alias("id"), t["turn"].alias("turn"), t["text"].alias("text")))), "\n").alias("frames"))
    own = F.to_json(F.struct(_name("s", "conv_id").alias("id"), F.struct((F.col("conv_id") % 5 == 0).alias("offlineFixture")).alias("executionAuthorization")))
    files = lines.select(F.explode(F.array(F.struct(F.lit("raw-session.json").alias("f"), own.alias("text")), F.struct(F.lit("raw-action-traces.jsonl").alias("f"), F.col("frames").alias("text")))).alias("x"), "conv_id")
    writers.text_files(spread(files.select(F.concat_ws("/", _name("s", "conv_id"), F.col("x.f")).alias("path"), F.col("x.text").alias("text")), "path"), root)
    found = session_files.evidence_maps(session_files.session_records(spark, root))[3]
    turn = F.variant_get("record", "$.turn", "int")
    return found.groupBy(F.substring("session", 2, 20).cast("long").alias("session")).agg(F.count("*").alias("turns"), F.max(turn).cast("int").alias("last"))


@query("""SELECT v AS version, count(*) AS rows, CAST(sum(n_nationkey * v) AS BIGINT) AS total FROM nation, range(1, 4) t(v) WHERE n_nationkey % v = 0 GROUP BY v""")
def q_versions(spark, d):
    """Three versions of nations in one versioned table, each read by its number after the last was published."""
    table = VersionedTable(spark, _folder(spark, "versions"))
    n = F.col("n_nationkey")
    for v in (1, 2, 3):
        assert table.write(read(spark, d, "nation", "n_nationkey").where(n % v == 0).select((n * v).alias("x"))) == v
    rows = [table.read(v).agg(F.count("*").alias("rows"), F.sum("x").cast("long").alias("total")).select(F.lit(v).cast("long").alias("version"), "rows", "total") for v in table.versions()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT l_suppkey AS supplier, sha256(string_agg(l_orderkey || '/' || l_linenumber || '/' || l_partkey || chr(10), '' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS hash FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1")
def q_ordered_hash(spark, d):
    """A hash over the line items of each supplier in order of their keys."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct().withColumnRenamed("l_suppkey", "supplier")
    text = F.concat(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"), F.lit("\n")).cast("binary")
    return hashing.ordered_hash(lines, ["supplier"], ["l_orderkey", "l_linenumber", "l_partkey"], text)


# --- streams ---------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '<think>' WHEN 3 THEN '</think>' ELSE coalesce(text, '') END AS x FROM conversations), w AS (SELECT conv_id, string_agg(x, '' ORDER BY turn) AS c FROM t GROUP BY 1)
SELECT conv_id AS session, regexp_replace(c, '(?s)<think>.*?(?:</think>|$)', '', 'g') AS visible, array_to_string(regexp_extract_all(c, '(?s)<think>(.*?)(?:</think>|$)', 1), '') AS inner FROM w""")
def q_split_stream(spark, d):
    """Conversations as a stream of cut texts, markers cut in two, over four micro-batches: what lies outside and inside the markers, put together again."""
    root = _folder(spark, "stream")
    turns = read(spark, d, "conversations", "conv_id", "turn", "text")
    mark = F.when(F.col("turn") % 4 == 1, sessions.OPEN).when(F.col("turn") % 4 == 3, sessions.CLOSE).otherwise(F.coalesce("text", F.lit("")))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = turns.join(last, "conv_id").select(F.col("conv_id").alias("session"), "turn", "last", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.substring(mark, 1, 3).alias("text")), F.struct(F.lit(1).alias("n"), mark.substr(F.lit(4), F.length(mark)).alias("text")))).alias("p"))
    chunks = rows.select("session", (F.col("turn") * 2 + F.col("p.n")).cast("long").alias("id"), "p.text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("ts"), ((F.col("turn") == F.col("last")) & (F.col("p.n") == 1)).alias("final"))
    kept = keep(chunks, "chunks")
    step = kept.agg(F.ceil((F.max("id") + 1) / 4)).first()[0] or 1
    for batch in range(4):
        kept.where(F.floor(F.col("id") / step) == batch).coalesce(1).write.parquet(f"{root}/in/{batch}")
    before = spark.conf.get(splitting.PROVIDER, None)
    spark.conf.set(splitting.PROVIDER, splitting.ROCKS)
    try:
        stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
        out = splitting.split_stream(stream, delay="1 day").writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
        out.awaitTermination()
    finally:
        spark.conf.unset(splitting.PROVIDER) if before is None else spark.conf.set(splitting.PROVIDER, before)
    found = spark.read.parquet(f"{root}/out").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("id", "visible", "inner"))).alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return found.select("session", joined("visible").alias("visible"), joined("inner").alias("inner"))


@query("""
WITH c AS (SELECT l_orderkey AS upload, l_linenumber AS n, CAST(min(l_partkey % 3) AS BIGINT) AS step FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY n) - 1 AS at_ FROM c),
t AS (SELECT *, at_ * 10 + CASE WHEN step = 0 AND at_ > 0 THEN 5 ELSE 0 END AS start FROM o), bad AS (SELECT upload, min(at_) AS at_ FROM t WHERE step = 0 AND at_ > 0 GROUP BY 1)
SELECT upload, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start, CAST(bad.at_ * 10 AS BIGINT) AS expected FROM t JOIN bad USING (upload) WHERE t.at_ >= bad.at_""")
def q_refused_chunks(spark, d):
    """Line items as chunks of ten bytes of their orders' uploads, some of which begin five bytes too late: these, and all after them, are refused."""
    from pyspark.sql import Window

    lines = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("n")).agg(F.min(F.col("l_partkey") % 3).alias("step"))
    at = F.row_number().over(Window.partitionBy("upload").orderBy("n")) - 1
    chunks = lines.withColumn("at", at).select("upload", "n", (F.col("at") * 10 + F.when((F.col("step") == 0) & (F.col("at") > 0), 5).otherwise(0)).cast("long").alias("offset"), F.lit(10).cast("long").alias("length"))
    refused = selection.appended(chunks, lines.select("upload", F.lit(0).cast("long").alias("size")).distinct(), "upload")[1]
    return refused.select("upload", "n", F.col("offset").alias("start"), "expected")


@query("""
WITH k AS (SELECT 'n' || n_regionkey AS id, list('c' || n_nationkey ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN -n_nationkey ELSE 1000 END, n_name) AS children FROM nation GROUP BY 1)
SELECT 'n' || r_regionkey AS id, array_to_string(children, ',') AS children, 'owner:app,page:x,' || array_to_string(list_transform(children, lambda c: 'child:' || c), ',') AS refs FROM region JOIN k ON id = 'n' || r_regionkey
UNION ALL SELECT 'c' || n_nationkey, NULL, 'owner:n' || n_regionkey || ',page:x,parent:n' || n_regionkey FROM nation""")
def q_rebuilt_references(spark, d):
    """Regions and the nations in them, with children and references derived anew; nations of even numbers were listed before, the greatest first."""
    n = F.col("n_nationkey")
    nation = read(spark, d, "nation", "n_nationkey", "n_regionkey", "n_name")
    old = F.array(F.lit("child:gone"), F.lit("page:x"), F.lit("owner:old"), F.lit("page:x"))
    listed = nation.where(n % 2 == 0).groupBy("n_regionkey").agg(F.reverse(F.array_sort(F.collect_list("n_nationkey"))).alias("c")).select(F.col("n_regionkey").alias("r_regionkey"), F.concat(F.transform("c", lambda c: F.concat(F.lit("c"), c.cast("string"))), F.array(F.lit("gone"))).alias("children"))
    owner = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("ref")).alias("owner")
    regions = read(spark, d, "region", "r_regionkey").join(listed, "r_regionkey", "left").select(_name("n", "r_regionkey").alias("id"), F.lit("r").alias("key"), owner("application", F.lit("app")), F.lit(None).cast("string").alias("parent"), "children", old.alias("references"))
    nations = nation.select(_name("c", n).alias("id"), F.col("n_name").alias("key"), owner("component", _name("n", "n_regionkey")), _name("n", "n_regionkey").alias("parent"), F.lit(None).cast("array<string>").alias("children"), old.alias("references"))
    return merging.rebuilt_references(regions.unionByName(nations)).select("id", F.array_join("children", ",").alias("children"), F.array_join("references", ",").alias("refs"))


@query("""SELECT c_custkey AS session, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS frame, 'q' AS page, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS comparison, CASE WHEN c_custkey % 5 = 0 THEN 'x,y' ELSE 'x,y,z' END AS uncertainties FROM customer""")
def q_continued_answers(spark, d):
    """Customers' answers after continuations: frames and pages fill gaps, comparisons replace, uncertainties add up."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer", "c_custkey")
    first = c.select(k.alias("session"), F.when(k % 2 == 0, "a").otherwise("").alias("frame"), F.lit(None).cast("string").alias("page"), F.lit("old").alias("comparison"), F.array(F.lit("x"), F.lit("y"), F.lit("x")).alias("uncertainties"))
    more = c.select(k.alias("session"), F.lit("b").alias("frame"), F.lit("q").alias("page"), F.when(k % 3 == 0, "new").alias("comparison"), F.when(k % 5 != 0, F.array(F.lit("y"), F.lit(None), F.lit("z"))).alias("uncertainties"))
    return sessions.continued(first, more).withColumn("uncertainties", F.array_join("uncertainties", ","))


@query("""
SELECT p.event_id AS purchase, (SELECT e.event_id FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' ORDER BY abs(epoch_us(date_trunc('day', e.ts)) - epoch_us(date_trunc('day', p.ts))), e.event_id % 7 DESC, e.event_id LIMIT 1) AS error FROM events p WHERE p.event_type = 'purchase'""")
def q_nearest_preferred(spark, d):
    """The error nearest in days to each purchase of a user; of several on such a day that of the greatest number by seven."""
    e = read(spark, d, "events", "user_id", "event_id", "event_type", "ts").withColumn("day", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))).withColumn("rank", F.col("event_id") % 7)
    p = e.where("event_type = 'purchase'").select("user_id", "day", F.col("event_id").alias("purchase"))
    r = e.where("event_type = 'error'").select("user_id", "day", "rank", F.col("event_id").alias("error"))
    return selection.nearest_pairs(p, r, ["user_id"], "day", "day", "purchase", "error", prefer="rank").select("purchase", "error")


@query("SELECT 'gateway' AS what, s_suppkey AS id FROM supplier WHERE s_nationkey % 5 <> 0 UNION ALL SELECT 'assignment', c_custkey FROM customer WHERE c_custkey % 150 NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 0)")
def q_cascade(spark, d):
    """Suppliers as gateways and customers as their assignments after some gateways are removed."""
    gates = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    used = read(spark, d, "customer", "c_custkey").withColumn("gate", F.col("c_custkey") % 150)
    left, rest = merging.cascade(gates, used, gates.where("s_nationkey % 5 = 0"), "s_suppkey", "gate")
    return left.select(F.lit("gateway").alias("what"), F.col("s_suppkey").alias("id")).union(rest.select(F.lit("assignment"), "c_custkey"))
