"""Queries that run recognition, contract and draft operators on rows made from the driver's tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattika.functions import text as T
from lattika.functions.nested import parse_checkpoint
from lattika.operators.matching import comparison
from lattika.operators.rounds import keep, spread
from lattika.plans import contracts, drafts, recognition
from lattika.plans.catalogue import query, read
from lattika.streaming import sessions


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# --- drafts ----------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (
  SELECT o_orderkey AS id, o_custkey % 30 < 25 AS a, o_orderkey % 28 < 25 AS b, s_suppkey IS NOT NULL AS c, s_suppkey IS NULL OR o_orderkey % 3 <> 0 OR s_nationkey % 2 = 1 AS d, o_orderstatus = 'F' AS e,
    o_orderpriority NOT LIKE '1%' AS f, o_orderpriority LIKE '1%' OR (o_orderpriority NOT LIKE '2%' AND o_orderstatus = 'F') AS g, o_orderkey % 4 <> 0 AS h, o_orderkey % 5 <> 0 AS i, o_orderkey % 6 <> 0 AS j, o_orderkey % 7 <> 0 AS k
  FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 110)
SELECT id AS transition, unnest(list_filter([CASE WHEN NOT a THEN 'source_missing' END, CASE WHEN NOT b THEN 'target_missing' END, CASE WHEN NOT c THEN 'trigger_missing' END, CASE WHEN NOT d THEN 'capability_not_owned' END,
  CASE WHEN NOT e THEN 'before_frame_missing' END, CASE WHEN NOT f THEN 'locator_frame_missing' END, CASE WHEN NOT g THEN 'locator_frame_differs' END, CASE WHEN NOT h THEN 'action_trace_missing' END,
  CASE WHEN NOT i THEN 'after_frame_missing' END, CASE WHEN NOT j THEN 'postcondition_open' END, CASE WHEN NOT k THEN 'assertions_missing' END], lambda x: x IS NOT NULL)) AS issue FROM t""")
def q_transition_issues(spark, d):
    """What orders lack as drafted transitions between nations, triggered by suppliers."""
    o, key = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    moves = o.select(
        key.alias("id"), _name("p", F.col("o_custkey") % 30).alias("source"), _name("p", key % 28).alias("target"), _name("e", key % 110).alias("trigger"), F.when(key % 3 == 0, "scroll").otherwise("tap").alias("capability"),
        F.when(F.col("o_orderstatus") == "F", "f1").otherwise("").alias("before_frame"), F.when(F.col("o_orderpriority").startswith("2"), "f2").when(~F.col("o_orderpriority").startswith("1"), "f1").alias("locator_frame"),
        F.when(key % 4 == 0, " ").otherwise("t").alias("action_trace"), F.when(key % 5 != 0, "g").alias("after_frame"), F.when(key % 6 == 0, "fail").otherwise("pass").alias("postcondition"),
        F.array(F.when(key % 7 == 0, " ").otherwise("a")).alias("assertions"),
    )
    pages = read(spark, d, "nation", "n_nationkey").select(_name("p", "n_nationkey").alias("page"))
    caps = F.when(F.col("s_nationkey") % 2 == 1, F.array(F.lit("tap"), F.lit("scroll"))).otherwise(F.array(F.lit("tap")))
    return drafts.draft_transition_issues(moves, pages, read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("e", "s_suppkey").alias("id"), caps.alias("capabilities")))


def _draft(spark, d):
    """Parts as draft elements: owners by size, keys by brand."""
    p, k = read(spark, d, "part", "p_partkey", "p_size", "p_brand", "p_name"), F.col("p_partkey")
    box = F.struct((k % 90).cast("double").alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("width"), F.lit(0.1).alias("height"))
    return p.select(
        _name("e", k).alias("id"), k.alias("pos"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("label"), F.concat("p_brand", F.lit("."), (k % 40).cast("string")).alias("candidateKey"),
        F.when(F.col("p_size") % 6 == 0, "").otherwise("image").alias("elementType"), box.alias("bbox"), F.lit(12).alias("gridColumns"), F.lit(12).alias("gridRows"), F.lit(1).alias("gridRegion"),
        F.when(F.col("p_size") < 10, _name("e", k + 7)).alias("parentId"), F.when(F.col("p_size") > 45, "application").otherwise("page").alias("ownerKind"), F.when(F.col("p_size") <= 45, _name("p", k % 3)).alias("pageId"),
        F.when(F.col("p_size") > 45, F.array(_name("p", k % 3), _name("p", (k + 1) % 3))).otherwise(F.array().cast("array<string>")).alias("availableOnPageIds"),
        F.when(F.col("p_size") % 4 == 0, F.array(F.lit("none"), F.lit("tap"))).otherwise(F.array(F.lit("tap"))).alias("capabilities"), F.array(F.lit("x")).alias("actionEffects"),
        F.when(F.col("p_size") % 9 == 0, "rejected").when(F.col("p_size") % 8 == 0, "pending").otherwise("accepted").alias("reviewStatus"), F.array().cast("array<string>").alias("riskSignals"),
    )


_ON = """
WITH RECURSIVE e AS (
  SELECT p_partkey AS k, p_size, p_brand || '.' || p_partkey % 40 AS key, CASE WHEN p_size < 10 THEN p_partkey + 7 END AS parent, p_size > 45 AS app, CASE WHEN p_size <= 45 THEN 'p' || p_partkey % 3 END AS page,
    CASE WHEN p_size > 45 THEN ['p' || p_partkey % 3, 'p' || (p_partkey + 1) % 3] ELSE [] END AS pages FROM part),
up(k, at_) AS (SELECT k, k FROM e UNION SELECT up.k, e.parent FROM up JOIN e ON up.at_ = e.k WHERE e.parent IS NOT NULL),
on_ AS (SELECT DISTINCT k, page FROM (SELECT k, page FROM e WHERE page IS NOT NULL UNION ALL SELECT up.k, unnest(e.pages) FROM up JOIN e ON at_ = e.k WHERE app)),
pairs AS (SELECT a.k, b.k AS other, EXISTS (SELECT 1 FROM on_ x JOIN on_ y ON x.page = y.page WHERE x.k = a.k AND y.k = b.k) AS common FROM e a JOIN e b ON a.key = b.key AND a.k <> b.k),
dup AS (SELECT DISTINCT k, 'candidate_key_duplicate_' || CASE WHEN common THEN 'current' ELSE 'other' END || '_page' AS code FROM pairs)"""


@query(_ON + """
SELECT code, key, coalesce(array_to_string((SELECT list_sort(list(page)) FROM on_ WHERE on_.k = e.k), ','), '') AS pages, array_to_string(list_sort(list('e' || e.k)), ',') AS elements FROM dup JOIN e ON dup.k = e.k GROUP BY ALL""")
def q_grouped_duplicates(spark, d):
    """Parts that share a key, by key and by the pages they are on."""
    found = drafts.grouped_duplicates(_draft(spark, d), keep)
    return found.select("code", "key", F.array_join("pages", ",").alias("pages"), F.array_join("elements", ",").alias("elements"))


@query(_ON + """
SELECT i.l AS level, i.c AS code, 'e' || k AS element FROM (
  SELECT k, unnest([
    CASE WHEN p_size % 5 = 0 AND p_size % 9 <> 0 THEN {'l': 'error', 'c': 'label_required'} END, CASE WHEN p_size % 6 = 0 AND p_size % 9 <> 0 THEN {'l': 'error', 'c': 'element_type_required'} END,
    CASE WHEN k % 90 > 0 THEN {'l': 'error', 'c': 'bbox_invalid'} END, {'l': 'error', 'c': 'grid_region_invalid'}, CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT k FROM e) THEN {'l': 'error', 'c': 'parent_missing'} END,
    CASE WHEN p_size % 4 = 0 THEN {'l': 'error', 'c': 'capability_none_conflict'} END, CASE WHEN p_size % 4 = 0 THEN {'l': 'warning', 'c': 'action_effect_missing'} END,
    CASE WHEN p_size % 8 = 0 AND p_size % 9 <> 0 THEN {'l': 'warning', 'c': 'review_pending'} END]) AS i FROM e
  UNION ALL SELECT k, {'l': 'error', 'c': code} FROM dup) WHERE i IS NOT NULL
UNION ALL SELECT 'error', 'transition_evidence_incomplete', NULL FROM orders, range(10) WHERE o_orderkey % 100 = 0 AND range < 9""")
def q_client_issues(spark, d):
    """What an editor would say of parts as elements and of some orders as transitions without evidence."""
    none = F.lit(None).cast("string")
    moves = read(spark, d, "orders", "o_orderkey").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("id"), *[none.alias(c) for c in ("source", "target", "trigger", "capability", "before_frame", "locator_frame", "action_trace", "after_frame", "postcondition")], F.array().cast("array<string>").alias("assertions"))
    return drafts.client_issues(_draft(spark, d), moves, read(spark, d, "nation", "n_nationkey").select(_name("p", "n_nationkey").alias("page")), keep)


@query("""
WITH p AS (SELECT 'p' || n_nationkey AS page, 'k' || n_regionkey AS key, n_name AS name, 'f' || n_nationkey AS frames, '2026' AS published_at FROM nation), has AS (SELECT count(*) > 0 AS h FROM customer WHERE c_nationkey = 3)
SELECT page, key, name, CASE WHEN page = 'p3' AND NOT h THEN 'new' ELSE frames END AS frames, CASE WHEN page = 'p3' AND NOT h THEN NULL ELSE published_at END AS published_at FROM p, has
UNION ALL SELECT 'p99', 'page.capture.' || substr(sha256('p99'), 1, 8), '', 'new', NULL FROM has WHERE h""")
def q_begin_capture(spark, d):
    """Nations as pages after a frame came in while the page of nation 3 was current, which has customers as elements."""
    n = F.col("n_nationkey")
    pages = read(spark, d, "nation", "n_nationkey", "n_regionkey", "n_name").select(_name("p", n).alias("page"), _name("k", "n_regionkey").alias("key"), F.col("n_name").alias("name"), F.array(_name("f", n)).alias("frames"), F.lit("2026").alias("published_at"))
    elements = read(spark, d, "customer", "c_nationkey").select(_name("p", "c_nationkey").alias("page"))
    return drafts.begin_capture(pages, elements, "new", "p3", "p99").withColumn("frames", F.array_join("frames", ","))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'text-button' WHEN p_size % 3 = 1 THEN 'image' ELSE '' END AS elementType, CASE WHEN p_size % 2 = 0 THEN 'tap' ELSE 'none' END AS capabilities,
  CASE WHEN p_size % 2 = 1 THEN 'none' WHEN p_size % 4 = 0 THEN 'row' ELSE 'candidate_bbox' END AS interactionBoundary, CASE WHEN p_size > 45 THEN NULL WHEN p_size > 20 THEN 'p1' ELSE 'now' END AS pageId,
  CASE WHEN p_size > 45 THEN 'now' ELSE '' END AS pages, CASE WHEN p_size % 7 = 0 THEN 'human' WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'import' ELSE 'ai' END AS source,
  CASE WHEN p_size % 5 <> 0 THEN 'accepted' WHEN p_size % 7 = 0 OR p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'edited' ELSE 'pending' END AS reviewStatus FROM part""")
def q_shaped_elements(spark, d):
    """Parts as elements with defaults filled in; edits are backed by suppliers of equal number."""
    p, size = read(spark, d, "part", "p_partkey", "p_size"), F.col("p_size")
    none = F.lit(None).cast("string")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.when(size % 3 == 0, "menu-item").when(size % 3 == 1, "image").otherwise("odd").alias("elementType"), F.when(size % 2 == 0, F.array(F.lit("tap"), F.lit("none"), F.lit("tap"))).otherwise(F.array(F.lit("fly"))).alias("capabilities"),
        F.when(size % 4 == 0, "row").otherwise("none").alias("interactionBoundary"), F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height")).alias("bbox"), none.cast("int").alias("gridColumns"), none.cast("int").alias("gridRows"),
        F.when(size > 45, "application").otherwise("page").alias("ownerKind"), F.when((size > 20) & (size <= 45), "p1").alias("pageId"), F.lit(None).cast("array<string>").alias("availableOnPageIds"), F.when(size % 7 == 0, "human").otherwise("import").alias("source"), F.when(size % 5 == 0, "edited").otherwise("accepted").alias("reviewStatus"),
    )
    edited = read(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"))
    found = drafts.shaped_elements(rows, edited, "now", ["image", "text-button"], {"menu-item": "text-button"}, ["tap"])
    return found.select("id", "elementType", F.array_join("capabilities", ",").alias("capabilities"), "interactionBoundary", "pageId", F.array_join("availableOnPageIds", ",").alias("pages"), "source", "reviewStatus")


@query("""
WITH e AS (SELECT 'e' || p_partkey AS id, p_partkey AS pos, CASE WHEN p_size > 45 THEN ['p' || p_partkey % 3, 'p' || (p_partkey + 1) % 3] ELSE ['p' || p_partkey % 3] END AS pages FROM part),
l AS (SELECT id, pos, unnest(pages) AS page FROM e)
SELECT page, coalesce(array_to_string(list(id ORDER BY pos) FILTER (id IS NOT NULL), ','), '') AS elements FROM (SELECT 'p' || n_nationkey AS page FROM nation) LEFT JOIN l USING (page) GROUP BY page""")
def q_page_elements(spark, d):
    """The parts that nations list as pages."""
    pages = read(spark, d, "nation", "n_nationkey").select(_name("p", "n_nationkey").alias("page"))
    return drafts.page_elements(pages, _draft(spark, d)).withColumn("elements", F.array_join("elements", ","))


@query("""
WITH RECURSIVE e AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - c_custkey % 4 END AS asked, CASE WHEN c_custkey % 20 = 0 THEN 'application' ELSE 'page' END AS kind, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || c_nationkey END AS page FROM customer),
r AS (SELECT id, CASE WHEN asked IN (SELECT id FROM e) THEN asked END AS parent, kind, page FROM e),
j AS (SELECT r.*, t.kind AS top_kind, t.page AS top_page FROM r JOIN r t ON coalesce(r.parent, r.id) = t.id)
SELECT CAST(id AS VARCHAR) AS id, CAST(parent AS VARCHAR) AS parent, CASE WHEN parent IS NULL THEN kind WHEN top_kind = 'application' THEN 'shared_component' ELSE 'component' END AS owner_kind,
  CASE WHEN parent IS NOT NULL THEN CAST(parent AS VARCHAR) WHEN kind = 'application' THEN 'app' ELSE coalesce(page, 'now') END AS owner,
  CASE WHEN parent IS NULL THEN page WHEN top_kind = 'application' THEN NULL ELSE coalesce(top_page, page, 'now') END AS page,
  coalesce((SELECT array_to_string(list(c.id ORDER BY c.id), ',') FROM r c WHERE c.parent = j.id), '') AS children FROM j""")
def q_owned(spark, d):
    """Customers as elements: every fourth is a parent of the three after it, every twentieth belongs to the application."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer", "c_custkey", "c_nationkey").select(
        k.cast("string").alias("id"), k.alias("pos"), F.when(k % 4 != 0, (k - k % 4).cast("string")).alias("parent"), F.when(k % 20 == 0, "application").otherwise("page").alias("owner_kind"), F.when(k % 3 != 0, _name("p", "c_nationkey")).alias("page")
    )
    return drafts.owned(rows, "app", "now", keep).drop("pos").withColumn("children", F.array_join("children", ","))


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS a, o_orderkey % 5 AS b, o_orderkey % 7 AS c, o_orderkey % 11 AS e FROM orders)
SELECT 'time_invalid' AS rule, CAST(k AS VARCHAR) AS subject, '$.createdAt' AS detail FROM r WHERE a = 0 AND b <> 2 UNION ALL SELECT 'time_invalid', CAST(k AS VARCHAR), '$.list[0].seenAt' FROM r WHERE b = 1 OR b = 3
UNION ALL SELECT 'extension_key', CAST(k AS VARCHAR), '$.extensions.plain' FROM r WHERE b = 0 UNION ALL SELECT 'not_json', CAST(k AS VARCHAR), '$' FROM r WHERE b = 2
UNION ALL SELECT 'number_not_finite', CAST(k AS VARCHAR), '$.n' FROM r WHERE c = 1 AND b <> 2 UNION ALL SELECT 'id_after_time', CAST(k AS VARCHAR), '$.id' FROM r WHERE e = 1 AND b <> 2 AND c <> 1""")
def q_serialization_errors(spark, d):
    """Orders as JSON records with odd times, numbers, extension keys and identifiers, and broken texts. Identifiers of 2^41 ms are of 2039, those of 0 ms of 1970."""
    k = F.col("o_orderkey")
    made = F.when(k % 3 == 0, "2026-01-01").otherwise("2026-01-01T00:00:00.500Z")
    seen = F.when(k % 5 == 1, F.lit('"noon"')).when(k % 5 == 3, F.lit("null")).otherwise(F.lit('"2026-01-01T00:00:00Z"'))
    number, late = F.when(k % 7 == 1, "NaN").otherwise("1e-7"), F.when(k % 11 == 1, F.lit("01ZZZZZZZZ")).otherwise(F.lit("0000000000"))
    text = F.concat(F.lit('{"id":"'), late, F.lit('0000000000000000","recordedAt":"2026-01-01T00:00:00Z","n":'), number, F.lit(',"createdAt":"'), made, F.lit('","list":[{"seenAt":'), seen, F.lit('}],"extensions":{"'), F.when(k % 5 == 0, "plain").otherwise("com.example.x"), F.lit('":{"innerAt":"2026-01-01T00:00:00Z"}}'), F.when(k % 5 == 2, "").otherwise("}"))
    rows = read(spark, d, "orders", "o_orderkey").select("o_orderkey", text.alias("record"))
    return drafts.serialization_errors(rows, "o_orderkey", "record")


# --- recognition -----------------------------------------------------------------------------------------------------

_SEEN = """
WITH e AS (SELECT l_orderkey AS result, 'k' || l_partkey % 5 AS key, l_linenumber AS pos, l_linenumber % 2 = 0 AS interactive, l_discount * 9 AS x, l_tax * 5 AS w FROM lineitem),
f AS (SELECT result, key, first(interactive ORDER BY pos) AS interactive, last(interactive ORDER BY pos) AS last_one, max(pos) AS pos, count(*) AS n FROM e GROUP BY 1, 2),
o AS (SELECT o_orderkey AS result, 'k' || o_custkey % 5 AS a, 'k' || o_orderkey % 5 AS b, 'k' || o_orderkey % 7 AS t, CASE WHEN o_orderstatus = 'P' THEN 'f' END AS basis, CASE WHEN o_orderpriority LIKE '5%' THEN 'requested' ELSE 'not-requested' END AS status FROM orders)"""


def _seen(spark, d):
    lines = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax")
    elements = lines.select(F.col("l_orderkey").alias("result"), _name("k", F.col("l_partkey") % 5).alias("key"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") % 2 == 0).alias("interactive"), (F.col("l_discount") * 9).alias("x"), F.lit(0.5).alias("y"), (F.col("l_tax") * 5).alias("width"), F.lit(0.5).alias("height"), F.array().cast("array<string>").alias("risk_signals"))
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").withColumn("result", F.col("o_orderkey"))
    relations = o.select("result", _name("k", F.col("o_custkey") % 5).alias("from_key"), _name("k", F.col("o_orderkey") % 5).alias("to_key"))
    actions = o.select("result", _name("k", F.col("o_orderkey") % 7).alias("trigger"))
    asked = o.select("result", F.when(F.col("o_orderstatus") == "P", "f").alias("basis"), F.when(F.col("o_orderpriority").startswith("5"), "requested").otherwise("not-requested").alias("status"))
    return elements, relations, actions, asked


@query(_SEEN + """
SELECT result, 'key_repeated' AS code, key AS subject FROM f, range(1, 100) r(i) WHERE i < n UNION ALL SELECT result, 'box_outside', key FROM e WHERE x + w > 1
UNION ALL SELECT result, 'relation_unknown', a || ' -> ' || b FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.result = o.result AND key = a) OR NOT EXISTS (SELECT 1 FROM f WHERE f.result = o.result AND key = b)
UNION ALL SELECT o.result, CASE WHEN f.key IS NULL THEN 'action_unknown' ELSE 'action_not_interactive' END, t FROM o LEFT JOIN f ON f.result = o.result AND key = t WHERE f.key IS NULL OR NOT interactive
UNION ALL SELECT result, 'comparison_requested', status FROM o WHERE basis IS NOT NULL OR status <> 'not-requested'""")
def q_consistency_issues(spark, d):
    """What contradicts itself where orders are answers and line items their elements."""
    return recognition.consistency_issues(*_seen(spark, d))


@query(_SEEN + """
SELECT 'action' AS kind, o.result, t AS key FROM o JOIN f ON f.result = o.result AND key = t WHERE last_one UNION ALL SELECT 'marked', e.result, e.key FROM e JOIN f ON f.result = e.result AND f.key = e.key AND f.pos = e.pos JOIN o ON o.result = e.result AND t = e.key WHERE NOT last_one""")
def q_prepared_actions(spark, d):
    """Actions that stay in such answers, and elements that are marked since theirs do not."""
    elements, _, actions, _ = _seen(spark, d)
    elements, actions = recognition.prepared_actions(elements, actions)
    marked = elements.where(F.size("risk_signals") > 0).select(F.lit("marked").alias("kind"), "result", "key")
    return actions.select(F.lit("action").alias("kind"), "result", F.col("trigger").alias("key")).union(marked)


@query("""
WITH p AS (SELECT p_partkey AS id, p_size % 2 AS a, p_size % 3 AS b, p_size % 5 AS c, p_size % 7 AS e, p_brand FROM part)
SELECT id, CASE WHEN b = 0 THEN 'own' WHEN a = 0 THEN 'alias' END AS candidate_key, CASE c WHEN 0 THEN 'text-button' WHEN 1 THEN 'image' ELSE '' END AS element_type,
  CASE WHEN e = 1 THEN 'unknown' WHEN e IN (0, 2) THEN 'known' WHEN e = 3 THEN 'candidate' ELSE 'known' END AS status, CASE WHEN e IN (0, 2) THEN p_brand || '|' WHEN e >= 4 THEN p_brand ELSE '' END AS texts,
  CASE WHEN e IN (0, 2) THEN 'visibleTexts-invalid=5' WHEN e = 3 THEN 'hue={"r":1}' ELSE '' END AS notes, CAST(CASE WHEN e = 6 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence,
  CAST((a = 0)::INT + (c <> 1)::INT + CASE WHEN e IN (0, 2) THEN 1 WHEN e = 1 THEN 2 WHEN e = 3 THEN 2 WHEN e = 6 THEN 2 ELSE 1 END AS INT) AS issues,
  list_sort(list_filter([CASE WHEN c > 1 THEN 'element-type-needs-review' END, CASE WHEN e <> 9 THEN 'meaning-evidence-needs-review' END], lambda x: x IS NOT NULL))[1] AS first_risk FROM p""")
def q_normalized_elements(spark, d):
    """Answers about parts, with aliases, odd types and evidence of every shape, repaired."""
    p, size, brand = spread(read(spark, d, "part", "p_partkey", "p_size", "p_brand"), "p_partkey"), F.col("p_size"), F.col("p_brand")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    keys = F.concat(F.when(size % 3 == 0, '"candidateKey":"own",').otherwise(""), F.when(size % 2 == 0, '"candidate_key":" alias ",').otherwise(""))
    kind = F.when(size % 5 == 0, "menu-item").when(size % 5 == 1, "image").otherwise("odd")
    listed = F.concat(F.lit('{"status":"known","description":null,"evidence":{"visibleTexts":['), quoted(F.concat(F.lit(" "), brand)), F.lit(',5,""]}}'))
    said = (
        F.when(size % 7 == 1, '{"status":"sure"}').when((size % 7).isin(0, 2), listed).when(size % 7 == 3, '{"status":"known","description":"d","evidence":{"hue":{"r":1}}}')
        .otherwise(F.concat(F.lit('{"status":"known","description":"d","evidence":{"visibleTexts":'), quoted(brand), F.lit("}"), F.when(size % 7 == 6, ',"confidence":0.25').otherwise(""), F.lit("}")))
    )
    text = F.concat(F.lit("{"), keys, F.lit('"elementType":'), quoted(kind), F.when(size % 7 == 6, "").otherwise(',"confidence":0.5'), F.lit(',"meaning":'), said, F.lit("}"))
    found = recognition.normalized(p.select(F.col("p_partkey").alias("id"), text.alias("element")), ["image", "text-button"], {"menu-item": "text-button"})
    texts = F.col("meaning.evidence")["visibleTexts"]
    notes = F.array_join(F.transform("meaning.unclassified", lambda n: F.concat(n["type"], F.lit("="), n["detail"])), ",")
    shown = F.concat(F.array_join(texts, "|"), F.when((F.size(texts) > 0) & (F.size("meaning.unclassified") > 0), "|").otherwise(""))
    return found.select("id", "candidate_key", "element_type", F.col("meaning.status").alias("status"), shown.alias("texts"), notes.alias("notes"), "confidence", F.size("issues").alias("issues"), F.get(F.array_sort("risk_signals"), F.lit(0)).alias("first_risk"))


@query("SELECT p_partkey AS id, p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AS complete FROM part")
def q_complete_elements(spark, d):
    """Whether recovered answers about parts are complete."""
    size = F.col("p_size")
    head = '{"visualDescription":"v","elementType":"image","geometryKind":"boundary","geometryConfidence":0.5,"approximateRegion":{"x":0},"confidence":1'
    text = F.concat(F.lit(head), F.when(size % 2 == 0, ',"candidateKey":" "').otherwise(',"candidate_key":"k"'), F.when(size % 3 == 0, ',"interactive":"yes"').otherwise(',"interactive":true'), F.when(size % 5 == 0, ',"meaning":{}}').otherwise(',"meaning":{"dynamicContent":false}}'))
    return read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("id"), recognition.complete(text).alias("complete"))


@query("""
SELECT c_custkey AS frame, CASE WHEN c_custkey % 10 = 0 THEN 'rn' WHEN c_custkey % 10 = 1 THEN 'h5' WHEN coalesce(rn, false) THEN 'rn' WHEN coalesce(h5, false) OR c_custkey % 10 = 2 THEN 'h5' WHEN rn IS NOT NULL THEN 'native' ELSE 'unknown' END AS kind
FROM customer LEFT JOIN (SELECT user_id, bool_or(event_type = 'signup') AS rn, bool_or(event_type = 'error') AS h5 FROM events WHERE event_id % 5 = 0 GROUP BY 1) ON user_id = c_custkey""")
def q_implementation(spark, d):
    """How customers' screens are made, by events as nodes and by activities."""
    kind = F.when(F.col("event_type") == "signup", "com.facebook.react.View").when(F.col("event_type") == "error", "android.webkit.webview").otherwise("android.view.View")
    nodes = read(spark, d, "events", "event_id", "user_id", "event_type").where("event_id % 5 = 0").select(F.col("user_id").alias("frame"), kind.alias("class"), F.lit(None).cast("string").alias("package"))
    k = F.col("c_custkey")
    frames = read(spark, d, "customer", "c_custkey").select(k.alias("frame"), F.when(k % 10 == 2, "h5cache").alias("package"), F.when(k % 10 == 0, "ZRNActivity").when(k % 10 == 1, "H5Page").alias("activity"))
    return recognition.implementation(nodes, frames)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'disabled' WHEN c_custkey % 5 = 0 THEN 'unresolved' WHEN c_mktsegment = 'BUILDING' OR c_name LIKE '%1' THEN 'skipped_policy' WHEN c_nationkey < 12 THEN 'eligible_for_safe_exploration' ELSE 'skipped_risk' END AS action,
  CASE WHEN c_custkey % 4 = 0 THEN 'container' WHEN c_custkey % 4 = 1 THEN 'status_indicator' WHEN c_nationkey % 2 = 0 THEN 'action_trigger' ELSE 'content_anchor' END AS role FROM customer""")
def q_actionability(spark, d):
    """Customers as controls under a policy whose first pattern is no regular expression; and what they are for."""
    c, k = read(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"), F.col("c_custkey")
    label = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "x BUILD(").otherwise(""), "c_name")
    refused = T.pattern_found(F.lit("build("), label) | T.pattern_found(F.lit("CUSTOMER.*1$"), label)
    action = recognition.actionability(k % 7 != 0, F.when(F.col("c_nationkey") < 12, "safe").otherwise("high"), F.when(k % 5 == 0, "unknown").otherwise("button"), refused, F.array(F.lit("safe")))
    role = recognition.role(F.when(k % 4 == 0, "container").when(k % 4 == 1, "badge").otherwise("image"), F.col("c_nationkey") % 2 == 0)
    return c.select("c_custkey", action.alias("action"), role.alias("role"))


@query("""
WITH a AS (SELECT o_orderkey AS answer, 's' || o_orderkey % 3 AS state, o_custkey % 2 AS a, o_custkey % 3 AS b, o_custkey % 5 AS c FROM orders), e AS (SELECT l_orderkey AS answer, l_partkey % 4 AS k, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT answer, 'frame_differs' AS rule, 'g' AS detail FROM a WHERE a = 0 UNION ALL SELECT answer, 'page_missing', NULL FROM a WHERE b = 0 UNION ALL SELECT answer, 'lists_missing', NULL FROM a WHERE c = 0
UNION ALL SELECT answer, 'candidate_missing', 'k' || i FROM a, range(3) r(i) WHERE i <= answer % 3 AND NOT EXISTS (SELECT 1 FROM e WHERE e.answer = a.answer AND k = i)
UNION ALL SELECT answer, 'region_invalid', 'k' || k FROM e WHERE q > 40 UNION ALL SELECT answer, 'special_missing', 'k1' FROM a WHERE state = 's2' AND NOT EXISTS (SELECT 1 FROM e WHERE e.answer = a.answer AND k = 1 AND n % 2 = 0)""")
def q_worker_errors(spark, d):
    """Why orders are refused as answers of workers."""
    o, c = read(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("o_custkey")
    full = F.array(F.lit("x"))
    answers = o.select(F.col("o_orderkey").alias("answer"), _name("s", F.col("o_orderkey") % 3).alias("state"), F.lit("f").alias("expected_frame"), F.when(c % 2 == 0, "g").otherwise("f").alias("frame"), F.when(c % 3 != 0, "p").alias("page"), full.alias("relationships"), F.when(c % 5 != 0, full).alias("uncertainties"))
    lines = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    half = F.lit(0.5)
    elements = lines.select(F.col("l_orderkey").alias("answer"), _name("k", F.col("l_partkey") % 4).alias("key"), F.lit("icon-button").alias("type"), (F.col("l_linenumber") % 2 == 0).alias("interactive"), half.alias("x"), half.alias("y"), F.when(F.col("l_quantity") > 40, 1.5).otherwise(0.5).alias("width"), half.alias("height"))
    required = spark.createDataFrame([(f"s{s}", f"k{k}") for s in range(3) for k in range(s + 1)], "state string, key string")
    return recognition.worker_errors(answers, elements, required, [("2", "k1", "icon-button")])


# --- contracts -------------------------------------------------------------------------------------------------------


@query("""
SELECT 'relation_missing' AS rule, 'e' || s_suppkey AS subject, 'authority_contract:c' || o_orderkey AS detail FROM orders JOIN supplier ON o_custkey = s_suppkey WHERE o_orderkey % 4 <> s_suppkey % 4""")
def q_missing_relations(spark, d):
    """Suppliers that do not name the orders that they trigger."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey")
    named = o.where(F.col("o_orderkey") % 4 == F.col("o_custkey") % 4).groupBy("o_custkey").agg(F.collect_list(_name("authority_contract:c", "o_orderkey")).alias("relations"))
    elements = read(spark, d, "supplier", "s_suppkey").join(named, F.col("s_suppkey") == F.col("o_custkey"), "left").select(_name("e", "s_suppkey").alias("id"), "relations")
    return contracts.missing_relations(elements, o.select(_name("c", "o_orderkey").alias("id"), _name("e", "o_custkey").alias("trigger")))


@query("""
WITH c AS (SELECT o_orderkey AS k, ['pending', 'verified', 'contradicted', 'odd'][o_orderkey % 4 + 1] AS status, o_custkey FROM orders)
SELECT 'status_unknown' AS rule, CAST(k AS VARCHAR) AS subject, status AS detail FROM c WHERE status = 'odd' UNION ALL SELECT 'defect_missing', CAST(k AS VARCHAR), status FROM c WHERE status = 'contradicted' AND o_custkey % 2 = 0
UNION ALL SELECT 'transition_missing', CAST(k AS VARCHAR), 't' || o_custkey FROM c WHERE status = 'verified' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'transition_differs', CAST(k AS VARCHAR), 't' || o_custkey FROM c JOIN supplier ON s_suppkey = o_custkey WHERE status = 'verified' AND (s_nationkey > 20 OR k % 3 <> s_suppkey % 3)""")
def q_verification_errors(spark, d):
    """Orders as contracts, verified by suppliers as transitions."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    states = F.array(*map(F.lit, ("pending", "verified", "contradicted", "odd")))
    agreed = read(spark, d, "orders", "o_orderkey", "o_custkey").select(k.alias("key"), F.get(states, (k % 4).cast("int")).alias("status"), _name("t", "o_custkey").alias("verified"), F.array(*[F.lit(f"p{i}") for i in range(21)]).alias("pages"), F.lit("e").alias("trigger"), (k % 3).cast("string").alias("capability"), F.lit("q").alias("target"), F.when(F.col("o_custkey") % 2 == 1, "bug").alias("defect"))
    moves = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("t", s).alias("id"), _name("p", "s_nationkey").alias("source"), F.lit("e").alias("trigger"), (s % 3).cast("string").alias("capability"), F.lit("q").alias("target"))
    return contracts.verification_errors(agreed, moves)


@query("""
WITH c AS (SELECT p_partkey AS k, 'c' || p_partkey AS detail, p_size FROM part)
SELECT 'fact_incomplete' AS rule, CAST(k AS VARCHAR) AS subject, 'fact' AS detail FROM c WHERE p_size % 11 = 0
UNION ALL SELECT 'label_text_actionable', CAST(k AS VARCHAR), 'true' FROM c WHERE p_size % 11 <> 0 AND p_size % 7 = 0 UNION ALL SELECT 'part_unresolved', CAST(k AS VARCHAR), 'fact' FROM c WHERE p_size % 11 <> 0 AND p_size % 13 = 0
UNION ALL SELECT r.rule, CAST(k AS VARCHAR), detail FROM c, (VALUES ('children_differ', 2), ('container_owner', 3), ('label_kind', 5), ('trigger_differs', 8), ('child_listed', 9)) r(rule, n) WHERE p_size % 11 <> 0 AND p_size % 13 <> 0 AND p_size % r.n = 0
UNION ALL SELECT 'container_unlisted', CAST(k AS VARCHAR), detail FROM c WHERE p_size % 11 <> 0 AND p_size % 13 <> 0 AND p_size % 4 = 1""")
def q_component_errors(spark, d):
    """Parts as certified components, with one kind of fault for each divisor of their size."""
    p, size = read(spark, d, "part", "p_partkey", "p_size"), F.col("p_size")
    c, label, button, page = (_name(x, "p_partkey") for x in "clbp")
    fact = F.create_map(F.lit("visibleLabel"), F.lit("v"), F.lit("actionableControl"), F.lit("a"), F.lit("labelTextActionable"), F.when(size % 7 == 0, "true").otherwise("false"), F.lit("containerElementRef"), c, F.lit("labelElementRef"), label, F.lit("triggerElementRef"), F.when(size % 13 == 0, "gone").otherwise(button))
    fact = F.when(size % 11 == 0, F.create_map(F.lit("visibleLabel"), F.lit("v"))).otherwise(fact)
    agreed = p.select(F.col("p_partkey").alias("key"), page.alias("source"), F.when(size % 8 == 0, "other").otherwise(button).alias("trigger"), fact.alias("fact"))
    none = F.array().cast("array<string>")
    boxes = p.select(c.alias("id"), F.lit("container").alias("type"), F.when(size % 3 == 0, "application").otherwise("page").alias("owner_kind"), page.alias("owner"), F.when(size % 2 == 0, F.array(label)).otherwise(F.array(button, label)).alias("children"), none.alias("capabilities"), F.lit(False).alias("actionable"))
    labels = p.select(label, F.when(size % 5 == 0, "image").otherwise("text_label"), F.lit("component"), c, none, none, F.lit(False))
    buttons = p.select(button, F.lit("button"), F.lit("component"), c, none, F.array(F.lit("tap")), F.lit(True))
    listed = F.concat(F.when(size % 4 == 1, none).otherwise(F.array(c)), F.when(size % 9 == 0, F.array(label)).otherwise(none))
    return contracts.component_errors(agreed, boxes.union(labels).union(buttons), p.select(page.alias("id"), listed.alias("elements")))


@query("""
WITH j AS (SELECT o_orderkey AS k, s_suppkey AS s, s_nationkey AS n FROM orders JOIN supplier ON s_suppkey = o_custkey)
SELECT 'trigger_protected' AS rule, CAST(k AS VARCHAR) AS subject, CAST(s AS VARCHAR) AS detail FROM j WHERE n = 3 UNION ALL SELECT 'trigger_not_actionable', CAST(k AS VARCHAR), CAST(s AS VARCHAR) FROM j WHERE n % 2 = 0
UNION ALL SELECT 'capability_missing', CAST(k AS VARCHAR), 'swipe' FROM j WHERE k % 3 = 0""")
def q_trigger_errors(spark, d):
    """Orders whose supplier may not be their trigger."""
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    elements = s.select(F.col("s_suppkey").alias("id"), F.array(F.lit("tap")).alias("capabilities"), F.when(F.col("s_nationkey") % 2 == 1, True).alias("actionable"))
    edges = read(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("trigger"), F.when(F.col("o_orderkey") % 3 == 0, "swipe").otherwise("tap").alias("capability"))
    return contracts.trigger_errors(edges, elements, s.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey % 25 AS page, l_suppkey + l_linenumber AS id FROM lineitem)
SELECT CASE WHEN s_suppkey IS NULL THEN 'element_missing' ELSE 'element_not_available' END AS rule, CAST(page AS VARCHAR) AS subject, CAST(id AS VARCHAR) AS detail FROM l LEFT JOIN supplier ON s_suppkey = id
WHERE s_suppkey IS NULL OR NOT CASE WHEN s_acctbal > 0 THEN page = s_nationkey ELSE page IN (s_nationkey, (s_nationkey + 1) % 25) END""")
def q_page_element_errors(spark, d):
    """Suppliers that pages list without owning them or being offered them."""
    lines = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    pages = lines.groupBy((F.col("l_orderkey") % 25).alias("id")).agg(F.collect_set(F.col("l_suppkey") + F.col("l_linenumber")).alias("elements"))
    n = F.col("s_nationkey").cast("long")
    elements = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "page").otherwise("application").alias("owner_kind"), n.alias("owner"), F.array(n, (n + 1) % 25).alias("available"))
    return contracts.page_element_errors(pages, elements)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q_lost_ids(spark, d):
    """Customers of orders that are neither in credit nor suppliers' numbers."""
    actual = read(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return contracts.lost_ids(read(spark, d, "orders", "o_custkey").toDF("id"), actual, read(spark, d, "supplier", "s_suppkey").toDF("id"), "id")


@query("""
WITH f AS (SELECT p_partkey AS k, p_size % 5 AS n, p_size % 3 = 0 AS wrong FROM part), g AS (SELECT *, array_to_string(list_transform(range(n), lambda i: 'd' || i), '/') AS dir FROM f), h AS (SELECT *, CASE WHEN n = 0 THEN '' ELSE dir || '/' END || k || '.yaml' AS path FROM g)
SELECT 'path_depth' AS rule, path AS subject, CAST(n AS VARCHAR) AS detail FROM h WHERE n NOT BETWEEN 1 AND 3 UNION ALL SELECT 'path_differs', path, 'x' FROM h WHERE wrong UNION ALL SELECT 'feature_path_length', path, CAST(n AS VARCHAR) FROM h WHERE NOT wrong AND n NOT BETWEEN 1 AND 3""")
def q_path_errors(spark, d):
    """Parts as files in folders of other depths or names than their records say."""
    n = F.col("p_size") % 5
    folders = F.slice(F.array(*[F.lit(f"d{i}") for i in range(4)]), F.lit(1), n)
    path = F.concat_ws("/", folders, F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")))
    return contracts.path_errors(read(spark, d, "part", "p_partkey", "p_size").select(path.alias("path"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("x"))).otherwise(folders).alias("feature_path")))


@query("SELECT p_brand AS profile, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def q_profile_counts(spark, d):
    """Large parts of each brand."""
    return contracts.profile_counts(read(spark, d, "part", "p_brand", "p_size").select(F.when(F.col("p_size") > 10, F.col("p_brand")).alias("profile")))


_TRACES = """
WITH j AS (SELECT o_orderkey AS k, o_custkey AS a, c_mktsegment <> 'BUILDING' AND c_acctbal > 0 AS ok, CASE WHEN s.s_suppkey IS NOT NULL THEN c_custkey % 150 END AS before, t.s_suppkey AS after
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier s ON s.s_suppkey = c_custkey % 150 LEFT JOIN supplier t ON t.s_suppkey = o_orderkey % 120)"""


@query(_TRACES + """
SELECT CAST(k AS VARCHAR) AS transition, CASE WHEN NOT ok THEN 'action_not_verified' WHEN before IS NULL OR after IS NULL THEN 'frame_missing' ELSE 'f' || before || '>f' || after END AS found FROM j""")
def q_live_traces(spark, d):
    """Orders as transitions: their customers' action, the frame before by id and after by state; or why there is none."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    bindings = read(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("transition"), F.col("o_custkey").alias("action"), _name("s", F.col("o_orderkey") % 120).alias("after_state"))
    actions = read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").select(c.alias("action"), F.when(F.col("c_mktsegment") != "BUILDING", "executed_verified").otherwise("open").alias("status"), (F.col("c_acctbal") > 0).alias("passed"), _name("f", c % 150).alias("before_frame"))
    frames = read(spark, d, "supplier", "s_suppkey").select(_name("f", s).alias("frame"), _name("s", s).alias("state"))
    traces, errors = contracts.live_traces(bindings, actions, frames)
    return traces.select(F.col("transition").cast("string").alias("transition"), F.concat("before", F.lit(">"), "after").alias("found")).union(errors.select("subject", "rule"))


@query("""
SELECT l_suppkey AS transition, l_returnflag AS reason, s_nationkey AS source, CAST(s_suppkey % 25 AS INT) AS target, string_agg(l_orderkey || ':' || o_orderstatus, ',' ORDER BY l_orderkey, o_orderstatus) AS evidence
FROM (SELECT * FROM lineitem WHERE l_quantity > 45) JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4""")
def q_conflict_ledger(spark, d):
    """Suppliers as transitions that large line items speak against."""
    lines = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").where("l_quantity > 45")
    conflicts = lines.select(F.col("l_suppkey").alias("transition"), F.col("l_returnflag").alias("reason"), F.col("l_orderkey").alias("action"))
    moves = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 25).cast("int").alias("target"))
    found = contracts.conflict_ledger(conflicts, moves, read(spark, d, "orders", "o_orderkey", "o_orderstatus").toDF("action", "status"))
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["action"], e["status"])), ","))


# --- sessions, texts and pairs ---------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey AS session, s_name AS label, true AS running FROM supplier UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def q_sessions_listed(spark, d):
    """Suppliers as running sessions, then customers as stored ones that do not run."""
    return sessions.listed(read(spark, d, "supplier", "s_suppkey", "s_name").toDF("session", "label"), read(spark, d, "customer", "c_custkey", "c_name").toDF("session", "label"))


@query("""
WITH w AS (SELECT o_custkey AS key, o_orderkey % 3 AS revision, o_orderkey AS payload, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS r FROM orders),
ok AS (SELECT key, payload FROM w JOIN customer ON key = c_custkey WHERE revision = 1 AND r = 1)
SELECT 'row' AS kind, c_custkey AS key, CAST(CASE WHEN payload IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision, coalesce(payload, 0) AS payload FROM customer LEFT JOIN ok ON key = c_custkey
UNION ALL SELECT 'refused', key, revision, payload FROM w WHERE NOT (revision = 1 AND r = 1 AND key IN (SELECT c_custkey FROM customer))""")
def q_apply_if_current(spark, d):
    """Customers after writes by orders, each naming the revision it changes."""
    table = read(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("key"), F.lit(1).cast("long").alias("revision"), F.lit(0).cast("long").alias("payload"))
    writes = read(spark, d, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 3).alias("revision"), F.col("o_orderkey").alias("payload"))
    now, refused = sessions.apply_if_current(table, writes, "key")
    return now.select(F.lit("row").alias("kind"), "key", "revision", "payload").union(refused.select(F.lit("refused"), "key", "revision", "payload"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')")
def q_search(spark, d):
    """Parts found by a text in their name, brand or type."""
    p = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.where(T.contains_any_case("BRAND#1", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey")


@query("SELECT o_orderkey, max(l_linenumber) AS last_line, greatest(0, epoch_ms(max(l_shipdate::TIMESTAMP)) - epoch_ms(o_orderdate::TIMESTAMP)) AS ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate")
def q_last_and_duration(spark, d):
    """The last line of each order, and how long after the order its last item was shipped."""
    from lattika.operators.selection import last_of

    lines = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"), F.max("l_shipdate").cast("timestamp").alias("shipped"))
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", last_of(F.col("lines")).alias("last_line"), T.duration_ms(F.col("o_orderdate").cast("timestamp"), F.col("shipped")).alias("ms"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS frame, 'k' || l_linenumber AS key, l_linenumber AS n FROM lineitem),
a AS (SELECT * FROM b WHERE n <= 4), c AS (SELECT * FROM b WHERE n >= 2)
SELECT coalesce(a.frame, c.frame) AS frame, a.key AS left_key, c.key AS right_key, CASE WHEN c.key IS NULL THEN 'left-only' WHEN a.key IS NULL THEN 'right-only' WHEN a.n = 2 THEN 'changed' ELSE 'same' END AS status
FROM a FULL JOIN c ON a.frame = c.frame AND a.key = c.key""")
def q_comparison(spark, d):
    """Two answers about each order, matched by line; boxes lie apart, so only keys match."""
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(F.col("l_orderkey").alias("frame"), _name("k", n).alias("key"), n.alias("pos"), (n * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.col("l_quantity").alias("amount"))
    rows = rows.groupBy("frame", "key", "pos", "x", "y", "width", "height").agg(F.max("amount").alias("amount"))
    other = rows.where("pos >= 2").withColumn("amount", F.when(F.col("pos") == 2, F.col("amount") + 1).otherwise(F.col("amount")))
    return comparison(rows.where("pos <= 4"), other, "frame", ["amount"], keep).select("frame", "left_key", "right_key", "status")


@query("""
WITH e AS (SELECT c_custkey AS frame, unnest(range(3)) AS pos FROM customer)
SELECT frame, CAST(pos AS INTEGER) AS pos, 'k' || pos AS key, 'Name ' || frame AS page FROM e WHERE pos = 0 OR (pos = 1 AND frame % 4 > 0) OR (pos = 2 AND frame % 4 = 3)""")
def q_recovered_elements(spark, d):
    """Streams about customers that break off in their first to third element: the whole elements that a repair gives back, and the page."""
    k = F.col("c_custkey")
    whole = lambda n: F.concat(F.lit("{'candidateKey': 'k" + str(n) + "', visualDescription: \"a 'b' {c\", \"elementType\": \"text\" interactive: True, // yes\n approximateRegion: {x: .5, y: 0.25}, geometryKind: 'box', geometryConfidence: 1, meaning: {dynamicContent: false, confidence: 0.5,},}, "))
    cut = F.lit("{\"candidateKey\": \"cut\", \"visualDescription\": \"never en")
    elements = F.concat(whole(0), F.when(k % 4 > 0, whole(1)).otherwise(F.lit("")), F.when(k % 4 == 3, whole(2)).otherwise(F.lit("")), F.when(k % 2 > 0, cut).otherwise(F.lit("")))
    stream = F.concat(F.lit("<observation>{not this}</observation><data-json>{frameId: 'f', page: {name: 'Name "), k.cast("string"), F.lit("'}, elements: ["), elements)
    read_back = spread(read(spark, d, "customer", "c_custkey"), "c_custkey").select(k.alias("frame"), F.try_parse_json(parse_checkpoint(stream)).alias("v"))
    found = read_back.select("frame", F.try_variant_get("v", "$.page.name", "string").alias("page"), F.posexplode(F.try_variant_get("v", "$.elements", "array<variant>")).alias("pos", "e"))
    return found.where(recognition.complete(F.to_json("e"))).select("frame", "pos", F.try_variant_get("e", "$.candidateKey", "string").alias("key"), "page")
