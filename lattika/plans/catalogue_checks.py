"""Queries that run routes, compositions, evidence, sessions, texts and boxes on rows made from the driver's tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattika.functions import geometry as G
from lattika.functions import nested
from lattika.functions import text as T
from lattika.functions.identity import id_time, record_hash, time_id
from lattika.operators import constraints as K
from lattika.operators import evidence, graph, merging, selection
from lattika.operators.rounds import keep
from lattika.plans import canonical_graph, drafts, route, versions, views
from lattika.plans.catalogue import query, read
from lattika.sources import readers
from lattika.streaming import sessions


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# --- routes ----------------------------------------------------------------------------------------------------------

_SITE = """
WITH t AS (SELECT o_orderkey AS k, 'p' || o_custkey % 27 AS a, 'p' || o_orderkey % 25 AS b, 'e' || o_custkey % 200 AS e, ['safe', 'low', 'high', 'odd'][o_orderkey % 4 + 1] AS risk, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS closed FROM orders),
c AS (SELECT p_partkey AS k, p_size % 3 <> 0 AND p_size % 5 <> 0 AS routable, CASE WHEN p_size % 2 = 0 THEN 'exact_page' ELSE 'shared_availability' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'p' || p_size ELSE 'e' || p_partkey END AS ref, 'p' || p_partkey % 26 AS b FROM part),
r AS (SELECT s_suppkey AS k, 'e' || s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN [] ELSE ['p' || s_nationkey, 'p' || s_nationkey + 10] END AS pages FROM supplier)"""


def _site(spark, d):
    o, p, s = F.col("o_orderkey"), F.col("p_partkey"), F.col("s_suppkey")
    risks = F.array(*map(F.lit, ("safe", "low", "high", "odd")))
    orders = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    proof = F.struct(F.lit("t").alias("actionTraceRef"), F.lit("f").alias("beforeFrameRef"), F.when(o % 5 == 0, "").otherwise("g").alias("afterFrameRef"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("postcondition"))
    moves = orders.select(o.alias("key"), _name("p", F.col("o_custkey") % 27).alias("sourceRef"), _name("p", o % 25).alias("targetRef"), _name("e", F.col("o_custkey") % 200).alias("triggerElementRef"), F.get(risks, (o % 4).cast("int")).alias("risk"), proof.alias("evidence"))
    size = F.col("p_size")
    exact = size % 2 == 0
    chosen = F.struct(F.when(exact, "exact_page").otherwise("shared_availability").alias("kind"), F.when(exact, _name("p", size)).otherwise(_name("e", p)).alias("ref"))
    agreed = read(spark, d, "part", "p_partkey", "p_size").select(
        p.alias("key"), F.lit("authority_contract").alias("edgeKind"), F.lit("authority_certified").alias("authorityStatus"), (size % 3 != 0).alias("planningEligible"), F.when(size % 5 == 0, "contradicted").alias("runtimeEvidenceStatus"),
        chosen.alias("sourceSelector"), F.struct(F.lit("page").alias("kind"), _name("p", p % 26).alias("ref")).alias("expectedTarget"), F.lit("e1").alias("triggerElementRef"), F.lit("critical").alias("risk"),
    )
    n = F.col("s_nationkey")
    elements = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("e", s).alias("id"), F.struct(F.lit("application").alias("kind"), F.lit("app").alias("ref")).alias("owner"), F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(_name("p", n), _name("p", n + 10))).alias("availableOnPageRefs"))
    pages = read(spark, d, "nation", "n_nationkey").select(_name("p", "n_nationkey").alias("id"))
    return moves, agreed, pages, elements


@query(_SITE + """
SELECT a, b, CAST(k AS VARCHAR) AS key, 1 + CASE risk WHEN 'safe' THEN 0 WHEN 'low' THEN 1 WHEN 'high' THEN 16 ELSE 8 END AS cost, '0' AS kind FROM t WHERE closed
UNION ALL SELECT ref, b, CAST(k AS VARCHAR), 65, '1' FROM c WHERE routable AND kind = 'exact_page' UNION ALL SELECT unnest(pages), b, CAST(c.k AS VARCHAR), 65, '1' FROM c JOIN r ON ref = r.id WHERE routable AND kind <> 'exact_page'""")
def q_route_edges(spark, d):
    """Usable edges with what their risk costs: closed orders, and parts as contracts from one page or from all pages of a supplier."""
    moves, agreed, _, elements = _site(spark, d)
    return route.edges(moves, agreed, elements, "low-risk").select("a", "b", F.col("key").cast("string").alias("key"), F.col("cost").cast("int").alias("cost"), "kind")


@query(_SITE + """, u AS (SELECT * FROM t WHERE closed), g AS (SELECT * FROM c WHERE routable), n AS (SELECT 'p' || n_nationkey AS id FROM nation)
SELECT 'source_unresolved' AS rule, CAST(k AS VARCHAR) AS subject, a AS detail FROM u WHERE a NOT IN (FROM n) UNION ALL SELECT 'target_unresolved', CAST(k AS VARCHAR), b FROM u WHERE b NOT IN (FROM n)
UNION ALL SELECT 'trigger_unresolved', CAST(k AS VARCHAR), e FROM u WHERE e NOT IN (SELECT id FROM r) UNION ALL SELECT 'selector_unresolved', CAST(k AS VARCHAR), ref FROM g WHERE kind = 'exact_page' AND ref NOT IN (FROM n)
UNION ALL SELECT 'shared_root_unresolved', CAST(k AS VARCHAR), ref FROM g WHERE kind <> 'exact_page' AND ref NOT IN (SELECT id FROM r) UNION ALL SELECT 'shared_root_without_pages', CAST(g.k AS VARCHAR), ref FROM g JOIN r ON ref = id WHERE kind <> 'exact_page' AND len(pages) = 0
UNION ALL SELECT * FROM (SELECT 'shared_page_unresolved', CAST(g.k AS VARCHAR), unnest(pages) AS p FROM g JOIN r ON ref = id WHERE kind <> 'exact_page') WHERE p NOT IN (FROM n)
UNION ALL SELECT 'expected_target_unresolved', CAST(k AS VARCHAR), b FROM g WHERE b NOT IN (FROM n) UNION ALL SELECT 'contract_trigger_unresolved', CAST(k AS VARCHAR), 'e1' FROM g WHERE 'e1' NOT IN (SELECT id FROM r)""")
def q_edge_errors(spark, d):
    """Ends of such edges that do not resolve."""
    return route.edge_errors(*_site(spark, d))


@query(_SITE + """
SELECT (SELECT count(*) FROM t) AS transitions, (SELECT count(*) FROM t WHERE closed) AS closed_transitions, (SELECT count(*) FROM c) AS contracts, (SELECT count(*) FROM c WHERE routable) AS routable_contracts,
  (SELECT count(*) FROM t WHERE NOT closed) + (SELECT count(*) FROM c WHERE NOT routable) AS excluded""")
def q_route_statistics(spark, d):
    """How many transitions and contracts there are, and how many are usable."""
    moves, agreed, _, _ = _site(spark, d)
    return route.statistics(moves, agreed)


# --- evidence --------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT s_suppkey AS frame FROM supplier WHERE s_acctbal > 0)
SELECT o_orderkey AS trace FROM orders WHERE o_custkey % 120 IN (FROM f) AND o_orderkey % 110 IN (FROM f)""")
def q_qualified_traces(spark, d):
    """Orders both of whose frames are suppliers in credit."""
    frames = read(spark, d, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0").select(F.col("s_suppkey").alias("frame"))
    traces = read(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("trace"), (F.col("o_custkey") % 120).alias("before"), (F.col("o_orderkey") % 110).alias("after"))
    return selection.qualified_traces(traces, frames, "before", "after", "frame").select("trace")


@query("""
WITH c AS (SELECT 'src' || l_suppkey % 30 AS key, l_orderkey * 10 + l_linenumber AS frame, l_shipdate AS at_, CASE WHEN l_quantity > 10 THEN l_quantity WHEN l_quantity > 5 THEN -1.0 END AS rect FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity)),
o AS (SELECT 'src' || o_custkey % 30 AS key, -o_orderkey AS frame, o_orderdate AS at_, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS rect FROM orders),
h AS (SELECT target, frame, at_, 'control' AS origin FROM c, (VALUES ('low', '^src[0-4]$'), ('teens', '^src1\\d$')) t(target, p) WHERE regexp_matches(key, p) AND rect IS NOT NULL
  UNION ALL SELECT target, frame, at_, 'trace' FROM o, (VALUES ('low', '^src[0-4]$'), ('teens', '^src1\\d$')) t(target, p) WHERE regexp_matches(key, p) AND rect IS NOT NULL)
SELECT target, frame, origin, row_number() OVER (PARTITION BY target ORDER BY at_ DESC, origin, frame) = 1 AS latest FROM h""")
def q_control_candidates(spark, d):
    """Line items and orders as controls and traces that may show a target."""
    targets = spark.createDataFrame([("low", ["src[0-4]"]), ("teens", [r"src1\d"])], "target string, patterns array<string>")
    lines = selection.top_one(read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate"), ["l_orderkey", "l_linenumber"], *[F.col(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    q = F.col("l_quantity")
    controls = lines.select(_name("src", F.col("l_suppkey") % 30).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), F.col("l_shipdate").alias("captured_at"), F.when(q > 10, q).alias("locator"), F.when(q > 5, F.lit(-1.0)).alias("geometry"))
    done = F.struct(F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("status"), F.col("o_totalprice").alias("rect"))
    traces = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").select(_name("src", F.col("o_custkey") % 30).alias("key"), (-F.col("o_orderkey")).alias("frame"), F.col("o_orderdate").alias("captured_at"), F.array(done).alias("attempts"))
    return evidence.control_candidates(targets, controls, traces).select("target", "frame", "origin", "latest")


@query("""
WITH t AS (SELECT s_suppkey AS k, 's' || s_nationkey % 5 AS a, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'z' || s_nationkey % 2 END AS b, 'k' || s_suppkey % 60 AS key, 'o' || s_suppkey % 9 AS op, CASE WHEN s_suppkey % 4 > 0 THEN 'c' || s_suppkey % 4 END AS cap FROM supplier),
x AS (SELECT o_orderkey AS trace, 's' || o_custkey % 5 AS a, 'z' || o_custkey % 2 AS b, 'k' || o_orderkey % 200 AS key, 'o' || o_orderkey % 90 AS op, CASE WHEN o_orderkey % 50 > 0 THEN 'd' END AS cap, o_orderdate AS at_ FROM orders),
m AS (SELECT t.k, x.trace, row_number() OVER (PARTITION BY t.k ORDER BY at_ DESC, trace) AS r FROM t JOIN x ON t.a = x.a AND (t.b IS NULL OR t.b = x.b) AND (t.key = x.key OR t.op = x.op OR t.cap IS NOT DISTINCT FROM x.cap))
SELECT t.k AS transition, trace FROM t LEFT JOIN m ON t.k = m.k AND r = 1""")
def q_matching_traces(spark, d):
    """The latest order that fits each supplier as a transition, by states and then by key, operation or capability."""
    s, n, o, c = F.col("s_suppkey"), F.col("s_nationkey"), F.col("o_orderkey"), F.col("o_custkey")
    moves = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(s.alias("transition"), F.array(_name("s", n % 5)).alias("from_states"), F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(_name("z", n % 2))).alias("to_states"), _name("k", s % 60).alias("key"), F.array(_name("o", s % 9)).alias("operations"), F.when(s % 4 > 0, _name("c", s % 4)).alias("capability"))
    traces = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(o.alias("trace"), _name("s", c % 5).alias("from_state"), _name("z", c % 2).alias("to_state"), _name("k", o % 200).alias("key"), _name("o", o % 90).alias("operation"), F.when(o % 50 > 0, "d").alias("capability"), F.col("o_orderdate").alias("ended_at"))
    return evidence.matching_traces(moves, traces)


# --- drafts, versions and views --------------------------------------------------------------------------------------


@query("""
SELECT n_nationkey AS page, CASE WHEN n_regionkey = 0 THEN 'published' WHEN count(c_custkey) = 0 THEN 'pending-recognition' WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'pending-review' ELSE 'ready' END AS status
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 5 > 0 GROUP BY n_nationkey, n_regionkey""")
def q_page_status(spark, d):
    """How far nations are as pages, customers being their elements."""
    pages = read(spark, d, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("page"), F.when(F.col("n_regionkey") == 0, "now").alias("publishedAt"))
    elements = read(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_nationkey % 5 > 0").select(F.col("c_nationkey").alias("pageId"), F.when(F.col("c_acctbal") < -900, "pending").otherwise("accepted").alias("reviewStatus"))
    return drafts.page_status(pages, elements)


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS level, event_type AS code, count(*) AS n, count(DISTINCT user_id) AS elements FROM events GROUP BY 1, 2")
def q_grouped_issues(spark, d):
    """Events as issues of users, grouped."""
    issues = read(spark, d, "events", "event_type", "user_id").select(F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("level"), F.col("event_type").alias("code"), F.col("user_id").alias("element"))
    return drafts.grouped_issues(issues).withColumn("elements", F.size("elements").cast("long"))


@query("""
SELECT o_orderkey AS stage, o_orderkey % 7 = c_custkey % 7 AS is_current, o_orderstatus = 'O' AND o_orderkey % 3 <> c_custkey % 3 AS is_stale, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = c_custkey % 3 AS ok FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_stage_status(spark, d):
    """Orders as stages of customers' graphs: current, stale, and fit to be published."""
    k = F.col("o_orderkey")
    stages = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(k.alias("stageId"), F.col("o_custkey").alias("appKey"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("published").alias("status"), (k % 3).cast("string").alias("baseRootHash"), (k % 7).alias("graphRevision"), (k % 2 == 0).alias("valid"))
    c = F.col("c_custkey")
    active = read(spark, d, "customer", "c_custkey").select(c.alias("appKey"), (c % 7).alias("graphRevision"), (c % 3).cast("string").alias("rootHash"))
    ok = versions.publishable(stages, active).select("stageId", "ok")
    return versions.stage_status(stages, active).join(ok, "stageId").select(F.col("stageId").alias("stage"), "is_current", "is_stale", "ok")


@query("""
WITH w AS (SELECT l_orderkey % 20 AS path, l_partkey % 5 AS hash, l_orderkey AS stage, l_shipdate AS at_, row_number() OVER () AS n FROM (SELECT DISTINCT l_orderkey, l_partkey % 5 AS l_partkey, l_shipdate FROM lineitem WHERE l_quantity > 48)),
a AS (SELECT unnest(range(25)) AS path, 2 AS hash), v AS (SELECT w.* FROM w JOIN a USING (path) WHERE w.hash <> a.hash)
SELECT path, coalesce(arg_max(v.hash, {'at_': at_, 'p': stage * 10 + v.hash}), max(a.hash)) AS hash FROM a LEFT JOIN v USING (path) GROUP BY path""")
def q_merge_stages(spark, d):
    """Files after large line items as stages were merged in order."""
    lines = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_quantity").where("l_quantity > 48")
    files = lines.select(F.col("l_orderkey").cast("string").alias("stageId"), (F.col("l_orderkey") % 20).alias("path"), (F.col("l_partkey") % 5).alias("hash"), F.col("l_shipdate").alias("createdAt"), (F.col("l_orderkey") * 10 + F.col("l_partkey") % 5).alias("pos")).distinct()
    active = spark.range(25).select(F.col("id").alias("path"), F.lit(2).cast("long").alias("hash"))
    return versions.merge_stages(files, active)[0].select("path", "hash")


@query("""
WITH e AS (SELECT p_partkey AS k, 'c' || p_partkey AS c, p_size % 13 AS f FROM part)
SELECT 'role_missing' AS rule, c AS subject, 'currentValue' AS detail FROM e WHERE f = 1 UNION ALL SELECT 'children_without_role', c, 'v' || k FROM e WHERE f IN (1, 12) UNION ALL SELECT 'role_unexpected', c, 'extra' FROM e WHERE f = 2
UNION ALL SELECT 'role_outside', c, 'gone' FROM e WHERE f = 3 UNION ALL SELECT 'children_without_role', c, 'l' || k FROM e WHERE f IN (3, 6, 12) UNION ALL SELECT 'passive_role_capable', c, 'label' FROM e WHERE f IN (4, 6)
UNION ALL SELECT 'passive_role_actionable', c, 'label' FROM e WHERE f IN (4, 6) UNION ALL SELECT 'acting_role_incapable', c, 'settingTrigger' FROM e WHERE f = 5 UNION ALL SELECT 'acting_role_not_actionable', c, 'settingTrigger' FROM e WHERE f = 5
UNION ALL SELECT 'roles_incompatible', c, 'label,settingTrigger' FROM e WHERE f = 6 UNION ALL SELECT 'lone_role_capable', c, 'affordance' FROM e WHERE f = 9 UNION ALL SELECT 'lone_role_actionable', c, 'affordance' FROM e WHERE f = 9
UNION ALL SELECT 'profile_unknown', c, 'odd' FROM e WHERE f = 10 UNION ALL SELECT 'container_capable', c, '' FROM e WHERE f = 11 UNION ALL SELECT 'container_actionable', c, '' FROM e WHERE f = 11
UNION ALL SELECT 'children_without_role', c, 'b' || k FROM e WHERE f = 12 UNION ALL SELECT 'role_shared', c, '' FROM e WHERE f = 12""")
def q_composition_errors(spark, d):
    """Parts as setting rows, each with the fault of its size; that a row is its own trigger (7), and that an affordance is the trigger (8), are none."""
    p = read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 13).alias("f"))
    f, named = F.col("f"), lambda prefix: _name(prefix, F.col("k"))
    pair = lambda role, ref: F.struct(F.lit(role).alias("key"), ref.alias("value"))
    label = F.when(f == 3, F.lit("gone")).when(f == 6, named("b")).otherwise(named("l"))
    roles = F.when(f == 12, F.array(pair("x", named("x")), pair("y", named("x")))).otherwise(F.array_compact(F.array(
        pair("label", label), F.when(f != 1, pair("currentValue", named("v"))), pair("settingTrigger", F.when(f == 7, named("c")).otherwise(named("b"))),
        F.when(f == 2, pair("extra", named("x"))), F.when(f == 8, pair("affordance", named("b"))), F.when(f == 9, pair("affordance", named("x"))),
    )))
    kids = F.array_compact(F.array(named("l"), named("v"), F.when(f != 7, named("b")), F.when(f.isin(2, 9, 12), named("x"))))
    profile = F.when(f == 10, "odd").when(f != 12, "selector_row")
    none = F.lit(None).cast("string")
    acting = lambda yes: (F.when(yes, F.array(F.lit("tap"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), yes.alias("actionable"))
    rows = p.select(named("c").alias("id"), none.alias("owner"), kids.alias("childElementRefs"), *acting(f.isin(7, 11)), F.struct(profile.alias("profile"), F.map_from_entries(roles).alias("roles")).alias("composition"))
    for prefix, yes in (("l", f == 4), ("v", f < 0), ("b", f != 5), ("x", f == 9)):
        empty = F.lit(None).cast(rows.schema["composition"].dataType)
        rows = rows.union(p.select(named(prefix), named("c"), F.array().cast("array<string>"), *acting(yes), empty))
    rows = rows.withColumn("owner", F.struct(F.when(F.col("owner").isNull(), "page").otherwise("component").alias("kind"), F.coalesce("owner", F.lit("p")).alias("ref")))
    return canonical_graph.graph_errors(canonical_graph.completed(spark, {"elements": rows.withColumn("key", F.col("id"))}), keep, canonical_graph.COMPOSITIONS)


@query("""
WITH b AS (SELECT p_partkey AS id, p_size AS parent, CAST(p_partkey % 9 AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS y FROM part), c AS (SELECT * FROM b WHERE id % 6 = 0)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 6 = 0 THEN 'new' ELSE CAST(parent AS VARCHAR) END AS parent, x, y, 1.0::DOUBLE AS width FROM b
UNION ALL SELECT 'new', CASE WHEN count(DISTINCT parent) = 1 THEN CAST(min(parent) AS VARCHAR) END, min(x), min(y), max(x + 1) - min(x) FROM c""")
def q_group_selection(spark, d):
    """Parts as elements after every sixth was put into one container."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part", "p_partkey", "p_size").select(k.cast("string").alias("id"), F.col("p_size").cast("string").alias("parent"), (k % 9).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return views.group_selection(rows, rows.where("id % 6 = 0").select("id"), "new").drop("height")


@query("SELECT DISTINCT a AS node, b AS neighbour FROM (SELECT l_suppkey AS a, l_partkey % 60 AS b FROM lineitem UNION ALL SELECT l_partkey % 60, l_suppkey FROM lineitem)")
def q_neighbours(spark, d):
    """Both directions of links between suppliers and parts."""
    return graph.neighbours(read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 60).alias("b")))


@query("""
WITH f AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 20), g AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity < 40)
SELECT a, b, 'left' AS side FROM (FROM f EXCEPT FROM g) UNION ALL SELECT a, b, 'right' FROM (FROM g EXCEPT FROM f)""")
def q_not_reciprocal(spark, d):
    """Links that only large or only small line items state."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").withColumnsRenamed({"l_suppkey": "a", "l_partkey": "b"})
    return K.not_reciprocal(lines.where("l_quantity > 20"), lines.where("l_quantity < 40"))


@query("SELECT k, count(*) AS sources FROM (SELECT DISTINCT c_custkey AS k, 1 AS s FROM customer UNION ALL SELECT DISTINCT s_suppkey, 2 FROM supplier UNION ALL SELECT DISTINCT p_partkey, 3 FROM part WHERE p_size > 25) GROUP BY k HAVING count(*) > 1")
def q_overlap(spark, d):
    """Numbers that are in use by more than one of customers, suppliers and large parts."""
    return K.overlap([read(spark, d, "customer", "c_custkey").toDF("k"), read(spark, d, "supplier", "s_suppkey").toDF("k"), read(spark, d, "part", "p_partkey", "p_size").where("p_size > 25").select(F.col("p_partkey").alias("k"))], "k")


# --- sessions --------------------------------------------------------------------------------------------------------


@query("SELECT s.conv_id AS session, c.turn AS id FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 END AS last FROM conversations WHERE conv_id % 2 = 0) s JOIN conversations c USING (conv_id) WHERE c.turn > coalesce(last, -1)")
def q_replay(spark, d):
    """Turns that readers of every second conversation have not seen."""
    turns = read(spark, d, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"))
    seen = turns.where("session % 2 = 0").select("session", F.when(F.col("session") % 3 > 0, F.col("session") % 3).alias("last_id")).distinct()
    return sessions.replay(turns, seen).select("session", "id")


@query("""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN '<think>' WHEN 3 THEN '</think>' ELSE coalesce(text, '') END AS x FROM conversations), w AS (SELECT conv_id, string_agg(x, '' ORDER BY turn) AS c FROM t GROUP BY 1)
SELECT conv_id AS session, regexp_replace(c, '(?s)<think>.*?(?:</think>|$)', '', 'g') AS visible, array_to_string(regexp_extract_all(c, '(?s)<think>(.*?)(?:</think>|$)', 1), '') AS inner FROM w""")
def q_visible_and_inner(spark, d):
    """Conversations with every fourth turn between thought markers, split into both."""
    turns = read(spark, d, "conversations", "conv_id", "turn", "text")
    mark = F.when(F.col("turn") % 4 == 1, sessions.OPEN).when(F.col("turn") % 4 == 3, sessions.CLOSE).otherwise(F.coalesce("text", F.lit("")))
    return sessions.visible_and_inner(turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), mark.alias("text")))


@query("""
WITH e AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'purchase' AS got, event_type = 'signup' AND event_id % 3 = 0 AS done FROM events),
b AS (SELECT *, sum(got::INT) OVER (PARTITION BY s ORDER BY n) AS block FROM e), r AS (SELECT *, sum((NOT done)::INT) OVER (PARTITION BY s, block ORDER BY n) AS retry FROM b),
o AS (SELECT *, CASE WHEN done THEN 'completed' WHEN retry > 5 THEN 'failed' END AS state FROM r), x AS (SELECT *, count(state) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM o)
SELECT s AS session, CAST(n AS INT) AS n, CAST(retry AS BIGINT) AS retry, coalesce(state, 'running') AS state FROM x WHERE earlier = 0""")
def q_resumption(spark, d):
    """Users' events as attempts of sessions that give up after five failures in a row."""
    from pyspark.sql import Window

    e = read(spark, d, "events", "user_id", "ts", "event_id", "event_type")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return sessions.resumption(e.select(F.col("user_id").alias("session"), n.alias("n"), (F.col("event_type") == "purchase").alias("got_content"), ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("done")))


@query("""
WITH a AS (SELECT c_nationkey AS x, c_mktsegment AS y, c_custkey AS pos, 0 AS part FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_nationkey, c_mktsegment, c_custkey, 1 FROM customer WHERE c_custkey % 2 = 1)
SELECT x, y, pos FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY part, pos) AS r FROM (FROM a UNION ALL FROM b)) WHERE r = 1""")
def q_continuation(spark, d):
    """Customers of even numbers continued by those of odd ones, each nation and segment once."""
    c = read(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_custkey").toDF("x", "y", "pos")
    return sessions.continuation(c.where("pos % 2 = 0"), c.where("pos % 2 = 1"), ["x", "y"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'completed' END AS status FROM orders")
def q_recovered(spark, d):
    """Orders as tasks after a restart."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "uploading").otherwise("completed")
    return sessions.recovered(read(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", status.alias("status")))


# --- texts, values and boxes -----------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, 'page.' || lower(trim(regexp_replace(p_name || '--' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS page, p_size || 'x' AS segment, 'g@1.' || p_size || '.' || p_size + 1 AS version,
  CASE WHEN p_size % 2 = 0 THEN 'tap,none' ELSE 'none' END AS caps, CASE WHEN p_size % 2 = 0 THEN 'tap' ELSE 'none' END AS kept, p_size % 3 <> 0 AS differs, last AS last FROM (SELECT *, string_split(p_brand, '#')[-1] AS last FROM part)""")
def q_texts(spark, d):
    """Page keys, path segments, versions and capabilities made of parts."""
    p, size = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size"), F.col("p_size")
    given = F.when(size % 2 == 0, F.array(F.lit(" tap "), F.lit("none"), F.lit("tap"))).otherwise(F.array(F.lit("fly")))
    clean = F.transform(given, lambda v: F.trim(v))
    return p.select(
        "p_partkey", T.page_key(F.concat("p_name", F.lit("--"), "p_brand")).alias("page"), T.safe_segment(F.concat(F.lit(" /"), size.cast("string"), F.lit("x/"))).alias("segment"), T.next_version(F.concat(F.lit("g@1."), size.cast("string"), F.lit("."), size.cast("string"))).alias("version"),
        F.when(size % 2 == 0, F.array_join(T.distinct_present(clean), ",")).otherwise("none").alias("caps"), F.array_join(T.capabilities(given, ["tap"]), ",").alias("kept"), T.stable_differs(F.when(size % 3 == 0, F.lit(None)).otherwise("x"), F.lit("")).alias("differs"), T.last_part(F.col("p_brand"), "#").alias("last"),
    )


@query("""
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0, false) AS even FROM events""")
def q_json_conditions(spark, d):
    """Events whose property `k`, made a word, meets a condition."""
    e = read(spark, d, "events", "event_id", "props")
    k = nested.at_path(F.col("props"), "k", "bigint")
    word = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, "even").when(k.isNull(), "unknown").otherwise("odd").alias("kind")).alias("layout")))
    return e.select("event_id", nested.satisfies(word, [("layout.kind", "eq", "even"), ("layout.kind", "ne", "odd")]).alias("even"))


@query("""
SELECT o_orderkey AS k, '$.a[0].b' AS path, 'token' AS marker FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, '$.secret', 'secret' FROM orders WHERE o_orderkey % 5 = 0""")
def q_forbidden(spark, d):
    """Marked values and keys inside JSON made of orders."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"a":[{"b":"'), F.when(k % 3 == 0, "a token").otherwise("plain"), F.lit('"}],"'), F.when(k % 5 == 0, "secret").otherwise("open"), F.lit('":1}'))
    return nested.forbidden(read(spark, d, "orders", "o_orderkey").select(k.alias("k"), text.alias("t")), "k", "t", ["token", "secret"])


@query("""
WITH l AS (SELECT doc_id, 'n/' || doc_id || '.md' AS path, unnest(['d' || (doc_id + 1), 'n/' || (doc_id % 7), 'gone', CAST(doc_id % 5 AS VARCHAR)]) AS target FROM documents), k AS (SELECT CAST(doc_id AS VARCHAR) AS name FROM documents)
SELECT doc_id, target, CASE WHEN target IN (FROM k) THEN 'n/' || target || '.md' WHEN target LIKE 'n/%' AND substr(target, 3) IN (FROM k) THEN target || '.md' END AS found FROM l""")
def q_wiki_links(spark, d):
    """Links in notes about documents, resolved below the root, as paths or by file names."""
    k = F.col("doc_id").cast("long")
    notes = read(spark, d, "documents", "doc_id").select(k.alias("doc_id"), _name("n/", F.concat(k.cast("string"), F.lit(".md"))).alias("path"), F.concat(F.lit("x [["), _name("d", k + 1), F.lit("|label]] ![[image]] [[n/"), (k % 7).cast("string"), F.lit("#part]] [[ gone ]] [["), (k % 5).cast("string"), F.lit(".md]]")).alias("text"))
    links = readers.wiki_links(notes, "doc_id", "text")
    return readers.resolve_links(links, notes.select("path"), "n").select("doc_id", "target", F.col("path").alias("found"))


@query("""
WITH b AS (SELECT p_partkey, p_size - 10 AS l, p_partkey % 40 AS t, p_size + p_partkey % 30 - 20 AS r, p_partkey % 40 + p_size % 3 AS b FROM part)
SELECT p_partkey, CASE WHEN r > l AND b > t AND least(50, r) > greatest(0, l) AND least(30, b) > greatest(0, t) THEN round(greatest(0, l) / 50.0, 9) END AS x, CASE WHEN r > l AND b > t AND least(50, r) > greatest(0, l) AND least(30, b) > greatest(0, t) THEN round((least(50, r) - greatest(0, l)) / 50.0, 9) END AS width,
  round(greatest(0.0, least(0.999, l / 20.0)), 6) AS clamped FROM b""")
def q_bounds(spark, d):
    """Bounds as texts, cut to a viewport, and clamped to the unit square."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.format_string("[%d,%d][%d,%d]", size - 10, k % 40, size + k % 30 - 20, k % 40 + size % 3)
    rows = read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", size, G.normalized_bounds(G.parse_bounds(text), F.lit(50), F.lit(30)).alias("n"))
    half = F.lit(0.5)
    return rows.select("p_partkey", F.round("n.x", 9).alias("x"), F.round("n.width", 9).alias("width"), G.clamp_unit_box((size - 10) / 20.0, half, half, half)["x"].alias("clamped"))


@query("SELECT o_orderkey, least(o_totalprice, o_custkey) AS confidence FROM orders")
def q_confidence(spark, d):
    """The lesser of two numbers of each order."""
    o = read(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    return o.withColumns({"a": F.col("o_totalprice"), "b": F.col("o_custkey").cast("double"), "c": F.lit(None).cast("double")}).select("o_orderkey", evidence.confidence("a", "b", "c").alias("confidence"))


@query("""
WITH b AS (SELECT s_suppkey AS page, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT page, n > 0 AS changed FROM b""")
def q_page_signatures(spark, d):
    """Suppliers as pages whose signature changes when their large line items, as elements, are marked."""
    pages = read(spark, d, "supplier", "s_suppkey").toDF("page")
    lines = read(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", "l_quantity")
    moves = read(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("target"))
    before = merging.page_signatures(pages, lines, moves)
    after = merging.page_signatures(pages, lines.withColumn("l_quantity", F.when(F.col("l_quantity") > 40, -1).otherwise(F.col("l_quantity"))), moves).withColumnRenamed("signature", "new")
    return before.join(after, "page").select("page", (F.col("signature") != F.col("new")).alias("changed"))


@query("""
WITH e AS (SELECT event_id, epoch_us(ts::TIMESTAMP) // 1000 AS ms FROM events)
SELECT event_id, array_to_string(list_transform(range(9, -1, -1), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + CAST((ms >> (5 * i)) & 31 AS INT), 1)), '') AS digits, ms, 26 AS length FROM e""")
def q_time_ids(spark, d):
    """Sortable identifiers of events, and their times read back."""
    e = read(spark, d, "events", "event_id", "ts")
    made = time_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id").cast("string"))
    return e.select("event_id", made.alias("id")).select("event_id", F.substring("id", 1, 10).alias("digits"), id_time(F.col("id")).alias("ms"), F.length("id").alias("length"))


@query("""
WITH o AS (SELECT *, regexp_replace(CAST(o_custkey / 10000000000 AS VARCHAR), 'e-0', 'e-') AS small, CAST(o_totalprice AS DECIMAL(18, 2)) / 1 AS price FROM orders)
SELECT o_orderkey, 'sha256:' || sha256('{"a":' || o_custkey || ',"b":[1,{"c":"' || o_orderstatus || '"}],"d":' || CASE WHEN o_custkey = 0 THEN '0' ELSE small END || ',"e":' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') || '}') AS hash FROM o""")
def q_record_hash(spark, d):
    """Hashes of records made of orders; the order of keys, whole fractions, ways to write a number and a hash inside do not count."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    price, key = F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit('{"contentHash":"x", "e": '), price, F.lit(', "d": '), key, F.lit('E-10, "b": [1.0, {"c":"'), "o_orderstatus", F.lit('"}], "a":'), key, F.lit("}"))
    return o.select("o_orderkey", record_hash(text).alias("hash"))


@query("""
WITH s AS (SELECT o_orderkey AS stage, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'published' ELSE 'archived' END AS status FROM orders), f AS (SELECT min(stage) FILTER (status = 'published') AS p, min(stage) FILTER (status = 'draft') AS d FROM s)
SELECT CAST(stage AS VARCHAR) AS stage, CASE WHEN stage = p THEN 'archived' ELSE status END AS status, CASE WHEN stage = p THEN 'now' END AS at_ FROM s, f WHERE stage <> d UNION ALL SELECT 'refused', 'draft', NULL FROM f UNION ALL SELECT 'refused', 'published', NULL FROM f""")
def q_stage_ends(spark, d):
    """Orders as stages after the first published one was archived and the first draft deleted; the other way round both are refused."""
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "published").otherwise("archived")
    stages = read(spark, d, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").cast("string").alias("stageId"), status.alias("status"), F.lit(None).cast("string").alias("archivedAt"))
    first = {r["status"]: str(r["n"]) for r in stages.groupBy("status").agg(F.min(F.col("stageId").cast("long")).alias("n")).collect()}  # three rows
    kept, _ = versions.deleted(versions.archived(stages, first["published"], "now")[0], first["draft"])
    refused = versions.archived(stages, first["draft"], "now")[1].union(versions.deleted(stages, first["published"])[1])
    return kept.select(F.col("stageId").alias("stage"), "status", F.col("archivedAt").alias("at_")).union(refused.select(F.lit("refused"), "status", "archivedAt"))
