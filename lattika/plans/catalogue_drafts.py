"""Queries that run merges, evidence operators, views and draft operators on the driver's tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattika.operators import constraints as K
from lattika.operators import evidence, graph, merging
from lattika.plans import views
from lattika.plans.catalogue import query, read
from lattika.operators.rounds import keep


def _name(prefix: str, column):
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# --- merges ----------------------------------------------------------------------------------------------------------

_SUPPLIERS = "SELECT s_suppkey AS c_custkey, s_nationkey AS c_nationkey, CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE s_name END AS c_mktsegment FROM supplier"


@query(f"""
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_nationkey ELSE n.c_nationkey END AS c_nationkey,
  CASE WHEN n.c_custkey IS NULL OR (n.c_mktsegment = '' AND c.c_custkey IS NOT NULL) THEN c.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment
FROM customer c FULL JOIN ({_SUPPLIERS}) n ON c.c_custkey = n.c_custkey""")
def q_upsert(spark, d):
    """Customers updated by suppliers of equal number; a blank segment keeps the old one."""
    name = F.when(F.col("s_nationkey") % 5 == 0, "").otherwise(F.col("s_name"))
    new = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), name.alias("c_mktsegment"))
    return merging.upsert(read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), new, "c_custkey", {"c_mktsegment": F.col("c_mktsegment") == ""})


@query("""
WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer), n AS (SELECT s_suppkey * 20 AS c_custkey, s_name AS c_mktsegment FROM supplier)
SELECT c_custkey, coalesce(b.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM b FULL JOIN n USING (c_custkey)""")
def q_insert_absent(spark, d):
    """Customers, with segments that are not known filled and absent numbers added from suppliers."""
    base = read(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    new = read(spark, d, "supplier", "s_suppkey", "s_name").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_mktsegment"))
    return merging.insert_absent(base, new, "c_custkey", ["c_mktsegment"])


@query("""
WITH n AS (SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier WHERE s_acctbal > 9000)
SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT nation FROM n) UNION ALL SELECT id, nation FROM n""")
def q_replace_partition(spark, d):
    """Customers, with all of a nation replaced by its rich suppliers where it has any."""
    base = read(spark, d, "customer", "c_custkey", "c_nationkey").toDF("id", "nation")
    new = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 9000").drop("s_acctbal").toDF("id", "nation")
    return merging.replace_partition(base, new, "nation")


@query("""
WITH p AS (SELECT l_partkey AS key, 's' || min(l_suppkey) AS label FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
o AS (SELECT p_partkey AS key, p_name AS label, CASE WHEN p_size % 5 = 0 THEN 'human' ELSE 'ai' END AS source, CASE WHEN p_size % 4 = 0 THEN 'accepted' ELSE 'edited' END AS review, CASE p_size % 7 WHEN 0 THEN 'application' WHEN 1 THEN 'shared_component' ELSE 'page' END AS kind,
  CASE WHEN p_size < 40 THEN 'p1' ELSE 'p2' END AS page, p_size % 6 = 0 AS edited FROM part),
j AS (SELECT *, kind <> 'page' AS shared, source = 'human' OR review = 'accepted' OR edited AS protected, kind <> 'page' OR page = 'p1' AS meets FROM o),
m AS (SELECT j.*, p.label AS new FROM j LEFT JOIN p ON j.key = p.key AND j.meets)
SELECT key, CASE WHEN new IS NOT NULL AND NOT shared AND NOT protected THEN new ELSE label END AS label, CASE WHEN new IS NOT NULL AND NOT shared AND NOT protected THEN 'ai' ELSE source END AS source, review, kind AS owner_kind, page,
  CASE WHEN new IS NOT NULL AND kind = 'application' THEN 'p3,p1' ELSE 'p3' END AS available, CASE WHEN protected THEN new END AS proposal FROM m WHERE new IS NOT NULL OR shared OR page <> 'p1'
UNION ALL SELECT p.key, p.label, 'ai', 'pending', 'page', 'p1', '', NULL FROM p WHERE p.key NOT IN (SELECT key FROM j WHERE meets)""")
def q_merge_candidates(spark, d):
    """Parts as elements of two pages and of an application, after an answer about one page made from returned line items."""
    size = F.col("p_size")
    old = read(spark, d, "part", "p_partkey", "p_name", "p_size").select(
        _name("i", "p_partkey").alias("id"), F.col("p_partkey").alias("key"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.when(size % 5 == 0, "human").otherwise("ai").alias("source"), F.when(size % 4 == 0, "accepted").otherwise("edited").alias("review"),
        F.when(size % 7 == 0, "application").when(size % 7 == 1, "shared_component").otherwise("page").alias("owner_kind"), F.when(size < 40, "p1").otherwise("p2").alias("page"), F.array(F.lit("p3")).alias("available"), (size % 6 == 0).alias("edited"),
    )
    new = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("key")).agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("label"))
    found = merging.merge_candidates(old, new, ["label"], "p1")
    return found.drop("id").withColumns({"proposal": F.col("proposal.label"), "available": F.array_join("available", ",")})


@query("""
WITH c AS (SELECT s_suppkey AS pos, 'n' || s_nationkey AS a_key, 'p' || s_suppkey * 3 AS b_key, s_suppkey % 2 = 0 AS label_b, s_suppkey % 3 = 0 AS kind_b FROM supplier),
j AS (SELECT pos, a_key, b_key, CASE WHEN label_b THEN coalesce(p_name, n_name) ELSE coalesce(n_name, p_name) END AS label, CASE WHEN kind_b THEN coalesce(p_brand, 'r' || n_regionkey) ELSE coalesce('r' || n_regionkey, p_brand) END AS kind,
  CASE WHEN n_nationkey IS NOT NULL THEN a_key ELSE b_key END AS k FROM c LEFT JOIN nation ON a_key = 'n' || n_nationkey LEFT JOIN part ON b_key = 'p' || p_partkey)
SELECT pos, CASE WHEN r = 1 THEN k ELSE k || '-' || r END AS key, a_key, b_key, label, kind FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM j)""")
def q_merge_fields(spark, d):
    """Nations and parts merged field by field, as each supplier's choices say; equal keys get numbers."""
    a = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").select(_name("n", "n_nationkey").alias("key"), F.col("n_name").alias("label"), _name("r", "n_regionkey").alias("kind"))
    b = read(spark, d, "part", "p_partkey", "p_name", "p_brand").select(_name("p", "p_partkey").alias("key"), F.col("p_name").alias("label"), F.col("p_brand").alias("kind"))
    side = lambda n: F.when(F.col("s_suppkey") % n == 0, "b").otherwise("a")
    choices = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("pos"), _name("n", "s_nationkey").alias("a_key"), F.concat(F.lit("p"), (F.col("s_suppkey") * 3).cast("string")).alias("b_key"), F.create_map(F.lit("label"), side(2), F.lit("kind"), side(3)).alias("sources"))
    return merging.merge_fields(choices, a, b, ["label", "kind"])


@query("""
WITH k AS (SELECT 'n' || n_nationkey AS id, n_name AS key FROM nation), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey % 40 ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) END AS ref FROM supplier)
SELECT ref, s_suppkey, coalesce(a.id, b.id) AS id FROM r LEFT JOIN k a ON ref = a.id LEFT JOIN k b ON ref = b.key""")
def q_resolve_either(spark, d):
    """Nations that suppliers name by id or by key."""
    n = read(spark, d, "nation", "n_nationkey", "n_name")
    known = n.select(_name("n", "n_nationkey").alias("id"), F.col("n_name").alias("key"))
    refs = read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    ref = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string"))).otherwise(F.col("n_name"))
    return merging.resolve_either(refs.select("s_suppkey", ref.alias("ref")), "ref", known)


@query("""
SELECT l_orderkey, l_linenumber, a.p_name AS source, b.p_name AS target FROM lineitem JOIN part a ON l_partkey = a.p_partkey AND a.p_size < 30 JOIN part b ON l_suppkey = b.p_partkey AND b.p_size < 30""")
def q_remap(spark, d):
    """Line items as links between part names; links with an end that has no new name go."""
    names = read(spark, d, "part", "p_partkey", "p_name", "p_size").where("p_size < 30").select(F.col("p_partkey").alias("old"), F.col("p_name").alias("new"))
    edges = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumnsRenamed({"l_partkey": "source", "l_suppkey": "target"})
    return merging.remap(edges, names, "source", "target")


@query("""
WITH gone AS (SELECT n_nationkey AS page FROM nation WHERE n_regionkey = 0),
e AS (SELECT s_suppkey AS element, s_nationkey AS page, [s_suppkey * 3 % 25, s_suppkey * 7 % 25] AS available FROM supplier),
t AS (SELECT c_custkey AS id, c_custkey % 90 + 1 AS trigger, c_nationkey AS source, c_custkey % 25 AS target FROM customer),
left_ AS (SELECT element, array_to_string(list(p ORDER BY n), ',') AS pages FROM (SELECT element, unnest(available) AS p, generate_subscripts(available, 1) AS n FROM e) WHERE p NOT IN (SELECT page FROM gone) GROUP BY element)
SELECT 'page' AS kind, CAST(n_nationkey AS BIGINT) AS id, '' AS detail FROM nation WHERE n_nationkey NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'element', element, coalesce(pages, '') FROM e LEFT JOIN left_ USING (element) WHERE page NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'transition', id, '' FROM t WHERE source NOT IN (SELECT page FROM gone) AND target NOT IN (SELECT page FROM gone) AND trigger NOT IN (SELECT element FROM e WHERE page IN (SELECT page FROM gone))""")
def q_remove_pages(spark, d):
    """What stays of nations, suppliers and customers as pages, elements and transitions when the nations of a region go."""
    n = read(spark, d, "nation", "n_nationkey", "n_regionkey")
    pages = n.select(F.col("n_nationkey").cast("long").alias("page"))
    s = F.col("s_suppkey")
    elements = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(s.alias("element"), F.col("s_nationkey").cast("long").alias("page"), F.array(s * 3 % 25, s * 7 % 25).alias("available"))
    c = F.col("c_custkey")
    moves = read(spark, d, "customer", "c_custkey", "c_nationkey").select(c.alias("id"), (c % 90 + 1).alias("trigger"), F.col("c_nationkey").cast("long").alias("source"), (c % 25).alias("target"))
    pages, elements, moves = merging.remove_pages(pages, elements, moves, n.where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("page")))
    rows = pages.select(F.lit("page").alias("kind"), F.col("page").alias("id"), F.lit("").alias("detail"))
    rows = rows.union(elements.select(F.lit("element"), "element", F.array_join("available", ",")))
    return rows.union(moves.select(F.lit("transition"), "id", F.lit("")))


# --- evidence --------------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey AS edge, o_orderkey AS frame, o_totalprice AS rect FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN o_orderkey = c * 3 THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS r FROM (SELECT c_custkey AS c, o.* FROM customer JOIN o ON c_custkey = o_custkey)) x ON c_custkey = c AND r = 1""")
def q_preview(spark, d):
    """An order of every customer: the one of thrice the customer's number if it is closed, else the latest that is."""
    edges = read(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("edge"), F.col("c_custkey").alias("element"), (F.col("c_custkey") * 3).alias("before_frame"))
    seen = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    seen = seen.select(F.col("o_custkey").alias("element"), F.col("o_orderkey").alias("frame"), F.col("o_orderdate").alias("observed_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("rect"))
    return evidence.preview(edges, seen)


@query("""
SELECT count(*) AS raw, count(*) FILTER (WHERE event_type <> 'error') AS qualified, (SELECT count(*) FROM orders) AS outputs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending,
  count(*) FILTER (WHERE event_type = 'error') AS rejected FROM events""")
def q_audit(spark, d):
    """Events in all and without errors, and orders in all and pending."""
    events = read(spark, d, "events", "event_type")
    return evidence.audit(events, events.where("event_type <> 'error'"), read(spark, d, "orders", "o_orderstatus").select((F.col("o_orderstatus") == "P").alias("pending")))


@query("""
SELECT array_to_string(list(id ORDER BY p_size % 2 <> 0, p_retailprice, id), ',') AS members, first(id ORDER BY p_size % 2 <> 0, p_retailprice, id) AS representative
FROM (SELECT p_partkey AS id, * FROM part) GROUP BY p_brand, p_type""")
def q_presentation_groups(spark, d):
    """Parts of one brand and type, those of even size first, then by price and number."""
    rows = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("is_primary"), F.col("p_retailprice").alias("observed_at"), "p_brand", "p_type")
    return evidence.presentation_groups(rows, ["p_brand", "p_type"]).select(F.array_join("members", ",").alias("members"), "representative")


@query("""
WITH m AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_quantity >= 45 GROUP BY 1), i AS (SELECT p_partkey AS id FROM part WHERE p_size > 5)
SELECT CASE WHEN i.id IS NULL THEN 'member_unknown' WHEN n IS NULL THEN 'member_missing' ELSE 'member_repeated' END AS rule, CAST(coalesce(i.id, m.id) AS VARCHAR) AS subject, CAST(n AS VARCHAR) AS detail
FROM i FULL JOIN m ON i.id = m.id WHERE i.id IS NULL OR n IS NULL OR n > 1""")
def q_partition_errors(spark, d):
    """Parts that large line items, grouped by order, hold not just once."""
    lines = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").where("l_quantity >= 45")
    groups = lines.groupBy(F.col("l_orderkey").alias("group")).agg(F.collect_list("l_partkey").alias("members"))
    return evidence.partition_errors(groups, read(spark, d, "part", "p_partkey", "p_size").where("p_size > 5").select(F.col("p_partkey").alias("id")))


@query("""
SELECT l_suppkey, greatest(max(least(1.0, l_discount * 5 + l_tax * 8)), 0) AS covered, count(*) AS n, array_to_string(list_sort(list(l_partkey)), ',') AS completed FROM lineitem GROUP BY 1""")
def q_checkpoint_summary(spark, d):
    """How far down the boxes of each supplier's items reach, and which parts they are."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_discount", "l_tax").select("l_suppkey", F.col("l_partkey").alias("key"), (F.col("l_discount") * 5).alias("y"), (F.col("l_tax") * 8).alias("height"))
    return evidence.checkpoint_summary(lines, ["l_suppkey"]).withColumn("completed", F.array_join("completed", ","))


@query("""
WITH f AS (SELECT s_suppkey AS frame, s_nationkey AS shot FROM supplier WHERE s_acctbal > 0),
b AS (SELECT l_orderkey, l_linenumber, l_suppkey, shot, CASE WHEN p_size < 40 THEN p_partkey % 25 END AS seen, p_size >= 40 AS none, p_size / 50.0 AS y FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN f ON l_suppkey = frame)
SELECT l_orderkey * 10 + l_linenumber AS subject, CASE WHEN shot IS NULL THEN 'frame_missing' WHEN none THEN 'locator_missing' WHEN seen <> shot THEN 'screenshot_differs' WHEN y > 0.5 THEN 'centre_outside' ELSE 'bound' END AS rule FROM b""")
def q_live_bindings(spark, d):
    """Line items as states, suppliers as frames and parts as located elements: bound, or why not."""
    states = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("state"), F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("element"))
    frames = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 0").select(F.col("s_suppkey").alias("frame"), F.col("s_nationkey").cast("long").alias("screenshot"))
    parts = read(spark, d, "part", "p_partkey", "p_size").where("p_size < 40")
    zero, half = F.lit(0.0), F.lit(0.5)
    at = parts.select(F.col("p_partkey").alias("element"), (F.col("p_partkey") % 25).alias("screenshot"), zero.alias("left"), zero.alias("top"), half.alias("width"), half.alias("height"), half.alias("x"), (F.col("p_size") / 50).alias("y"))
    locators = states.select("element", "frame").distinct().join(at, "element")
    bound, errors = evidence.live_bindings(states, frames, locators)
    return errors.select(F.col("subject").cast("long").alias("subject"), "rule").union(bound.select("state", F.lit("bound")))


# --- views -----------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT c_nationkey AS source, c_custkey % 30 AS target, c_acctbal < 0 AS shared FROM customer), o AS (SELECT s_nationkey AS page FROM supplier UNION ALL SELECT s_nationkey FROM customer JOIN supplier ON s_suppkey = c_custkey % 150)
SELECT n_nationkey AS page, (SELECT count(*) FROM o WHERE page = n_nationkey) AS owned, (SELECT count(*) FROM e WHERE target = n_nationkey) AS inbound,
  (SELECT count(*) FROM e WHERE source = n_nationkey) AS outbound, (SELECT count(*) FILTER (WHERE shared) FROM e WHERE source = n_nationkey) AS shared FROM nation""")
def q_page_statistics(spark, d):
    """Suppliers of each nation and the customers that lie in them, and links of customers from and to it."""
    pages = read(spark, d, "nation", "n_nationkey").toDF("page")
    edges = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 30).cast("int").alias("target"), (F.col("c_acctbal") < 0).alias("shared"))
    none = F.lit(None)
    elements = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("s", "s_suppkey").alias("element"), none.cast("string").alias("parent"), F.col("s_nationkey").alias("page"))
    inside = read(spark, d, "customer", "c_custkey").select(_name("c", "c_custkey").alias("element"), _name("s", F.col("c_custkey") % 150).alias("parent"), none.cast("int").alias("page"))
    return views.page_statistics(pages, elements.unionByName(inside), edges, keep)


@query("""
WITH p AS (SELECT 'p' || p_partkey AS page, 'k' || p_partkey || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.x' WHEN 2 THEN '.a.people' ELSE '.settings' END AS key, 'A-' || p_name AS label, CASE WHEN p_size % 10 = 0 THEN 'common' ELSE p_brand END AS domain, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS feature,
  p_partkey AS pos, CAST(1 + p_size % 4 % 3 + (p_size % 4 = 3)::INT AS BIGINT) AS depth FROM part),
v AS (SELECT p_brand AS domain, 'k' || min(p_partkey) FILTER (p_size % 4 = 0) AS page_key FROM part GROUP BY 1),
n AS (SELECT 'nav.' || v.domain AS node, v.domain, page AS nav_page FROM v LEFT JOIN p ON key = page_key),
e AS (SELECT o_orderkey AS edge, 'p' || o_custkey % (SELECT count(*) FROM part) AS source, 'p' || o_orderkey % (SELECT count(*) FROM part) AS target, o_orderstatus <> 'P' AS moves, o_orderpriority LIKE '1%' AS opens, o_orderkey % 3 > 0 AS preview FROM orders),
i AS (SELECT * FROM p WHERE domain <> 'common' AND feature <> ''),
f AS (SELECT domain, feature, arg_min(page, depth * 1000000000 + pos) AS default_page FROM i GROUP BY ALL),
fe AS (SELECT f.domain, f.feature, default_page, nav_page, n.node AS nav_node, arg_min(edge, CASE WHEN opens THEN 0 ELSE CAST(1000000000000 AS BIGINT) END + edge) AS entry FROM f LEFT JOIN n ON f.domain = n.domain LEFT JOIN e ON moves AND source = nav_page AND target = default_page GROUP BY ALL),
ar AS (SELECT target AS page, arg_min(edge, CASE WHEN opens THEN 0 ELSE CAST(1000000000000 AS BIGINT) END + edge) AS arrival FROM e WHERE moves AND preview AND source <> target GROUP BY 1),
nodes AS (SELECT node, 'nav' AS kind, domain AS label, nav_page AS page, NULL AS edge FROM n UNION ALL SELECT 'feature.' || domain || '.' || feature, 'feature', feature, default_page, entry FROM fe
  UNION ALL SELECT 'page.' || key, 'page', CASE WHEN depth = 2 THEN i.feature || '首页' WHEN key LIKE '%.people' THEN '全部成员' ELSE substr(label, 3) END, i.page, CASE WHEN i.page = default_page THEN entry ELSE arrival END FROM i JOIN fe USING (domain, feature) LEFT JOIN ar ON ar.page = i.page
  UNION ALL SELECT 'shared.' || key, 'shared', label, p.page, arrival FROM p LEFT JOIN ar ON ar.page = p.page WHERE domain = 'common'),
at_ AS (SELECT page, max(node) FILTER (kind <> 'nav') AS node, max(node) AS any_ FROM nodes WHERE page IS NOT NULL AND kind <> 'feature' GROUP BY page),
rel AS (SELECT a.node AS source, b.node AS target, min(edge) AS edge FROM e JOIN at_ a ON e.source = a.page JOIN at_ b ON e.target = b.page WHERE moves AND opens AND e.source <> e.target AND a.node IS NOT NULL AND b.node IS NOT NULL GROUP BY 1, 2)
SELECT kind AS what, node AS a, label AS b, page AS c, CAST(edge AS VARCHAR) AS d FROM nodes
UNION ALL SELECT 'view.entry.feature.' || domain || '.' || feature, nav_node, 'feature.' || domain || '.' || feature, 'navigation', CAST(entry AS VARCHAR) FROM fe WHERE nav_node IS NOT NULL
UNION ALL SELECT 'view.default.feature.' || domain || '.' || feature, 'feature.' || domain || '.' || feature, coalesce(at_.node, any_), 'relationship', CAST(entry AS VARCHAR) FROM fe JOIN at_ ON default_page = at_.page
UNION ALL SELECT 'view.relation.' || edge, source, target, 'relationship', CAST(edge AS VARCHAR) FROM rel""")
def q_layered_view(spark, d):
    """Parts as pages of makers and containers, orders as moves between them: nodes of four kinds and the links of three that are drawn."""
    p, k, size = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name", "p_size"), F.col("p_partkey"), F.col("p_size")
    n = p.count()
    end = F.when(size % 4 == 0, "").when(size % 4 == 1, ".x").when(size % 4 == 2, ".a.people").otherwise(".settings")
    pages = p.select(_name("p", k).alias("page"), F.concat(_name("k", k), end).alias("key"), F.concat(F.lit("A-"), "p_name").alias("label"), F.array(F.when(size % 10 == 0, "common").otherwise(F.col("p_brand")), F.when(size % 9 == 0, "").otherwise(F.col("p_type"))).alias("path"), k.alias("pos"))
    bars = p.groupBy(F.col("p_brand").alias("label")).agg(F.min(F.when(size % 4 == 0, k)).alias("first"))
    bars = bars.select(F.concat(F.lit("nav."), "label").alias("node"), "label", _name("k", "first").alias("page_key"), F.lit(0).alias("pos"))
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    edges = o.select(
        F.col("o_orderkey").alias("edge"), _name("p", F.col("o_custkey") % n).alias("source"), _name("p", F.col("o_orderkey") % n).alias("target"), F.when(F.col("o_orderstatus") == "P", "contract").otherwise("transition").alias("kind"),
        F.when(F.col("o_orderpriority").startswith("1"), "open_page").otherwise("tap").alias("capability"), F.when(F.col("o_orderkey") % 3 > 0, "seen").alias("preview"), F.lit("t").alias("trigger"), F.col("o_orderkey").alias("pos"),
    )
    nodes, links = views.layered_view(bars, pages, edges, "common")
    return nodes.select(F.col("kind").alias("what"), F.col("node").alias("a"), F.col("label").alias("b"), F.col("page").alias("c"), F.col("edge").cast("string").alias("d")).union(links.select("link", "source", "target", "kind", F.col("edge").cast("string")))


@query("""
WITH l AS (SELECT 'c' || s_suppkey AS old_key, CASE WHEN s_nationkey <> 3 THEN 'c' || (s_suppkey + CASE WHEN s_nationkey = 7 THEN 1 ELSE 1000000 END) END AS new_key FROM supplier),
o AS (SELECT c_custkey AS id, CASE WHEN old_key IS NULL THEN 'c' || c_custkey ELSE new_key END AS key FROM customer LEFT JOIN l ON 'c' || c_custkey = old_key WHERE old_key IS NULL OR new_key IS NOT NULL)
SELECT 'record' AS rule, CAST(id AS VARCHAR) AS subject, key AS detail FROM o UNION ALL SELECT 'key_repeated', key, CAST(count(*) AS VARCHAR) FROM o GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'ledger_target', old_key, '0' FROM l WHERE old_key NOT IN (SELECT 'c' || c_custkey FROM customer)""")
def q_migrate(spark, d):
    """Customers after a ledger of key changes, and what is wrong with it."""
    records = read(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), _name("c", "c_custkey").alias("key"))
    moved = F.col("s_suppkey") + F.when(F.col("s_nationkey") == 7, 1).otherwise(1000000)
    ledger = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("c", "s_suppkey").alias("old_key"), F.when(F.col("s_nationkey") != 3, F.concat(F.lit("c"), moved.cast("string"))).alias("new_key"))
    out, errors = views.migrate(records, ledger)
    return out.select(F.lit("record").alias("rule"), F.col("id").cast("string").alias("subject"), F.col("key").alias("detail")).union(errors.select("rule", F.col("subject").cast("string"), F.col("detail").cast("string")))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS DOUBLE) / 50 AS x, CAST(l_suppkey % 50 AS DOUBLE) / 50 AS y, l_quantity / 100 AS w, l_quantity / 80 AS h FROM lineitem)
SELECT o_orderkey AS point, l_linenumber AS element, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY w * h, l_linenumber) AS INT) AS place
FROM orders JOIN b ON o_orderkey = l_orderkey WHERE 0.6 BETWEEN x AND x + w AND 0.7 BETWEEN y AND y + h""")
def q_hit_test(spark, d):
    """The boxes of each order under a point, the smallest first."""
    b = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    boxes = b.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("element"), ((F.col("l_partkey") % 50).cast("double") / 50).alias("x"), ((F.col("l_suppkey") % 50).cast("double") / 50).alias("y"), (F.col("l_quantity") / 100).alias("width"), (F.col("l_quantity") / 80).alias("height"))
    points = read(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("point"), F.lit(0.6).alias("px"), F.lit(0.7).alias("py"))
    return views.hit_test(boxes, points)


# --- graphs ----------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 3 % (SELECT count(*) FROM customer) END AS b FROM customer),
w(s, t, n) AS (SELECT a, b, 1 FROM e WHERE b IS NOT NULL UNION ALL SELECT s, e.b, n + 1 FROM w JOIN e ON t = e.a WHERE e.b IS NOT NULL AND n < (SELECT count(*) FROM customer))
SELECT s AS node FROM w WHERE n = (SELECT count(*) FROM customer)""")
def q_owner_cycle(spark, d):
    """Customers whose chain of owners `k -> 3k mod n` never ends; multiples of 5 have no owner."""
    c = read(spark, d, "customer", "c_custkey")
    k = F.col("c_custkey")
    return graph.leads_to_cycle(c.select(k.alias("node"), F.when(k % 5 != 0, k * 3 % c.count()).alias("parent")), keep)


@query("""
WITH RECURSIVE t(node, parent, pos) AS (
  SELECT 'r' || r_regionkey, NULL, r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier),
f(node, depth, place) AS (SELECT node, 0, CAST(pos AS VARCHAR) FROM t WHERE parent IS NULL UNION ALL SELECT t.node, depth + 1, place || ',' || t.pos FROM f JOIN t ON t.parent = f.node)
SELECT * FROM f""")
def q_flatten_tree(spark, d):
    """Regions, nations and suppliers as one tree: depth and place of every node."""
    rows = read(spark, d, "region", "r_regionkey").select(_name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"))
    rows = rows.union(read(spark, d, "nation", "n_nationkey", "n_regionkey").select(_name("n", "n_nationkey"), _name("r", "n_regionkey"), F.col("n_nationkey").cast("long")))
    rows = rows.union(read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("s", "s_suppkey"), _name("n", "s_nationkey"), "s_suppkey"))
    return graph.flatten_tree(rows, keep).withColumn("place", F.array_join("place", ","))


@query("""
WITH RECURSIVE t(node, parent, pos, visible) AS (
  SELECT 'r' || r_regionkey, NULL, r_regionkey, r_regionkey <> 2 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, -n_nationkey, n_nationkey % 3 > 0 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey % 4, s_acctbal >= 0 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 's' || (c_custkey % (SELECT count(*) + 3 FROM supplier)), c_custkey, c_acctbal >= 1000 FROM customer),
k AS MATERIALIZED (SELECT node, CASE WHEN parent IN (SELECT node FROM t) THEN parent END AS parent, visible, CAST(row_number() OVER (PARTITION BY parent ORDER BY pos, node) AS BIGINT) AS at FROM t),
f(node, tree, visible, depth, path, seen) AS (SELECT node, node, visible, 0, CAST([0] AS BIGINT[]), CAST(NULL AS VARCHAR) FROM k WHERE parent IS NULL
  UNION ALL SELECT k.node, tree, k.visible, depth + 1, list_append(path, k.at), CASE WHEN f.visible THEN f.node ELSE f.seen END FROM f JOIN k ON k.parent = f.node)
SELECT node, tree, row_number() OVER (PARTITION BY tree ORDER BY path) AS place, depth, seen AS parent FROM f WHERE visible""")
def q_hoisted_tree(spark, d):
    """Regions, nations, suppliers and customers as trees in which some nodes are hidden: the place, depth and visible parent of those that are seen. Customers of unknown suppliers are roots."""
    rows = read(spark, d, "region", "r_regionkey").select(_name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"), (F.col("r_regionkey") != 2).alias("visible"))
    n = F.col("n_nationkey")
    rows = rows.union(read(spark, d, "nation", "n_nationkey", "n_regionkey").select(_name("n", n), _name("r", "n_regionkey"), -n.cast("long"), n % 3 > 0))
    suppliers = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    rows = rows.union(suppliers.select(_name("s", "s_suppkey"), _name("n", "s_nationkey"), F.col("s_suppkey") % 4, F.col("s_acctbal") >= 0))
    held = _name("s", F.col("c_custkey") % (suppliers.count() + 3))
    rows = rows.union(read(spark, d, "customer", "c_custkey", "c_acctbal").select(_name("c", "c_custkey"), held, "c_custkey", F.col("c_acctbal") >= 1000))
    return graph.preorder(rows, keep)


@query("""
WITH RECURSIVE t AS (
  SELECT 's' || s_suppkey AS element, 'n' || s_nationkey AS parent, CAST(NULL AS BIGINT) AS page, CAST([] AS BIGINT[]) AS pages FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS BIGINT), [CAST(n_nationkey + 100 AS BIGINT)] FROM nation
  UNION ALL SELECT 'r' || r_regionkey, NULL, NULL, [CAST(r_regionkey + 200 AS BIGINT), r_regionkey + 300] FROM region),
c(element, at_) AS (SELECT element, element FROM t UNION SELECT c.element, t.parent FROM c JOIN t ON at_ = t.element WHERE t.parent IS NOT NULL)
SELECT DISTINCT element, page FROM (SELECT c.element, unnest(pages) AS page FROM c JOIN t ON at_ = t.element UNION ALL SELECT element, page FROM t WHERE page IS NOT NULL)""")
def q_availability(spark, d):
    """Pages on which suppliers, nations and regions are available, by their own or an ancestor's list."""
    none = F.array().cast("array<bigint>")
    kind = F.lit("component")
    rows = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_name("s", "s_suppkey").alias("element"), _name("n", "s_nationkey").alias("parent"), kind.alias("owner_kind"), F.lit(None).cast("long").alias("page"), none.alias("pages"))
    n, r = F.col("n_nationkey").cast("long"), F.col("r_regionkey").cast("long")
    rows = rows.union(read(spark, d, "nation", "n_nationkey", "n_regionkey").select(_name("n", "n_nationkey"), _name("r", "n_regionkey"), kind, n, F.array(n + 100)))
    rows = rows.union(read(spark, d, "region", "r_regionkey").select(_name("r", "r_regionkey"), F.lit(None).cast("string"), kind, F.lit(None).cast("long"), F.array(r + 200, r + 300)))
    return graph.availability(rows, keep).select("element", "page")


@query("""
SELECT s_nationkey AS parent, array_to_string(list(s_suppkey ORDER BY CASE WHEN s_acctbal > 5000 THEN s_suppkey ELSE 2147483647 END, s_name, s_suppkey), ',') AS children FROM supplier GROUP BY 1""")
def q_children_order(spark, d):
    """Suppliers of each nation: rich ones in the known order, then the rest by name."""
    rows = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name", "s_acctbal").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("key"), F.col("s_nationkey").alias("parent"), F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey")).cast("int").alias("pos"))
    return graph.children_in_order(rows).withColumn("children", F.array_join("children", ","))


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 48)")
def q_orphans(spark, d):
    """Parts that no large line item links, as part or as supplier's number."""
    edges = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").where("l_quantity >= 48").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return graph.orphans(read(spark, d, "part", "p_partkey").toDF("node"), edges)


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b, CAST(l_linenumber % 2 AS VARCHAR) AS kind, l_shipdate AS key FROM lineitem)
SELECT a, b, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY kind, key, a) AS r FROM e) WHERE r = 1""")
def q_preferred_edges(spark, d):
    """One link per pair of numbers: of an even line first, then the earliest."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate")
    edges = lines.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), (F.col("l_linenumber") % 2).cast("string").alias("kind"), F.col("l_shipdate").alias("key")).distinct()
    return graph.preferred_edges(edges)


# --- constraints -----------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, d):
    """Nations and segments that more than one customer shares."""
    return K.duplicates(read(spark, d, "customer", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment")
