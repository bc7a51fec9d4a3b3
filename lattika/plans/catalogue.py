"""Queries that run the operators on the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import geometry as G
from lattika.functions.nested import at_path
from lattika.operators import constraints as K
from lattika.operators import graph, merging, selection
from lattika.operators.components import connected_components
from lattika.operators.hashing import files_hash, ordered_hash
from lattika.operators.matching import compare_boxes
from lattika.operators.rounds import keep, partitions_for
from lattika.sources.readers import html_links
from lattika.streaming.sessions import accumulated

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table; from here on shuffles have as many partitions as its size asks for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions_for(df)
    return df.select(*columns) if columns else df


# --- constraints -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def q_dangling_orders(spark, d):
    """Orders whose customer is not among those in credit."""
    good = read(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal >= 0")
    return K.dangling(read(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", good, "c_custkey")


@query("SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id AND lang = 'en')")
def q_dangling_labels(spark, d):
    """Labels of documents that are not English."""
    english = read(spark, d, "documents", "doc_id", "lang").where("lang = 'en'")
    return K.dangling(read(spark, d, "labels"), "doc_id", english, "doc_id")


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def q_dup_documents(spark, d):
    """Texts that occur more than once, and the first document of each."""
    texts = read(spark, d, "documents", "doc_id", "text").where("text <> ''").select("doc_id", F.md5("text").alias("text_md5"))
    return texts.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text <> '') WHERE r = 1""")
def q_keep_first(spark, d):
    """The first document of each text."""
    texts = read(spark, d, "documents", "doc_id", "text").where("text <> ''").select("doc_id", F.md5("text").alias("key"))
    return selection.keep_first(texts, "key", "doc_id").select("doc_id")


@query("""
SELECT e.event_id, e.event_type, e.user_id % 3 AS kind FROM events e
WHERE NOT CASE e.user_id % 3 WHEN 0 THEN true WHEN 1 THEN e.event_type IN ('click', 'view') ELSE e.event_type IN ('purchase', 'signup', 'view') END""")
def q_domain_range(spark, d):
    """Events whose type the rules of their kind of user do not allow."""
    rules = spark.createDataFrame([(0, ["*"]), (1, ["click", "view"]), (2, ["purchase", "signup", "view"])], "rule_kind long, allowed array<string>")
    events = read(spark, d, "events", "event_id", "event_type", "user_id").withColumn("kind", F.col("user_id") % 3).drop("user_id")
    return K.outside_domain(events, "kind", "event_type", rules, "rule_kind", "allowed")


@query("""
WITH s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_acctbal > 2000), c AS (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000)
SELECT nation, 'left' AS side FROM s WHERE nation NOT IN (FROM c) UNION ALL SELECT nation, 'right' FROM c WHERE nation NOT IN (FROM s)""")
def q_reciprocal_sets(spark, d):
    """Nations with rich suppliers or rich customers, but not both."""
    s = read(spark, d, "supplier", "s_nationkey", "s_acctbal").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("nation"))
    c = read(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return K.set_difference(s, c, "nation")


@query("SELECT doc_id, array_to_string(list_filter([lang, source], lambda x: x NOT IN ('en', 'fr', 'src0', 'src1', 'src2')), ',') AS unknown FROM documents WHERE lang NOT IN ('en', 'fr') OR source NOT IN ('src0', 'src1', 'src2')")
def q_option_membership(spark, d):
    """Documents whose language or source is not on a list, and what is not."""
    allowed = F.array(*map(F.lit, ("en", "fr", "src0", "src1", "src2")))
    docs = read(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.array("lang", "source").alias("values"))
    return K.unknown_members(docs, "values", allowed).select("doc_id", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT l_partkey AS part, array_to_string(list_sort(list(l_suppkey)), ',') AS parents FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey HAVING count(*) > 1")
def q_several_parents(spark, d):
    """Parts that more than one returned line item holds, with their suppliers."""
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")
    found = K.several_parents(lines.select(F.col("l_partkey").alias("part"), "l_suppkey"), "part", "l_suppkey")
    return found.select("part", F.array_join("parents", ",").alias("parents"))


@query("""
WITH r AS (SELECT user_id, count(*) AS records FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT user_id, count(*) AS cards FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, coalesce(records, 0) AS records, coalesce(cards, 0) AS cards FROM r FULL JOIN c USING (user_id) WHERE coalesce(records, 0) <> 1 OR coalesce(cards, 0) <> 1""")
def q_card_match(spark, d):
    """Users without exactly one signup and one error."""
    e = read(spark, d, "events", "user_id", "event_type")
    return K.card_match(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), "user_id")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS values FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def q_signature_reuse(spark, d):
    """Sources that hold more than one language."""
    return K.reused(read(spark, d, "documents", "source", "lang"), ["source"], "lang").withColumn("values", F.array_join("values", ","))


# --- selection -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def q_latest_per_key(spark, d):
    """The latest event of each user."""
    return selection.latest(read(spark, d, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("""
SELECT user_id, p.event_id AS purchase_id, q.event_id AS error_id, q.gap FROM events p LEFT JOIN LATERAL (
  SELECT e.event_id, abs(epoch_us(e.ts) - epoch_us(p.ts)) AS gap FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' ORDER BY gap, e.event_id LIMIT 1) q ON true
WHERE p.event_type = 'purchase'""")
def q_nearest_pair(spark, d):
    """The error nearest in time to each purchase of a user."""
    e = read(spark, d, "events", "user_id", "event_id", "event_type", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    p = e.where("event_type = 'purchase'").select("user_id", "us", F.col("event_id").alias("purchase_id"))
    r = e.where("event_type = 'error'").select("user_id", "us", F.col("event_id").alias("error_id"))
    return selection.nearest_pairs(p, r, ["user_id"], "us", "us", "purchase_id", "error_id").withColumn("gap", F.col("gap").cast("long"))


@query("SELECT user_id, CASE min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 END) WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'click' END AS status FROM events GROUP BY user_id")
def q_status_lattice(spark, d):
    """The gravest event type of each user."""
    return selection.status_lattice(read(spark, d, "events", "user_id", "event_type"), ["user_id"], "event_type", ["error", "purchase", "signup", "click"])


@query("""
WITH f AS (SELECT o_orderkey, bool_and(l_quantity >= 2) AS good FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey FROM f WHERE coalesce(good, true)""")
def q_evidence_qualify(spark, d):
    """Orders all of whose line items are of quantity 2 or more; orders without items qualify."""
    lines = read(spark, d, "lineitem", "l_orderkey", "l_quantity").select("l_orderkey", F.when(F.col("l_quantity") >= 2, "pass").otherwise("fail").alias("status"))
    asserted = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("status")).alias("assertions"))
    orders = read(spark, d, "orders", "o_orderkey").join(asserted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.where(selection.qualified(orders, "assertions")).select("o_orderkey")


@query("""
SELECT target, doc_id FROM documents, (VALUES ('low', '^(?:src[0-4]|src1)$'), ('teens', '^(?:src1\\d)$'), ('nine', '^(?:src9)$'), ('twice', '^(?:src(0|11|22|33|44)|src[5-9])$')) t(target, p) WHERE regexp_matches(source, p)""")
def q_theta_match(spark, d):
    """Documents whose source matches one of a target's patterns."""
    targets = spark.createDataFrame([("low", ["src[0-4]", "src1"]), ("teens", [r"src1\d"]), ("nine", ["src9", "src9("]), ("twice", [r"src(\d)\1", "(src)(0)", "src[5-9]"])], "target string, patterns array<string>")
    return selection.pattern_matches(targets, read(spark, d, "documents", "doc_id", "source"), "source").select("target", "doc_id")


@query("SELECT conv_id, turn, length(text) AS size, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM conversations")
def q_running_offsets(spark, d):
    """Where each turn begins within its conversation."""
    turns = read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return selection.running_offsets(turns, ["conv_id"], "turn", "size")


@query("""
SELECT label, vec_id, CASE WHEN b IS NULL THEN NULL ELSE round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - b[i]))) / len(e), 9) END AS distance
FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)""")
def q_stability(spark, d):
    """The distance of each vector to the one before it under its label."""
    rows = selection.consecutive_distance(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 1.0)
    return rows.select("label", "vec_id", F.round("distance", 9).alias("distance"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def q_conditional_stats(spark, d):
    """Conditional counts of line items."""
    lines = read(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_discount")
    return lines.groupBy("l_linestatus").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if((F.col("l_returnflag") != "R") & (F.col("l_discount") > 0.05)).alias("discounted"))


@query("""
WITH b AS (SELECT l_suppkey, l_discount AS x, l_tax AS y, l_quantity / 100 AS w, l_linenumber / 10.0 AS h FROM lineitem)
SELECT l_suppkey, min(x) AS x, min(y) AS y, round(max(x + w) - min(x), 9) AS width, round(max(y + h) - min(y), 9) AS height FROM b GROUP BY 1""")
def q_union_box(spark, d):
    """The least box around the boxes of each supplier's items."""
    b = read(spark, d, "lineitem", "l_suppkey", "l_discount", "l_tax", "l_quantity", "l_linenumber")
    box = G.union_box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_linenumber") / 10)
    return b.groupBy("l_suppkey").agg(box.alias("b")).select("l_suppkey", "b.x", "b.y", F.round("b.width", 9).alias("width"), F.round("b.height", 9).alias("height"))


@query("SELECT sha256(string_agg(doc_id || ':' || sha256(text) || chr(10), '' ORDER BY doc_id || ':' || sha256(text) || chr(10))) AS root_hash, source FROM documents GROUP BY source")
def q_content_hash(spark, d):
    """A root hash over each source's documents."""
    docs = read(spark, d, "documents", "doc_id", "text", "source").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256), F.lit("\n")).alias("line"))
    return ordered_hash(docs, ["source"], ["line"], F.col("line").cast("binary")).withColumnRenamed("hash", "root_hash")


@query("SELECT sha256(string_agg('docs/' || doc_id || '.txt' || chr(1) || coalesce(text, '') || chr(1), '' ORDER BY 'docs/' || doc_id || '.txt')) AS hash FROM documents")
def q_files_hash(spark, d):
    """One hash over the paths and bytes of all documents as files, in order of their paths; the mark between them is 1, as SQL texts hold no 0."""
    docs = read(spark, d, "documents", "doc_id", "text").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return files_hash(docs, mark=b"\x01")


@query("""
WITH k AS (SELECT l_suppkey, l_orderkey % 50 AS i, l_partkey, l_discount, l_tax FROM lineitem),
items AS (SELECT 's' || l_suppkey AS list_key, CAST(i AS INT) AS index, count(*) AS n, count(DISTINCT l_partkey) AS members, min(l_discount) AS x, min(l_tax) AS y FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT list_key, index, members, x, y FROM (SELECT *, count(*) OVER (PARTITION BY list_key) AS c FROM items) WHERE c >= 2""")
def q_repeat_items(spark, d):
    """Items that repeat in lists, from keys such as `s4.17.p9`."""
    k = read(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_discount", "l_tax")
    key = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("."), (F.col("l_orderkey") % 50).cast("string"), F.lit(".p"), F.col("l_partkey").cast("string"))
    elements = k.select(key.alias("key"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"), F.lit(1.0).alias("confidence"))
    return merging.repeated_items(elements).select("list_key", "index", F.size("members").cast("long").alias("members"), "box.x", "box.y")


# --- merges and versions ---------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS hash FROM orders),
o AS (SELECT o_orderkey AS path, o_totalprice AS hash FROM orders WHERE o_orderkey % 7 <> 0)
SELECT path, CASE WHEN o.path IS NULL THEN 'add' ELSE 'update' END AS change FROM n LEFT JOIN o USING (path) WHERE o.path IS NULL OR n.hash <> o.hash""")
def q_semantic_diff(spark, d):
    """Orders that a changed snapshot adds or updates."""
    o = read(spark, d, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("hash"))
    staged = o.withColumn("hash", F.when(F.col("path") % 11 == 0, F.col("hash") + 1).otherwise(F.col("hash")))
    return merging.semantic_diff(o.where("path % 7 <> 0"), staged, "path", "hash")


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0)
SELECT c_custkey, array_to_string(changes, ',') AS changes FROM (SELECT c_custkey, CASE WHEN a.c_nationkey IS NULL THEN ['added'] WHEN b.c_nationkey IS NULL THEN ['removed']
  ELSE list_filter([CASE WHEN a.c_nationkey <> b.c_nationkey THEN 'c_nationkey' END, CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' END], lambda x: x IS NOT NULL) END AS changes
FROM a FULL JOIN b USING (c_custkey)) WHERE len(changes) > 0""")
def q_row_changes(spark, d):
    """Which fields of customers differ between two snapshots."""
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    after = c.where("c_custkey % 13 <> 0").withColumns({"c_nationkey": F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(F.col("c_custkey") % 6 == 0, "X").otherwise(F.col("c_mktsegment"))})
    return merging.row_changes(c.where("c_custkey % 10 <> 0"), after, "c_custkey", ["c_nationkey", "c_mktsegment"]).withColumn("changes", F.array_join("changes", ","))


_WRITES = "SELECT user_id AS path, event_type AS hash, ts, event_id FROM events"


@query(f"SELECT path, hash, previous, event_id FROM (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts, event_id) AS previous FROM ({_WRITES})) WHERE previous IS NOT NULL AND previous <> hash")
def q_lww_conflicts(spark, d):
    """Writes that change what the write before left under a path."""
    w = read(spark, d, "events", "user_id", "event_type", "ts", "event_id").select(F.col("user_id").alias("path"), F.col("event_type").alias("hash"), "ts", "event_id")
    return merging.last_writer_wins(w, "path", "hash", "ts", "event_id")[1].drop("ts")


@query(f"SELECT path, hash, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM ({_WRITES})) WHERE r = 1")
def q_lww_winners(spark, d):
    """What the last write leaves under each path."""
    w = read(spark, d, "events", "user_id", "event_type", "ts", "event_id").select(F.col("user_id").alias("path"), F.col("event_type").alias("hash"), "ts", "event_id")
    return merging.last_writer_wins(w, "path", "hash", "ts", "event_id")[0].drop("ts")


@query("""
SELECT p_partkey AS pos, coalesce((SELECT min(p_partkey) FROM part k WHERE k.p_partkey % 2 = 0 AND k.p_brand = p.p_brand AND k.p_name = p.p_name),
  (SELECT min(p_partkey) FROM part k WHERE k.p_partkey % 2 = 0 AND k.p_brand = p.p_brand AND k.p_type = p.p_type HAVING count(*) = 1)) AS id
FROM part p WHERE p_partkey % 2 = 1""")
def q_entity_resolution(spark, d):
    """Parts resolved to known parts of their brand, by name or by a type that is unique there."""
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("key"), F.col("p_type").alias("label"))
    return merging.resolve(p.where("id % 2 = 1").withColumnRenamed("id", "pos"), p.where("id % 2 = 0")).select("pos", "id")


# --- graphs ----------------------------------------------------------------------------------------------------------


@query("""
SELECT 's' || s_suppkey AS node, 'r' || n_regionkey AS terminal, 2 AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region""")
def q_closure_region(spark, d):
    """The region at the end of each chain supplier, nation, region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent"))
    nodes = nodes.union(read(spark, d, "nation", "n_nationkey", "n_regionkey").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    nodes = nodes.union(read(spark, d, "region", "r_regionkey").select(name("r", "r_regionkey"), F.lit(None).cast("string")))
    return graph.terminal_owner(nodes, keep).select("node", "terminal", "hops")


_HOPS = "SELECT s_suppkey AS a, s_suppkey * 2 % (SELECT count(*) FROM supplier) AS b, 'x' || s_suppkey AS key, 1 + s_suppkey % 4 AS w FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + 7) % (SELECT count(*) FROM supplier), 'y' || s_suppkey, 3 FROM supplier"
#: Rounds in the SQL below; more than the steps of a best route.
_HOP_ROUNDS = 24


def _relaxed() -> str:
    best = "SELECT node, min({'cost': cost, 'steps': steps, 'tie': tie}) AS r FROM ({rows}) GROUP BY node"
    step = lambda i: f"SELECT node, r.cost AS cost, r.steps AS steps, r.tie AS tie FROM r{i} UNION ALL SELECT e.b, r.cost + e.w, r.steps + 1, CASE WHEN r.tie = '' THEN '0:' || key ELSE r.tie || '>0:' || key END FROM r{i} JOIN e ON node = e.a"
    rounds = [f"r{i + 1} AS MATERIALIZED ({best.replace('{rows}', step(i))})" for i in range(_HOP_ROUNDS)]
    return f"WITH e AS MATERIALIZED ({_HOPS}), r0 AS (SELECT 1 AS node, {{'cost': 0, 'steps': 0, 'tie': ''}} AS r), {', '.join(rounds)} SELECT CAST(node AS BIGINT) AS node, CAST(r.cost AS DOUBLE) AS cost, CAST(r.steps AS INT) AS steps, r.tie AS tie FROM r{_HOP_ROUNDS}"


@query(_relaxed())
def q_shortest_path(spark, d):
    """The best route from supplier 1 to every supplier, over links `k -> 2k` and `k -> k + 7`, modulo their number."""
    n = read(spark, d, "supplier", "s_suppkey")
    k, total = F.col("s_suppkey"), n.count()
    one = n.select(k.alias("a"), (k * 2 % total).alias("b"), F.concat(F.lit("x"), k.cast("string")).alias("key"), (1 + k % 4).alias("cost"), F.lit("0").alias("kind"))
    two = n.select(k.alias("a"), ((k + 7) % total).alias("b"), F.concat(F.lit("y"), k.cast("string")).alias("key"), F.lit(3).alias("cost"), F.lit("0").alias("kind"))
    return graph.routes(one.union(two), n.where("s_suppkey = 1").select(k.alias("node")), keep).select("node", "cost", "steps", "tie")


_JUMPS = "SELECT c_custkey AS a, c_custkey * 3 % (SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey % 5 <> 0"


@query(f"""
WITH RECURSIVE e AS ({_JUMPS}), p(s, t, n) AS (SELECT a, b, 1 FROM e UNION ALL SELECT s, e.b, n + 1 FROM p JOIN e ON t = e.a WHERE n < (SELECT count(*) FROM customer) AND t <> s)
SELECT DISTINCT s AS node FROM p WHERE s = t""")
def q_cycle_nodes(spark, d):
    """Customers on cycles of `k -> 3k mod n`, n being their number; multiples of 5 lead nowhere."""
    k = F.col("c_custkey")
    customers = read(spark, d, "customer", "c_custkey")
    return graph.on_cycles(customers.select(k.alias("a"), F.when(k % 5 != 0, k * 3 % customers.count()).alias("b")), keep)


_NEAR = "SELECT l_suppkey AS a, 1000000000 + l_partkey AS b FROM lineitem"
#: Rounds of least labels in the SQL below; more than the diameter of the graph of suppliers and parts.
_ROUNDS = 12


def _labels() -> str:
    steps = [f"l{i + 1} AS MATERIALIZED (SELECT l.node, least(l.t, min(m.t)) AS t FROM l{i} l JOIN e ON l.node = e.a JOIN l{i} m ON e.b = m.node GROUP BY l.node, l.t)" for i in range(_ROUNDS)]
    return f"WITH e AS MATERIALIZED (SELECT a, b FROM ({_NEAR}) UNION SELECT b, a FROM ({_NEAR})), l0 AS (SELECT DISTINCT a AS node, a AS t FROM e), {', '.join(steps)} SELECT node, t AS component FROM l{_ROUNDS}"


def _supplied(spark, d):
    return read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b"))


@query(_labels())
def q_components(spark, d):
    """Suppliers and parts connected by line items."""
    return connected_components(_supplied(spark, d), "a", "b", keep)


@query(f"""
WITH RECURSIVE e AS (SELECT a, b FROM ({_NEAR}) UNION SELECT b, a FROM ({_NEAR})),
f(node, depth) AS (SELECT min(a), 0 FROM e UNION SELECT e.b, depth + 1 FROM f JOIN e ON node = e.a WHERE depth < {_ROUNDS}),
m AS (SELECT node, min(depth) AS depth FROM f GROUP BY node)
SELECT a AS node, coalesce(depth, (SELECT max(depth) + 1 FROM m)) AS depth FROM (SELECT DISTINCT a FROM e) LEFT JOIN m ON a = node""")
def q_bfs_depth(spark, d):
    """Steps from the first supplier of the same graph."""
    edges = _supplied(spark, d)
    return graph.depths(edges, edges.agg(F.min("a").alias("node")), keep)


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 40 AS b FROM lineitem), i AS (SELECT b AS node, array_to_string(list_sort(list(a)), ',') AS s FROM e GROUP BY b), o AS (SELECT a AS node, array_to_string(list_sort(list(b)), ',') AS s FROM e GROUP BY a)
SELECT s_suppkey AS node, coalesce(i.s, '') AS inbound, coalesce(o.s, '') AS outbound FROM supplier LEFT JOIN i ON i.node = s_suppkey LEFT JOIN o ON o.node = s_suppkey""")
def q_adjacency(spark, d):
    """Inbound and outbound neighbours of every supplier, by line items."""
    edges = read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"))
    nodes = read(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("node"))
    found = graph.adjacency(edges, nodes)
    return found.select("node", *[F.array_join(c, ",").alias(c) for c in ("inbound", "outbound")])


# --- geometry --------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) / 100 AS x, CAST(p_partkey * 7 % 90 AS DOUBLE) / 100 AS y, 0.02 + CAST(p_size AS DOUBLE) / 200 AS w, 0.02 + CAST(p_partkey % 9 AS DOUBLE) / 90 AS h FROM part),
n AS (SELECT unnest(range(1, 13)) AS n),
cells AS (
  SELECT p_partkey, n, 'x' AS axis, floor(x * n) AS c, x * n - floor(x * n) AS s, w * n AS z, ceil((x + w) * n - 1e-9) - 1 AS last FROM b, n
  UNION ALL SELECT p_partkey, n, 'y', floor(y * n), y * n - floor(y * n), h * n, ceil((y + h) * n - 1e-9) - 1 FROM b, n),
best AS (
  SELECT p_partkey, axis, coalesce(max(n) FILTER (WHERE c = last AND c < n AND s >= greatest(0.025, z * 0.1) - 1e-9 AND 1 - (s + z) >= greatest(0.025, z * 0.1) - 1e-9), max(n) FILTER (WHERE c = last AND c < n)) AS k
  FROM cells GROUP BY 1, 2)
SELECT b.p_partkey, CAST(coalesce(i.k, 1) AS INT) AS columns, CAST(coalesce(j.k, 1) AS INT) AS rows,
  CAST(coalesce(floor(y * j.k), 0) * coalesce(i.k, 1) + coalesce(floor(x * i.k), 0) + 1 AS INT) AS region
FROM b JOIN best i ON i.p_partkey = b.p_partkey AND i.axis = 'x' JOIN best j ON j.p_partkey = b.p_partkey AND j.axis = 'y'""")
def q_grid_region(spark, d):
    """The finest grid that holds a box in one cell."""
    p = read(spark, d, "part", "p_partkey", "p_size")
    key = F.col("p_partkey")
    x, y = ((k % 90).cast("double") / 100 for k in (key, key * 7))
    grid = G.grid_for_box(x, y, F.lit(0.02) + F.col("p_size").cast("double") / 200, F.lit(0.02) + (key % 9).cast("double") / 90, F.lit(12), F.lit(12))
    return p.select("p_partkey", grid.alias("g")).select("p_partkey", "g.columns", "g.rows", "g.region")


_BOXES = "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS DOUBLE) / 50 AS x, CAST(l_suppkey % 50 AS DOUBLE) / 50 AS y, l_quantity / 100 AS w, l_quantity / 80 AS h FROM lineitem"


def _boxes(spark, d):
    b = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return b.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 50).cast("double") / 50).alias("x"), ((F.col("l_suppkey") % 50).cast("double") / 50).alias("y"), (F.col("l_quantity") / 100).alias("w"), (F.col("l_quantity") / 80).alias("h"))


@query(f"""
WITH b AS ({_BOXES}), p AS (
  SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s,
  a.w * a.h + b.w * b.h AS t FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, i, j, round(s / (t - s), 9) AS iou FROM p WHERE s / (t - s) >= 0.2""")
def q_iou_pairs(spark, d):
    """Overlapping boxes of an order."""
    a, b = _boxes(spark, d).alias("a"), _boxes(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    value = G.iou(tuple(F.col(f"a.{c}") for c in "xywh"), tuple(F.col(f"b.{c}") for c in "xywh"))
    return pairs.select("a.l_orderkey", F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"), value.alias("iou")).where("iou >= 0.2").withColumn("iou", F.round("iou", 9))


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS frame, l_linenumber AS n, min({{'x': x, 'y': y, 'w': w, 'h': h}}) AS v FROM ({_BOXES}) GROUP BY ALL),
l AS (SELECT frame, 'k' || n AS key, n, v.*, row_number() OVER (PARTITION BY frame ORDER BY n) AS turn FROM b WHERE n % 2 = 1),
r AS (SELECT frame, 'k' || n AS key, n, v.* FROM b WHERE n % 2 = 0),
p AS (SELECT l.frame, l.turn, r.key, r.n, greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) AS both_,
  l.w * l.h + r.w * r.h AS area, sqrt(pow(l.x + l.w / 2 - r.x - r.w / 2, 2) + pow(l.y + l.h / 2 - r.y - r.h / 2, 2)) AS apart FROM l JOIN r ON l.frame = r.frame),
s AS (SELECT frame, turn, key, n, CASE WHEN both_ / (area - both_) >= 0.2 THEN both_ / (area - both_) + 1 WHEN apart <= 0.06 THEN 0.5 - apart END AS score FROM p),
c AS (SELECT frame, turn, list(key ORDER BY score DESC, n) AS wanted FROM s WHERE score IS NOT NULL GROUP BY frame, turn),
walk AS (
  SELECT DISTINCT frame, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS left_key, CAST(NULL AS VARCHAR) AS got FROM l
  UNION ALL
  SELECT w.frame, l.turn, list_concat(w.used, list_filter(coalesce(c.wanted, []), lambda v: NOT list_contains(w.used, v))[1:1]), l.key, list_filter(coalesce(c.wanted, []), lambda v: NOT list_contains(w.used, v))[1]
  FROM walk w JOIN l ON l.frame = w.frame AND l.turn = w.turn + 1 LEFT JOIN c ON c.frame = l.frame AND c.turn = l.turn)
SELECT frame, left_key, got AS right_key, CASE WHEN got IS NULL THEN 'left' ELSE 'place' END AS how FROM walk WHERE turn > 0
UNION ALL SELECT frame, NULL, key, 'right' FROM r WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.frame = r.frame AND walk.got = r.key)""")
def q_greedy_match(spark, d):
    """Boxes of odd and even line numbers of an order, matched one to one."""
    one = F.min(F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))).alias("box")  # of rows of one line the least
    b = _boxes(spark, d).groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("pos")).agg(one)
    b = b.select("frame", F.concat(F.lit("k"), F.col("pos").cast("string")).alias("key"), "pos", "box.*")
    return compare_boxes(b.where("pos % 2 = 1"), b.where("pos % 2 = 0"), "frame", keep)


# --- texts and nested values -----------------------------------------------------------------------------------------


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def q_html_links(spark, d):
    """Links of pages and how often each occurs."""
    return html_links(read(spark, d, "pages", "page_id", "html"), "page_id", "html").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def q_html_tags(spark, d):
    """How often and on how many pages tags open."""
    tags = read(spark, d, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_path(spark, d):
    """The value of `k` in events' properties."""
    return read(spark, d, "events", "event_id", "props").select("event_id", at_path(F.col("props"), "k", "bigint").alias("k"))


@query("SELECT conv_id AS session, string_agg(coalesce(text, ''), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def q_stream_replay(spark, d):
    """Conversations put together from their turns."""
    return accumulated(read(spark, d, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), "text"))


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS INT) AS sequence FROM customer")
def q_sequence(spark, d):
    """Numbers from 1 for the customers of each nation."""
    from pyspark.sql import Window

    return read(spark, d, "customer", "c_nationkey", "c_name", "c_custkey").withColumn("sequence", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey"))).drop("c_name")
