from pyspark.sql import functions as F

from lattika.operators import evidence
from lattika.operators.rounds import keep
from lattika.plans import views

RECT = "struct<left:double,top:double>"


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=str)


def test_candidates_and_traces(spark):
    targets = spark.createDataFrame([("t", ["row.*", "exact"])], "target string, patterns array<string>")
    controls = spark.createDataFrame([("row1", "f1", "2", None, (1.0, 1.0)), ("exact", "f2", "1", (2.0, 2.0), (3.0, 3.0)), ("row2", "f3", "9", None, None)], f"key string, frame string, captured_at string, locator {RECT}, geometry {RECT}")
    traces = spark.createDataFrame([("row9", "f4", "3", [("fail", (0.0, 0.0)), ("pass", (4.0, 4.0))])], f"key string, frame string, captured_at string, attempts array<struct<status:string,rect:{RECT}>>")
    found = evidence.control_candidates(targets, controls, traces)
    assert {(r.frame, r.rect.left, r.latest) for r in found.collect()} == {("f1", 1.0, False), ("f2", 2.0, False), ("f4", 4.0, True)}
    moves = spark.createDataFrame([("m1", [], ["s2"], "k", ["tap"], None), ("m2", ["s1"], [], "zz", [], "open"), ("m3", ["s9"], [], "k", [], "x")], "transition string, from_states array<string>, to_states array<string>, key string, operations array<string>, capability string")
    runs = spark.createDataFrame([("r1", "s1", "s2", "k", "tap", None, "1"), ("r2", "s1", "s2", "q", "tap", "x", "2"), ("r3", "s1", "s3", "q", "drag", "open", "0")], "trace string, from_state string, to_state string, key string, operation string, capability string, ended_at string")
    assert rows(evidence.matching_traces(moves, runs)) == [("m1", "r2"), ("m2", "r3"), ("m3", None)]


def test_bindings_preview_audit(spark):
    states = spark.createDataFrame([("a", "f1", "e"), ("b", "f9", "e"), ("c", "f1", "z"), ("d", "f2", "e")], "state string, frame string, element string")
    frames = spark.createDataFrame([("f1", "s1"), ("f2", "s2")], "frame string, screenshot string")
    locators = spark.createDataFrame([("e", "f1", "s1", 0.0, 0.0, 2.0, 2.0, 1.0, 2.0), ("e", "f2", "s2", 0.0, 0.0, 2.0, 2.0, 1.0, 3.0)], "element string, frame string, screenshot string, left double, top double, width double, height double, x double, y double")
    bound, errors = evidence.live_bindings(states, frames, locators)
    assert [r.state for r in bound.collect()] == ["a"] and {(r.rule, r.subject) for r in errors.collect()} == {("frame_missing", "b"), ("locator_missing", "c"), ("centre_outside", "d")}
    edges = spark.createDataFrame([("x", "e", "f1"), ("y", "e", "f7"), ("z", "q", "f1")], "edge string, element string, before_frame string")
    seen = spark.createDataFrame([("e", "f1", "1", 5), ("e", "f2", "2", 6), ("e", "f3", "3", None)], "element string, frame string, observed_at string, rect int")
    assert rows(evidence.preview(edges, seen)) == [("x", "f1", 5), ("y", "f2", 6), ("z", None, None)]
    one = evidence.audit(frames, frames.limit(1), frames.select(F.lit(True).alias("pending"))).first()
    assert (one.raw, one.qualified, one.rejected, one.outputs, one.pending) == (2, 1, 1, 2, 2)


def test_groups(spark):
    items = spark.createDataFrame([("i1", False, "2", "x"), ("i2", True, "9", "x"), ("i3", False, "1", "x"), ("i4", False, "1", "y")], "id string, is_primary boolean, observed_at string, look string")
    found = {r.representative: r.members for r in evidence.presentation_groups(items, ["look"]).collect()}
    assert found == {"i2": ["i2", "i3", "i1"], "i4": ["i4"]}
    groups = spark.createDataFrame([("g", ["i1", "i2"]), ("h", ["i2", "i9"])], "group string, members array<string>")
    assert {(r.rule, r.subject) for r in evidence.partition_errors(groups, items).collect()} == {("member_repeated", "i2"), ("member_missing", "i3"), ("member_missing", "i4"), ("member_unknown", "i9")}
    boxes = spark.createDataFrame([("s", "b", 0.5, 0.2), ("s", "a", 0.9, 0.4)], "session string, key string, y double, height double")
    assert rows(evidence.checkpoint_summary(boxes, ["session"])) == [("s", 1.0, 2, ("a", "b"))]
    values = spark.createDataFrame([(0.5, None, 0.2)], "a double, b double, c double")
    assert values.select(evidence.confidence("a", "b", "c")).first()[0] == 0.2


def test_views(spark):
    pages = spark.createDataFrame([("p1", "root", "消息-Root", ["消息"], 0), ("p2", "a.b.c", "消息-Chat-Deep", ["消息", "Chat"], 1), ("p3", "a.b", "消息-Chat", ["消息", "Chat"], 2), ("p4", "a.x.settings", "消息-Chat-Sound", ["消息", "Chat"], 3), ("p5", "dialog", "通用-Ask", ["通用"], 4), ("p6", "z", "Z", ["Z", None], 5)], "page string, key string, label string, path array<string>, pos int")
    bars = spark.createDataFrame([("nav.m", "消息", "root", 0), ("nav.more", "更多", None, 1)], "node string, label string, page_key string, pos int")
    edges = spark.createDataFrame([
        ("e1", "p1", "p3", "transition", "tap", None, 0), ("e2", "p1", "p3", "transition", "open_chat", None, 1), ("e3", "p3", "p2", "transition", "tap", "seen", 2), ("e4", "p4", "p2", "transition", "open_it", "seen", 3), ("e5", "p3", "p2", "transition", "open_it", None, 4),
        ("e6", "p3", "p2", "transition", "open_it", None, 5), ("e7", "p2", "p5", "transition", "open_it", "seen", 6), ("e8", "p2", "p2", "transition", "open_it", "seen", 7), ("e9", "p3", "p4", "authority_contract", "open_it", "seen", 8)], "edge string, source string, target string, kind string, capability string, preview string, pos int")
    nodes, links = views.layered_view(bars, pages, edges, "通用")
    assert {r.node: (r.kind, r.label, r.page, r.edge) for r in nodes.collect()} == {
        "nav.m": ("nav", "消息", "p1", None), "nav.more": ("nav", "更多", None, None), "feature.消息.Chat": ("feature", "Chat", "p3", "e2"), "page.a.b.c": ("page", "Deep", "p2", "e4"), "page.a.b": ("page", "Chat首页", "p3", "e2"),
        "page.a.x.settings": ("page", "Sound设置", "p4", None), "shared.dialog": ("shared", "Ask", "p5", "e7"),
    }
    assert {r.link: (r.source, r.target, r.kind, r.edge) for r in links.collect()} == {
        "view.entry.feature.消息.Chat": ("nav.m", "feature.消息.Chat", "navigation", "e2"), "view.default.feature.消息.Chat": ("feature.消息.Chat", "page.a.b", "relationship", "e2"),
        "view.relation.e4": ("page.a.x.settings", "page.a.b.c", "relationship", "e4"), "view.relation.e5": ("page.a.b", "page.a.b.c", "relationship", "e5"), "view.relation.e7": ("page.a.b.c", "shared.dialog", "relationship", "e7"),
    }
    moves = spark.createDataFrame([("p1", "p2", True), ("p2", "p1", False), ("p1", "p1", False)], "source string, target string, shared boolean")
    inside = spark.createDataFrame([("e", None, "p1"), ("f", "e", None), ("g", "f", "p2"), ("h", "gone", "p2")], "element string, parent string, page string")
    stats = views.page_statistics(pages.where("pos < 3"), inside, moves, keep)
    assert rows(stats.select("page", "owned", "inbound", "outbound", "shared")) == [("p1", 3, 2, 2, 1), ("p2", 0, 1, 1, 0), ("p3", 0, 0, 0, 0)]


def test_migration_and_editing(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "id long, key string")
    ledger = spark.createDataFrame([("a", "b"), ("b", None), ("z", "y"), ("c", "d")], "old_key string, new_key string")
    out, errors = views.migrate(records, ledger)
    assert rows(out.select("id", "key")) == [(1, "b"), (3, "d"), (4, "d")] and {(r.rule, r.subject) for r in errors.collect()} == {("ledger_target", "z"), ("ledger_target", "c"), ("key_repeated", "d")}
    boxes = spark.createDataFrame([("a", "r", 0.1, 0.1, 0.2, 0.2), ("b", "r", 0.5, 0.0, 0.1, 0.1), ("c", None, 0.0, 0.0, 1.0, 1.0)], "id string, parent string, x double, y double, width double, height double")
    found = {r.id: (r.parent, r.x, r.y) for r in views.group_selection(boxes, spark.createDataFrame([("a",), ("b",)], "id string"), "new").collect()}
    assert found == {"a": ("new", 0.1, 0.1), "b": ("new", 0.5, 0.0), "c": (None, 0.0, 0.0), "new": ("r", 0.1, 0.0)}
    frame = boxes.select(F.lit(1).alias("frame"), F.col("id").alias("element"), "x", "y", "width", "height")
    hits = views.hit_test(frame, spark.createDataFrame([(1, "p", 0.3, 0.3), (1, "q", 0.35, 0.3)], "frame int, point string, px double, py double"))
    assert rows(hits) == [("p", "a", 1), ("p", "c", 2), ("q", "c", 1)]
    clicks = spark.createDataFrame([(1, "p", 0.3, 0.3, None), (1, "q", 0.3, 0.3, "a"), (1, "r", 0.3, 0.3, "c"), (1, "s", 0.3, 0.3, "b"), (1, "t", 9.0, 9.0, None)], "frame int, point string, px double, py double, selected string")
    assert rows(views.clicked(frame, clicks)) == [("p", "a"), ("q", "c"), ("r", "a"), ("s", "a")]
