import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.operators import constraints as K
from lattika.operators import graph, merging, selection
from lattika.operators.components import connected_components
from lattika.operators import rounds
from lattika.operators.matching import compare_boxes, comparison, ground
from lattika.operators.rounds import keep


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=str)


def test_constraints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "w")], "id long, v string")
    assert rows(K.duplicates(a.where("id IS NOT NULL"), "id")) == [(2, 2)]
    assert rows(K.dangling(a, "id", spark.createDataFrame([(1,)], "k long"), "k")) == [(2, "y"), (2, "z"), (None, "w")]
    refs = spark.createDataFrame([("p", ["a", "b"]), ("q", [])], "key string, refs array<string>")
    assert rows(K.dangling_elements(refs, "key", "refs", spark.createDataFrame([("a",)], "k string"), "k")) == [("p", "b")]
    assert rows(K.set_difference(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), "k")) == [(1, "left"), (3, "right")]
    assert rows(K.overlap([spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")], "k")) == [(2, 2)]
    assert rows(K.not_reciprocal(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))) == [(2, 3, "right")]


def parents(n=200, seed=1):
    rnd = random.Random(seed)
    return {i: None if rnd.random() < 0.1 else rnd.randrange(n + 5) for i in range(n)}


def test_terminal_owner(spark):
    of = parents() | {500 + i: 499 + i for i in range(1, 60)} | {500: None}
    want = []
    for i in of:
        at, seen, hops = i, {i}, 0
        state = None
        while state is None:
            if at not in of:
                state = "missing"
            elif of[at] is None:
                state = "root"
            elif of[at] in seen:
                state = "cycle"
            else:
                at, hops = of[at], hops + 1
                seen.add(at)
        want.append((i, None, None, state) if state == "cycle" else (i, at, hops, state))
    nodes = spark.createDataFrame(list(of.items()), "node long, parent long")
    assert rows(graph.terminal_owner(nodes, keep)) == sorted(want, key=str)
    assert rows(graph.leads_to_cycle(nodes, keep)) == sorted([(w[0],) for w in want if w[3] == "cycle"], key=str)


def test_graph_walks(spark):
    rnd = random.Random(2)
    pairs = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)})
    edges = spark.createDataFrame(pairs, "a long, b long")
    reach = {n: set() for p in pairs for n in p}
    for _ in range(50):
        for a, b in pairs:
            reach[a] |= {b} | reach[b]
    assert rows(graph.closure(edges, keep)) == sorted([(a, b) for a in reach for b in reach[a]], key=str)
    assert {r[0] for r in rows(graph.on_cycles(edges, keep))} == {n for n in reach if n in reach[n]}
    label = {n: n for n in reach}
    for _ in range(50):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert rows(connected_components(edges, "a", "b", keep)) == sorted([(n, c) for n, c in label.items() if any(n in p and p[0] != p[1] for p in pairs)], key=str)
    start = pairs[0][0]
    depth = {start: 0}
    for _ in range(50):
        for a, b in pairs + [(b, a) for a, b in pairs]:
            if a in depth:
                depth[b] = min(depth.get(b, 99), depth[a] + 1)
    beyond = max(depth.values()) + 1
    assert rows(graph.depths(edges, spark.createDataFrame([(start,)], "node long"), keep)) == sorted([(n, depth.get(n, beyond)) for n in reach], key=str)
    assert rows(graph.orphans(spark.createDataFrame([(1000,), (start,)], "node long"), edges)) == [(1000,)]


def test_cycles_alone_lie_on_cycles(spark):
    """Not what lies between two of them; where nodes have one way out, or one way in, rounds double."""
    ways = {"between": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 9), (9, 1)], "pointers": [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 8)], "parents": [(2, 1), (3, 2), (1, 3), (1, 4), (4, 5), (8, 7)], "none": [(1, 2), (2, 3)]}
    want = {"between": {1, 2, 4, 5, 9}, "pointers": {1, 2, 3, 6}, "parents": {1, 2, 3}, "none": set()}
    for name, pairs in ways.items():
        for cast in ("long", "string"):
            edges = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast(cast).alias("a"), F.col("b").cast(cast).alias("b"))
            assert {int(r[0]) for r in rows(graph.on_cycles(edges, keep))} == want[name], name


def test_components_of_texts(spark):
    edges = spark.createDataFrame([("page:b", "page:a"), ("page:c", "page:b"), ("x", "y"), ("z", None)], "a string, b string")
    assert rows(connected_components(edges, "a", "b", keep)) == [("page:a", "page:a"), ("page:b", "page:a"), ("page:c", "page:a"), ("x", "x"), ("y", "x")]


def test_kept_tables_are_dropped_and_no_others(spark, tmp_path):
    df = spark.range(3)
    kept = keep(df, "some")
    df.write.parquet(f"file://{tmp_path}/own")
    own = spark.read.parquet(f"file://{tmp_path}/own")
    rounds.drop(kept, own)
    assert own.count() == 3
    with pytest.raises(Exception):
        kept.count()


def test_depths_have_floors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    found = graph.depths(edges, spark.createDataFrame([(1,)], "node long"), keep, spark.createDataFrame([(2, 2), (3, 1)], "node long, least int"))
    assert rows(found) == [(1, 0), (2, 2), (3, 2)]


def test_availability_variants(spark):
    data = [("root", None, "application", None, ["p1", "p2"]), ("kid", "root", "component", "p3", []), ("lone", None, "page", "p4", ["p9"])]
    elements = spark.createDataFrame(data, "element string, parent string, owner_kind string, page string, pages array<string>")
    of = {v: set(rows(graph.availability(elements, keep, v))) for v in ("ancestors", "application", "draft")}
    base = {("root", "p1"), ("root", "p2"), ("kid", "p1"), ("kid", "p2")}
    assert of["application"] == base and of["draft"] == base | {("kid", "p3"), ("lone", "p4")} and of["ancestors"] == of["draft"] | {("lone", "p9")}


def walked(rows):
    """node -> (tree, place, depth, visible parent), by recursion without a stack of calls."""
    known, children, out = {r[0] for r in rows}, {}, []
    for node, parent, pos, visible in sorted(rows, key=lambda r: (r[2], r[0])):
        children.setdefault(parent if parent in known else None, []).append((node, visible))
    for root, visible in children.get(None, []):
        stack, n = [(root, visible, 0, None)], 0
        while stack:
            node, visible, depth, above = stack.pop()
            if visible:
                n += 1
                out.append((node, root, n, depth, above))
            stack += [(c, v, depth + 1, node if visible else above) for c, v in reversed(children.get(node, []))]
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", ["bushy", "chain", "hidden chain"])
def test_preorder_with_hidden_nodes(spark, shape):
    rnd = random.Random(7)
    n = 400 if shape == "bushy" else 3_000
    up = {i: (None if rnd.random() < 0.01 else rnd.randrange(max(1, i)) if i else None) if shape == "bushy" else i - 1 if i else None for i in range(n)}
    rows_ = [(i, up[i], rnd.randrange(5), rnd.random() < (0.5 if shape == "bushy" else 0.9 if shape == "chain" else 0.0) or i in (0, n - 1)) for i in range(n)]
    rows_ += [(9_000, 9_001, 0, True), (9_001, 9_002, 0, True), (9_002, 9_001, 0, True), (9_010, 77_777, 0, True)]  # below a cycle, on it, without a known parent
    found = graph.preorder(spark.createDataFrame(rows_, "node long, parent long, pos long, visible boolean"), keep)
    assert rows(found.select("node", "tree", "place", "depth", "parent")) == walked(rows_)


def test_flatten_tree(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "a", 0), ("d", "c", 0), ("e", "gone", 1), ("x", "y", 0), ("y", "x", 0)], "node string, parent string, pos int")
    found = graph.flatten_tree(nodes, keep).orderBy("place").collect()
    assert [(r.node, r.depth) for r in found] == [("a", 0), ("c", 1), ("d", 2), ("b", 1), ("e", 0)]


def test_selection(spark):
    rnd = random.Random(3)
    events = [(rnd.randrange(4), rnd.randrange(30), i, rnd.choice("pe")) for i in range(120)]
    df = spark.createDataFrame(events, "u long, t long, id long, kind string")
    p, e = df.where("kind = 'p'").select("u", "t", F.col("id").alias("pid")), df.where("kind = 'e'").select("u", "t", F.col("id").alias("eid"))
    want = []
    for u, t, i, k in events:
        if k == "p":
            best = min(((abs(t - t2), j) for u2, t2, j, k2 in events if u2 == u and k2 == "e"), default=(None, None))
            want.append((u, i, best[1], best[0]))
    assert rows(selection.nearest_pairs(p, e, ["u"], "t", "t", "pid", "eid")) == sorted([(u, i, j, float(g) if g is not None else None) for u, i, j, g in want], key=str)
    status = spark.createDataFrame([(1, "pass"), (1, "unknown"), (2, "pass"), (3, "odd")], "k int, s string")
    assert rows(selection.status_lattice(status, ["k"], "s", ["fail", "unknown", "pass"])) == [(1, "unknown"), (2, "pass"), (3, None)]
    keyed = spark.createDataFrame([("a", 2), ("a", 1), ("", 0), (None, 5)], "k string, pos int")
    assert rows(selection.keep_first(keyed, "k", "pos")) == [("a", 1)]
    targets = spark.createDataFrame([("t", ["a.c", "zz"])], "target string, patterns array<string>")
    values = spark.createDataFrame([(1, "abc"), (2, "a.c"), (3, "abcd"), (4, "zz")], "id int, v string")
    assert rows(selection.pattern_matches(targets, values, "v").select("target", "id")) == [("t", 1), ("t", 2), ("t", 4)]


@pytest.mark.parametrize("size", [4_096, 2])
def test_each_pattern_is_matched_by_itself(spark, monkeypatch, size):
    """Groups and references are those of one pattern; what is no expression matches its own text and disturbs no other."""
    monkeypatch.setattr(selection, "PATTERNS", size)
    targets = spark.createDataFrame([("t", ["(a)b", r"(c)\1", "[", "x|yz"]), ("u", ["(?i)AB", "("]), ("none", []), ("null", None)], "target string, patterns array<string>")
    values = spark.createDataFrame([("ab",), ("cc",), ("ca",), ("[",), ("x",), ("yz",), ("xyz",), ("(",), (None,), ("ab",)], "v string")
    assert rows(selection.pattern_matches(targets, values, "v").select("target", "v")) == sorted([("t", v) for v in ("ab", "ab", "cc", "[", "x", "yz")] + [("u", v) for v in ("ab", "ab", "(")], key=str)


def merged_one_by_one(existing, proposed, page, new_page):
    """What the rules say, row by row. existing: id, key, pos, label, source, review, owner_kind, page, available, edited."""
    at, shared = new_page or page, ("application", "shared_component")
    by_key = {r[1]: r for r in sorted(existing, key=lambda r: r[2]) if r[7] == page or r[6] in shared}
    out, used = [], set()
    for key, label in proposed:
        r = by_key.get(key)
        if r is None:
            out.append((None, key, label, "ai", "pending", "page", at, (), None))
            continue
        used.add(r[0])
        protected = r[5] == "accepted" or r[9] or r[4] == "human"
        keeps = r[6] in shared or protected
        listed = tuple(dict.fromkeys([*(r[8] or ()), at])) if r[6] == "application" else tuple(r[8] or ())
        out.append((r[0], key, r[3] if keeps else label, r[4] if keeps else "ai", r[5], r[6], r[7] if keeps else at, listed, label if protected else None))
    for r in existing:
        if r[0] not in used and (r[6] in shared or new_page or r[7] != page):
            out.append((r[0], r[1], r[3], r[4], r[5], r[6], r[7], tuple(r[8] or ()), None))
    return sorted(out, key=str)


@pytest.mark.parametrize("new_page", [None, "p9"])
def test_candidates_are_merged_by_the_rules(spark, new_page):
    rnd = random.Random(5)
    existing = [(f"i{i}", f"k{rnd.randrange(40)}", i, f"old{i}", rnd.choice(["ai", "human", "import"]), rnd.choice(["pending", "accepted", "edited"]), rnd.choice(["page", "page", "application", "shared_component", "component"]), rnd.choice(["p1", "p1", "p2", None]), rnd.choice([None, ["p1"], ["p3"]]), rnd.random() < 0.2) for i in range(120)]
    proposed = [(f"k{i}", f"new{i}") for i in range(0, 60, 2)]
    df = spark.createDataFrame(existing, "id string, key string, pos long, label string, source string, review string, owner_kind string, page string, available array<string>, edited boolean")
    found = merging.merge_candidates(df, spark.createDataFrame(proposed, "key string, label string"), ["label"], "p1", new_page)
    known = {r[0] for r in existing}
    got = sorted(((r.id if r.id in known else None, r.key, r.label, r.source, r.review, r.owner_kind, r.page, tuple(r.available), r.proposal and r.proposal.label) for r in found.collect()), key=str)
    assert got == merged_one_by_one(existing, proposed, "p1", new_page)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", None)], "id long, v string, w string")
    new = spark.createDataFrame([(2, "", "n"), (3, "c", "m")], "id long, v string, w string")
    assert rows(merging.upsert(old, new, "id", {"v": F.col("v") == ""})) == [(1, "a", "k"), (2, "b", "n"), (3, "c", "m")]
    assert rows(merging.insert_absent(old, new, "id", ["w"])) == [(1, "a", "k"), (2, "b", "n"), (3, "c", "m")]
    assert rows(merging.replace_partition(old, new, "id")) == [(1, "a", "k"), (2, "", "n"), (3, "c", "m")]
    a = spark.createDataFrame([("k", "A", None), ("m", "A2", "x")], "key string, p string, q string")
    b = spark.createDataFrame([("k", "B", "Q"), ("n", "B2", "y")], "key string, p string, q string")
    choices = spark.createDataFrame([(1, "k", "k", {"p": "b", "q": "a"}), (2, "k", None, {"p": "a", "q": "a"}), (3, None, "n", {"p": "a", "q": "b"})], "pos int, a_key string, b_key string, sources map<string,string>")
    assert rows(merging.merge_fields(choices, a, b, ["p", "q"]).select("pos", "key", "p", "q")) == [(1, "k", "B", "Q"), (2, "k-2", "A", None), (3, "n", "B2", "y")]
    names = spark.createDataFrame([("x", "X"), ("y", "Y")], "old string, new string")
    assert rows(merging.remap(spark.createDataFrame([("x", "y"), ("x", "z")], "s string, t string"), names, "s", "t").select("s", "t")) == [("X", "Y")]


def test_remove_pages(spark):
    pages = spark.createDataFrame([("p1",), ("p2",)], "page string")
    elements = spark.createDataFrame([("e1", "p1", ["p1"]), ("e2", "p2", ["p9", "p1", "p2", "p9"]), ("e3", "p2", None)], "element string, page string, available array<string>")
    moves = spark.createDataFrame([("t1", "p1", "p2", "e1"), ("t2", "p2", "p2", "e2"), ("t3", "p2", "p2", "e1")], "id string, source string, target string, trigger string")
    kept, left, stay = merging.remove_pages(pages, elements, moves, spark.createDataFrame([("p1",)], "page string"))
    assert rows(kept) == [("p2",)] and [(r.element, r.available) for r in left.orderBy("element").collect()] == [("e2", ["p9", "p2", "p9"]), ("e3", None)] and [r.id for r in stay.collect()] == ["t2"]
    before, after = (merging.page_signatures(p, elements, moves).where("page = 'p2'").first().signature for p in (pages, pages.where("true")))
    assert before == after != merging.page_signatures(pages, elements, moves.where("id = 't2'")).where("page = 'p2'").first().signature


def test_matching(spark):
    schema = "frame long, key string, pos long, x double, y double, width double, height double"
    a = spark.createDataFrame([(1, "k", 0, 0.0, 0.0, 0.1, 0.1), (1, "m", 1, 0.5, 0.5, 0.2, 0.2), (1, "z", 2, 0.9, 0.9, 0.01, 0.01), (2, "q", 0, 0.0, 0.0, 0.1, 0.1)], schema)
    b = spark.createDataFrame([(1, "k", 0, 0.9, 0.0, 0.1, 0.1), (1, "n", 1, 0.5, 0.5, 0.2, 0.19), (1, "o", 2, 0.51, 0.5, 0.2, 0.2), (3, "r", 0, 0.0, 0.0, 0.1, 0.1)], schema)
    assert rows(compare_boxes(a, b, "frame", keep)) == sorted([(1, "k", "k", "key"), (1, "m", "n", "place"), (1, "z", None, "left"), (1, None, "o", "right"), (2, "q", None, "left"), (3, None, "r", "right")], key=str)
    a = a.withColumn("label", F.col("key")).unionByName(spark.createDataFrame([(5, "k", 0, *[0.1] * 4, "first"), (5, "k", 1, *[0.1] * 4, "last")], schema + ", label string"))
    b = b.withColumn("label", F.lit("k")).unionByName(spark.createDataFrame([(5, "k", 0, *[0.1] * 4, "first"), (5, "k", 1, *[0.1] * 4, "last")], schema + ", label string"))
    found = {(r.frame, r.left_key, r.right_key): (r.status, r.changed) for r in comparison(a, b, "frame", ["label", "width"], keep).collect()}
    assert found == {(1, "k", "k"): ("same", []), (1, "m", "n"): ("changed", ["label"]), (1, "z", None): ("left-only", []), (1, None, "o"): ("right-only", []), (2, "q", None): ("left-only", []), (3, None, "r"): ("right-only", []), (5, "k", "k"): ("same", [])}


def chosen_one_after_the_other(a, b):
    """What the loop over one frame gives: a and b as (key, x, y, width, height) in order."""
    keys_a, by_key, used, out = {r[0] for r in a}, {r[0]: i for i, r in enumerate(b)}, set(), []
    boxes = np.array([r[1:] for r in b], float).reshape(-1, 4)
    free = np.array([r[0] not in keys_a for r in b], bool)
    for key, x, y, w, h in a:
        if key in by_key:
            out.append((key, key, "key"))
            used.add(by_key[key])
            continue
        wide = np.maximum(0, np.minimum(x + w, boxes[:, 0] + boxes[:, 2]) - np.maximum(x, boxes[:, 0]))
        high = np.maximum(0, np.minimum(y + h, boxes[:, 1] + boxes[:, 3]) - np.maximum(y, boxes[:, 1]))
        shared = wide * high / (w * h + boxes[:, 2] * boxes[:, 3] - wide * high)
        apart = np.hypot(x + w / 2 - boxes[:, 0] - boxes[:, 2] / 2, y + h / 2 - boxes[:, 1] - boxes[:, 3] / 2)
        score = np.where(free, np.where(shared >= 0.2, shared + 1, np.where(apart <= 0.06, 0.5 - apart, -1)), -1)
        best = int(score.argmax()) if len(score) else -1
        if best >= 0 and score[best] >= 0:
            free[best] = False
            used.add(best)
            out.append((key, b[best][0], "place"))
        else:
            out.append((key, None, "left"))
    return out + [(None, r[0], "right") for i, r in enumerate(b) if i not in used]


@pytest.mark.parametrize("sizes", [[0, 1, 3, 20, 60, 200], [10_000]])
def test_boxes_match_as_one_after_the_other(spark, sizes):
    """Boxes of very different sizes, with ties; and one large frame, which no task gets as a whole."""
    rng = np.random.default_rng(len(sizes))
    left, right, want = [], [], []
    for f, n in enumerate(sizes):
        sides = []
        for side, held in ((left, "a"), (right, "b")):
            size = rng.choice([0.01, 0.02, 0.05, 0.3, 1.5] if n <= 200 else [0.005, 0.01, 0.02], (n, 2))
            at = np.round(rng.uniform(0, 1, (n, 2)), 2) if n <= 200 else rng.uniform(0, 10, (n, 2))  # with ties, without
            rows_ = [(f"{held if rng.random() < 0.8 else 'k'}{i}", *map(float, (*at[i], *size[i]))) for i in range(n)]
            side += [(f, r[0], i, *r[1:]) for i, r in enumerate(rows_)]
            sides.append(rows_)
        want += [(f, *x) for x in chosen_one_after_the_other(*sides)]
    schema = "frame long, key string, pos long, x double, y double, width double, height double"
    found = compare_boxes(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "frame", keep)
    assert rows(found) == sorted(want, key=str) and sum(w[3] == "place" for w in want) > 10


def grounded_one_after_the_other(controls, nodes):
    """The loop over one frame; controls: key, resources, texts, container, widget, group, y; nodes: node, resource, text, description, class, y."""
    free, out, anchors = dict.fromkeys(nodes), {}, {}
    for how in ("resource", "text", "nearest"):
        late = {}
        for c in controls:
            key, resources, texts, container, widget, group, y = c
            if key in out:
                continue
            if how == "nearest":
                hits = sorted((n for n in free if widget and re.search(widget, n[4])), key=lambda n: (abs(n[5] - anchors.get(group, y)), n[0]))
            else:
                hits = [n for n in free if (n[1] and n[1] in resources if how == "resource" else not container and any(t and t in n[2:4] for t in texts))]
                hits = hits if len(hits) == 1 else []
            if hits:
                out[key] = (hits[0][0], how)
                free.pop(hits[0])
                if group is not None and how != "nearest":
                    late[group] = hits[0][5]
        anchors |= late
    return [(k, *v) for k, v in out.items()]


def test_grounding_as_one_after_the_other(spark):
    rnd = random.Random(6)
    controls, nodes, want = [], [], []
    for f in range(25):
        n = rnd.choice([0, 2, 8, 25])
        a = [(f"c{i}", rnd.sample("pqrstu", rnd.choice([0, 1, 1, 2])), rnd.sample("vwxyz", rnd.choice([0, 1, 2])), rnd.random() < 0.2, rnd.choice([None, "Button|Image", "(?i)edit"]), rnd.choice([None, "g1", "g2"]), float(rnd.randint(0, 30))) for i in range(n)]
        b = [(i, rnd.choice(["", "p", "q", "r", "s", "t", "u"]), rnd.choice(["", *"vwxyz"]), rnd.choice(["", "", *"vw"]), rnd.choice(["Button", "ImageButton", "EditText", "View"]), float(rnd.randint(0, 30))) for i in range(rnd.choice([0, 5, 30]))]
        controls += [(f, r[0], i, *r[1:]) for i, r in enumerate(a)]
        nodes += [(f, *r) for r in b]
        want += [(f, *x) for x in grounded_one_after_the_other(a, b)]
    a = spark.createDataFrame(controls, "frame long, key string, pos long, resources array<string>, texts array<string>, container boolean, widget string, group string, y double")
    b = spark.createDataFrame(nodes, "frame long, node long, resource string, text string, description string, class string, y double")
    assert rows(ground(a, b, "frame", keep)) == sorted(want, key=str) and {w[3] for w in want} == {"resource", "text", "nearest"}


@pytest.mark.parametrize("name", ["q_greedy_match"])
def test_greedy_is_one_to_one(spark, name):
    from lattika.plans.catalogue import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001").where("right_key IS NOT NULL").groupBy("frame", "right_key").count()
    assert found.where("count > 1").isEmpty() and not found.isEmpty()


def test_many_rounds_are_put_together(spark, monkeypatch, tmp_path):
    """However many rounds, few folders are read side by side, and none of the older ones stays."""
    monkeypatch.setattr(rounds, "FOLDERS", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    made = []
    found = graph.depths(edges, spark.createDataFrame([(0,)], "node long"), lambda df, label: (made.append(keep(df, label)), made[-1])[1])
    assert rows(found) == sorted([(i, i) for i in range(13)], key=str)
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= 5
