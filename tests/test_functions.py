import decimal
import hashlib
import json
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from lattika.functions import geometry as G
from lattika.functions import identity, lenient, nested, text
from lattika.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "box, most, want",
    [
        ((0.1, 0.2, 0.2, 0.1), (12, 12), (3, 6, None)),
        ((0.41, 0.26, 0.1, 0.1), (4, 3), (3, 2, 2)),
        ((0.4, 0.4, 0.1, 0.1), (4, 4), (3, 3, 5)),
        ((0.0, 0.2, 0.02, 0.1), (12, 12), (12, 6, 13)),
        ((0.1, 0.2, 0.8, 0.2), (12, 12), (1, 2, 1)),
    ],
)
def test_grid(spark, box, most, want):
    g = one(spark, G.grid_for_box(*map(F.lit, box), *map(F.lit, most)))
    assert (g.columns, g.rows) == want[:2] and want[2] in (None, g.region)


def test_grid_counts(spark):
    counts = [one(spark, G.grid_count(F.lit(v).cast("double"))) for v in (None, float("nan"), 0.0, 2.5, 99.0)]
    assert counts == [1, 1, 1, 3, 12]


def test_boxes(spark):
    lit = lambda *v: tuple(map(F.lit, v))
    a, b = lit(0.0, 0.0, 0.5, 0.5), lit(0.25, 0.25, 0.5, 0.5)
    assert one(spark, G.iou(a, b)) == pytest.approx(0.0625 / 0.4375)
    assert one(spark, G.iou(lit(0.0, 0.0, 0.0, 0.0), lit(0.0, 0.0, 0.0, 0.0))) == 0
    assert one(spark, G.boxes_intersect(a, b)) and not one(spark, G.boxes_intersect(a, lit(0.5, 0.0, 0.1, 0.1)))
    assert one(spark, G.match_score(a, lit(0.9, 0.9, 0.05, 0.05))) is None
    assert one(spark, G.match_score(lit(0.0, 0.0, 0.01, 0.01), lit(0.03, 0.0, 0.01, 0.01))) == pytest.approx(0.47)
    assert tuple(one(spark, G.clamp_unit_box(*lit(-1.0, 0.9999999, 3.0, 0.5)))) == (0.0, 0.999, 1.0, 0.001)
    assert tuple(one(spark, G.clamp_box(*lit(0.95, -0.1, 0.2, 0.001)))) == (0.8, 0.0, 0.2, 0.01)
    assert one(spark, G.closed_contains(*lit(0.0, 0.0, 1.0, 1.0, 1.0, 1.0))) and not one(spark, G.half_open_contains(*lit(0.0, 0.0, 1.0, 1.0, 1.0, 1.0)))
    bounds = G.parse_bounds(F.lit("[592,205][848,291]"))
    assert tuple(one(spark, bounds)) == (592, 205, 848, 291)
    assert one(spark, G.parse_bounds(F.lit("[5,5][5,9]"))) is None and one(spark, G.parse_bounds(F.lit("x"))) is None
    unit = one(spark, G.normalized_bounds(bounds, F.lit(1440), F.lit(3168)))
    assert unit.x == 592 / 1440 and unit.height == pytest.approx(86 / 3168)


def test_matrices(spark):
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 3, 0, 0, 0, 1)])
    assert tuple(one(spark, G.project_point(m, F.lit(1.0), F.lit(2.0)))) == (3.0, 6.0)
    back = one(spark, G.project_point(G.inverse(m), F.lit(3.0), F.lit(6.0)))
    assert (back.x, back.y) == (pytest.approx(1), pytest.approx(2))
    assert one(spark, G.inverse(F.array(*[F.lit(0.0)] * 9))) is None


def test_texts(spark):
    df = spark.createDataFrame([("Ｓettings & Ｍore",), ("设置",)], "name string")
    keys = [r[0] for r in df.select(text.page_key(F.col("name"))).collect()]
    assert keys == ["page.settings-more", "page." + hashlib.sha256("设置".encode()).hexdigest()[:12]]
    assert one(spark, text.next_version(F.lit("shop@1.2.9"))) == "shop@1.2.10" and one(spark, text.next_version(F.lit("shop"))) == "shop@1.0.0"
    assert one(spark, text.capabilities(F.array(*map(F.lit, (" tap", "tap", "none", "fly"))), ["tap", "swipe"])) == ["tap"]
    assert one(spark, text.capabilities(F.array().cast("array<string>"), ["tap"])) == ["none"]
    assert one(spark, text.alias_of(F.lit("Icon"), {"icon": "image"}, ["image"])) == "image" and one(spark, text.alias_of(F.lit("zzz"), {}, ["image"])) == ""
    assert tuple(one(spark, text.repeat_parts(F.lit("list-2_title.x")))) == ("list", 2, "title.x") and one(spark, text.repeat_parts(F.lit("plain"))) is None
    assert one(spark, text.safe_segment(F.lit(" a/b c "))) == "a-b-c" and one(spark, text.safe_segment(F.lit("//"))) == "unknown"
    assert one(spark, text.matches(F.lit("row.12"), F.lit(r"row\.\d+"))) and not one(spark, text.matches(F.lit("xrow.12"), F.lit(r"row\.\d+")))
    assert one(spark, text.utc_time(F.lit("2026-01-02T03:04:05Z"))) is not None and one(spark, text.utc_time(F.lit("2026-01-02"))) is None
    assert one(spark, text.stable_differs(F.lit(None).cast("string"), F.lit(""))) is False
    lists = [F.array(*map(F.lit, v)) for v in ("ab", "ba")]
    assert one(spark, text.stable_differs(*lists)) and not one(spark, text.stable_differs(*lists, as_sets=True)) and one(spark, text.stable_differs(F.struct(F.lit(1).alias("a")), F.struct(F.lit(2).alias("a"))))
    assert not one(spark, text.stable_differs(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")))
    effects = one(spark, text.action_effects(F.array(*map(F.lit, ("tap", "drag", "fly"))), F.array(F.struct(F.lit("drag").alias("action"), F.lit("moves").alias("effect")), F.struct(F.lit("tap").alias("action"), F.lit("").alias("effect"))), F.lit("card")))
    assert [(e.action, e.effect) for e in effects] == [("tap", "点击 card 触发对应操作"), ("drag", "moves"), ("fly", "点击 card 触发对应操作")]


def test_identity(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": [2, {"d": null, "c": "é"}]}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(identity.canonical_json("j")).collect()] == ['{"a":[2,{"c":"é","d":null}],"b":1}', None, None]
    ids = [one(spark, identity.short_id(F.lit(v))) for v in ("x", "x", "y")]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 26 and set(i) <= set(identity.DIGITS) for i in ids)


def test_nested(spark):
    doc = json.dumps({"a": {"b": "x", "n": 3}, "s": "unknown", "l": [1, {"token-file": "z"}]})
    assert one(spark, nested.at_path(F.lit(doc), "a.n", "bigint")) == 3 and one(spark, nested.at_path(F.lit("{"), "a")) is None
    ask = lambda *c: one(spark, nested.satisfies(F.lit(doc), list(c)))
    assert ask(("a.b", "eq", "x")) and ask(("a.b", "ne", "y")) and not ask(("a.z", "ne", "y")) and not ask(("s", "eq", "unknown")) and not ask(("a.b", "gt", "x"))
    df = spark.createDataFrame([(1, doc), (2, "{"), (3, None)], "id long, j string")
    found = {(r.id, r.path): (r.kind, r.value) for r in nested.walk(df, "id", "j").collect()}
    assert found[1, "$.l[1].token-file"] == ("string", "z") and found[2, "$"][0] == "invalid" and found[1, "$.a.n"] == ("number", "3")
    assert [r.path for r in nested.forbidden(df, "id", "j", ["token"]).collect()] == ["$.l[1].token-file"]


@pytest.mark.parametrize(
    "given, want",
    [('```json\n{"a": 1}\n```', {"a": 1}), ('text {"a": [1, 2,], } tail', {"a": [1, 2]}), ('{"a": {"b": "cut', {"a": {"b": "cut"}}), ("none", None), (None, None), ('{"a": "x\\"y"} {"b": 2}', {"a": 'x"y'})],
)
def test_repair(given, want):
    found = nested.repair(given)
    assert (None if found is None else json.loads(found)) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("{'a': 'it is', b: True, c: None, d: undefined}", {"a": "it is", "b": True, "c": None, "d": None}),
        ('{"a": 1 "b": 2, "c": [1 2 "x" "y"], "d": "z" e: 3}', {"a": 1, "b": 2, "c": [1, 2, "x", "y"], "d": "z", "e": 3}),
        ('{"a": /* no, { */ 1, // "b": 3\n "c": 2,, }', {"a": 1, "c": 2}),
        ('{"a": [1, {"b": "cut \\u00', {"a": [1, {"b": "cut "}]}),
        ('{"a": [{"b": [1, 2}, 3]}', {"a": [{"b": [1, 2]}, 3]}),
        ('{"a": {"b": 1], "c": 2}', {"a": {"b": 1, "c": 2}}),
        ('{"a": "one" + \'two\', "b": -.5, "c": +2., "d": 1e, "e": -}', {"a": "onetwo", "b": -0.5, "c": 2.0, "d": 1.0, "e": 0}),
        ('{"a": "say "hi" now", "b": "x\ny"}', {"a": 'say "hi" now', "b": "x\ny"}),
        ('{"a": , "b": 1, "c"}', {"a": None, "b": 1, "c": None}),
        ("{“a”: “ü”, `b`: [1, ..., 9], k-1: some words here}", {"a": "ü", "b": [1, 9], "k-1": "some words here"}),
        ('{"u": "\\ud83d\\ude00 \\q"', {"u": "\U0001f600 q"}),
        ('{"n": NaN}', {"n": "NaN"}),
        ("{", {}),
        ("[1]", None),
    ],
)
def test_lenient_reading(given, want):
    found = nested.repair(given)
    assert (None if found is None else json.loads(found)) == want


def test_lenient_reading_of_cut_and_deep_texts():
    """Whatever is cut off, what was whole before stays; strict JSON reads as itself; depth needs no stack of calls."""
    doc = {"page": {"name": "a, \"b\" {c}"}, "elements": [{"key": f"k{i}", "n": [i, -1.5e-3, True, None, {"x": "\u00e9\n"}]} for i in range(6)]}
    text = json.dumps(doc)
    assert lenient.read_object(text) == doc and lenient.read_object(json.dumps(doc, indent=2, ensure_ascii=False)) == doc
    for end in range(1, len(text)):
        found = lenient.read_object(text[:end])
        whole = found.get("elements") or []
        assert whole[:-1] == doc["elements"][: max(0, len(whole) - 1)]
    deep = lenient.read_object('{"a":' * 50_000)
    assert set(deep) == {"a"} and nested.repair('{"a":' * 50_000) is None
    assert lenient.read_object('{"a": "' + "x" * 2_000_000) == {"a": "x" * 2_000_000}
    assert lenient.checkpoint_part("<data-json>{1}</data-json> <data-json>{2}</data-json> rest") == "{2}" and lenient.checkpoint_part("{3}") == "{3}"


def test_ecmascript_numbers():
    """Against the rules of ECMAScript for digits s, their number k and the place n of the point, on random doubles."""
    cases = {1e-7: "1e-7", 1e-5: "0.00001", 1e-6: "0.000001", 1.5e300: "1.5e+300", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", -0.0: "0", 0.1: "0.1", -2.50: "-2.5", 5e-324: "5e-324", 100.0: "100"}
    assert {x: identity.ecmascript_number(x) for x in cases} == cases
    rnd = random.Random(1)
    for _ in range(10_000):
        x = struct.unpack("d", rnd.randbytes(8))[0] if rnd.random() < 0.5 else rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-9, 24)
        if not math.isfinite(x):
            continue
        text = identity.ecmascript_number(x)
        digits, exponent = f"{abs(decimal.Decimal(repr(x)).normalize()):e}".replace("E", "e").split("e")
        k, n = len(digits.replace(".", "")), int(exponent) + 1
        assert float(text) == x and ("e" in text) == (not -6 < n <= 21) and len(re.sub("e.*|[.-]", "", text).strip("0")) <= k
        assert re.fullmatch(r"-?(0|[1-9]\d{0,20}|(0|[1-9]\d*)\.\d*[1-9]|\d(\.\d*[1-9])?e[+-][1-9]\d*)", text)
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError):
            identity.ecmascript_number(bad)


def test_canonical_json(spark):
    texts = ['{"b": 1e-7, "a": [1.0, 0.00001, 1E400]}', '{"a": NaN}', '{"é": 12345678901234567890123, "a": {"z": -0.0, "y": true}}', "no", None, "[" * 100_000]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(identity.canonical_json(F.col("t"))).collect()]
    assert found == [None, None, '{"a":{"y":true,"z":0},"é":12345678901234567890123}', None, None, None]


def test_patterns_that_are_none(spark):
    rows = [("FOO.*r", "a foobar", True), ("a(", "x A( y", True), ("a(", "b", False), ("[", None, None), (None, "x", None)]
    found = spark.createDataFrame([r[:2] for r in rows], "p string, t string").select(T.pattern_found(F.col("p"), F.col("t")).alias("x")).collect()
    assert [r.x for r in found] == [r[2] for r in rows]


def test_small_texts_and_rects(spark):
    one = spark.createDataFrame([({"x": 1.0, "top": 2.0, "width": 3.0, "height": 4.0}, {"x": 1.0, "width": 3.0, "height": 4.0}, ["none"], ["tap"])], "a map<string,double>, b map<string,double>, c array<string>, d array<string>")
    ts = lambda v: F.lit(v).cast("timestamp")
    r = one.select(
        G.normalized_rect(F.col("a")).alias("a"), G.normalized_rect(F.col("b")).alias("b"),
        T.interaction_boundary(F.lit("row"), F.col("c")).alias("c"), T.interaction_boundary(F.lit("none"), F.col("d")).alias("d"), T.interaction_boundary(F.lit("row"), F.col("d")).alias("e"),
        T.duration_ms(ts("2026-01-01 00:00:01"), ts("2026-01-01 00:00:03")).alias("f"), T.duration_ms(ts("2026-01-01 00:00:05"), ts("2026-01-01 00:00:03")).alias("g"),
        T.contains_any_case("Ab c", F.lit("xAB"), F.lit("C"), F.lit(None)).alias("h"), T.shortened(F.lit("abcdef"), 3).alias("i"),
        G.project_rect(F.array(*map(F.lit, [2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0])), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("j"),
    ).first()
    assert tuple(r.a) == (1.0, 2.0, 3.0, 4.0) and r.b is None
    assert (r.c, r.d, r.e, r.f, r.g, r.h, r.i, tuple(r.j)) == ("none", "candidate_bbox", "row", 2000, 0, True, "abc", (1.0, 2.0, 2.0, 2.0))


def test_null_parts_give_null(spark):
    none, half = F.lit(None).cast("double"), F.lit(0.5)
    box, bad = (half, half, half, half), (half, none, half, half)
    bounds = F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int>")
    values = [G.clamp_unit_box(*bad), G.clamp_box(*bad), G.iou(box, bad), G.match_score(bad, box), G.normalized_bounds(bounds, F.lit(5), F.lit(5)), T.duration_ms(F.lit(None).cast("timestamp"), F.current_timestamp())]
    row = spark.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(values)], G.iou((half, half, F.lit(0.0), half), (half, half, F.lit(0.0), half)).alias("empty")).first()
    assert [row[f"c{i}"] for i in range(len(values))] == [None] * len(values) and row["empty"] == 0


def test_collations_and_sortable_ids(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",), ("é",)], "v string")
    assert [r.v for r in df.orderBy(T.localized(F.col("v"))).collect()] == ["a", "A", "b", "B", "é"]
    row = spark.range(1).select(identity.id_time(identity.time_id(F.lit(1_700_000_000_123), F.lit("s"))).alias("a"), identity.id_time(F.lit("x")).alias("b"), identity.record_hash(F.lit("no")).alias("c")).first()
    assert tuple(row) == (1_700_000_000_123, None, None)
