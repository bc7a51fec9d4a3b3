"""Answers of a recognition model as tables: repair with a log of issues, checks, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.functions.text import present
from lattika.operators.constraints import all_of
from lattika.operators.selection import top_one

# Lists of evidence, other parts of evidence and of a meaning, its states.
EVIDENCE = ("visibleTexts", "visibleIcons", "visibleStates", "visualCues")
OTHER_EVIDENCE, MEANING, STATES = ("userContext", "unclassified"), ("status", "description", "evidence", "basis"), ("known", "candidate", "unknown")
NOTE = "struct<type:string,detail:string>"


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    """A variant is of a type: STRING, BOOLEAN, ARRAY, OBJECT or NUMBER; false where it is missing."""
    shape = F.schema_of_variant(v)
    return F.coalesce(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if kind == "NUMBER" else shape.startswith(kind), F.lit(False))


def _given(v: Column) -> Column:
    """Neither missing nor null."""
    return F.coalesce(F.schema_of_variant(v) != "VOID", F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), _at(v, "$", "string"))


def _detail(v: Column) -> Column:
    """A text as it is, other values as JSON, null for none."""
    return F.when(_given(v), F.coalesce(_text(v), F.to_json(v)))


def _note(kind: Column | str, v: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), _detail(v).alias("detail"))


def _only(test: Column, *values: Column) -> Column:
    """An array of some values where a test holds, else an empty one."""
    return F.when(test, F.array(*values)).otherwise(F.array().cast("array<string>"))


def meaning(v: Column, hoisted: Column) -> Column:
    """status, description, evidence (map of lists), user_context, unclassified (type, detail), issues of a variant; `hoisted`: keys that were moved elsewhere.

    What cannot be read is kept as an unclassified note, and each repair is an issue. A meaning whose only evidence is
    unclassified is no more than a candidate.
    """
    noted = lambda kind: lambda m: _note(kind, m)
    told = lambda issue: lambda m: F.lit(issue)
    none, lists, notes, issues = F.array().cast(f"array<{NOTE}>"), [], [], []
    for name in EVIDENCE:
        x = _at(v, f"$.evidence.{name}")
        members = F.when(_is(x, "ARRAY"), _at(x, "$", "array<variant>"))
        texts = F.array_distinct(F.filter(F.transform(F.filter(members, lambda m: _is(m, "STRING")), lambda m: F.trim(_text(m))), lambda t: t != ""))
        odd = F.filter(members, lambda m: ~_is(m, "STRING"))
        single, strange = present(F.trim(_text(x))), _given(x) & ~_is(x, "ARRAY") & ~F.coalesce(present(F.trim(_text(x))), F.lit(False))
        lists += [F.lit(name), F.when(_is(x, "ARRAY"), texts).when(single, F.array(F.trim(_text(x)))).otherwise(F.array().cast("array<string>"))]
        notes.append(F.when(_is(x, "ARRAY"), F.transform(odd, noted(f"{name}-invalid"))).when(strange, F.array(_note(f"{name}-invalid", x))).otherwise(none))
        issues += [F.transform(F.coalesce(odd, F.array().cast("array<variant>")), told(f"{name} holds no text")), _only(single, F.lit(f"{name} is no list")), _only(strange, F.lit(f"{name} is unreadable"))]
    context, loose, basis = _at(v, "$.evidence.userContext"), _at(v, "$.evidence.unclassified"), _at(v, "$.basis")
    strange = _given(context) & ~_is(context, "STRING")
    notes.append(F.when(strange, F.array(_note("userContext-invalid", context))).otherwise(none))
    issues.append(_only(strange, F.lit("userContext is unreadable")))
    typed = lambda m: F.coalesce(present(F.trim(_text(_at(m, "$.type")))), F.lit(False))
    members = F.when(_is(loose, "ARRAY"), _at(loose, "$", "array<variant>"))
    read = F.transform(members, lambda m: F.when(typed(m), _note(F.trim(_text(_at(m, "$.type"))), _at(m, "$.detail"))).otherwise(_note("unclassified-invalid", m)))
    notes.append(F.when(_is(loose, "ARRAY"), read).when(_given(loose), F.array(_note("unclassified-invalid", loose))).otherwise(none))
    issues += [F.transform(F.coalesce(F.filter(members, lambda m: ~typed(m)), F.array().cast("array<variant>")), told("unclassified is unreadable")), _only(_given(loose) & ~_is(loose, "ARRAY"), F.lit("unclassified is no list"))]

    def unknown(path: str, known: tuple[str, ...], prefix: str, also: Column) -> None:
        entries = F.map_entries(F.coalesce(_at(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        left = F.filter(entries, lambda e: ~e["key"].isin(*known) & ~F.array_contains(also, e["key"]))
        notes.append(F.transform(left, lambda e: _note(F.concat(F.lit(prefix), e["key"]), e["value"])))
        issues.append(F.transform(left, lambda e: F.concat(F.lit(prefix), e["key"], F.lit(" is not defined"))))

    unknown("$.evidence", (*EVIDENCE, *OTHER_EVIDENCE), "", F.array().cast("array<string>"))
    notes.append(F.when(_given(basis), F.array(_note("model-basis", basis))).otherwise(none))
    issues.append(_only(_given(basis), F.lit("basis is not defined")))
    unknown("$", MEANING, "meaning.", hoisted)
    every = F.concat(*notes)
    once = F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: (y["type"] == x["type"]) & (F.coalesce(y["detail"], F.lit("")) == F.coalesce(x["detail"], F.lit("")))))
    said = _text(_at(v, "$.status"))
    status = F.when(said.isin(*STATES), said).otherwise("unknown")
    description = _at(v, "$.description")
    evidence, own = F.create_map(*lists), F.when(_is(context, "STRING"), F.nullif(F.trim(_text(context)), F.lit("")))
    classified = F.exists(F.map_values(evidence), lambda x: F.size(x) > 0) | own.isNotNull()
    weak = ~classified & (F.size(once) > 0) & (status == "known")
    issues += [_only(~F.coalesce(said.isin(*STATES), F.lit(False)), F.lit("status is unknown")), _only(~F.coalesce(F.schema_of_variant(description).isin("STRING", "VOID"), F.lit(False)), F.lit("description is unreadable")), _only(weak, F.lit("only unclassified evidence"))]
    parts = {"status": F.when(weak, "candidate").otherwise(status), "description": _text(description), "evidence": evidence, "user_context": own, "unclassified": once, "issues": F.concat(*issues)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def normalized(answers: DataFrame, types: list[str], replaced: dict[str, str]) -> DataFrame:
    """The columns of `answers` (element: JSON text) with candidate_key, geometry_kind, element_type, dynamic_content, confidence, risk_signals, meaning and issues.

    Aliases are renamed, types replaced or emptied, and values that were put into the meaning are moved up. A text that is no object gives nulls.
    """
    e = F.try_parse_json("element")
    rows = answers.withColumn("__e", F.when(_is(e, "OBJECT"), e))
    at = lambda p, kind="variant": _at(F.col("__e"), p, kind)
    m = F.when(_is(at("$.meaning"), "OBJECT"), at("$.meaning")).otherwise(F.parse_json(F.lit("{}")))
    rows = rows.withColumn("__m", m)
    inner = lambda p: _at(F.col("__m"), p)
    own, alias = _text(at("$.candidateKey")), at("$.candidate_key")
    has_alias = F.schema_of_variant(alias).isNotNull()
    taken = has_alias & ~F.coalesce(present(own), F.lit(False)) & F.coalesce(present(F.trim(_text(alias))), F.lit(False))
    shape, said = _text(at("$.geometryKind")), F.trim(_text(at("$.elementType")))
    repaired = F.coalesce(F.create_map(*[F.lit(x) for kv in replaced.items() for x in kv])[said], said) if replaced else said
    known = repaired.isin(*types)
    moved = {"dynamicContent": "BOOLEAN", "confidence": "NUMBER", "riskSignals": "ARRAY"}
    up = {k: _is(inner(f"$.{k}"), kind) for k, kind in moved.items()}
    lacks = {k: up[k] & ~_is(at(f"$.{k}"), moved[k]) for k in moved}
    signals = lambda v: F.coalesce(_at(F.when(_is(v, "ARRAY"), v), "$", "array<string>"), F.array().cast("array<string>"))
    hoisted = F.concat(*[_only(up[k], F.lit(k)) for k in moved])
    rows = rows.withColumn("meaning", F.when(F.col("__e").isNotNull(), meaning(F.col("__m"), hoisted)))
    risks = F.concat(signals(at("$.riskSignals")), _only(said.isNotNull() & ~known, F.lit("element-type-needs-review")), F.when(up["riskSignals"], signals(inner("$.riskSignals"))).otherwise(F.array().cast("array<string>")), _only(F.size("meaning.issues") > 0, F.lit("meaning-evidence-needs-review")))
    repairs = F.concat(
        _only(taken, F.lit("candidate_key is renamed")), _only(has_alias & ~taken, F.lit("candidate_key is dropped")), _only(F.coalesce(shape == "container", F.lit(False)), F.lit("container is a boundary")),
        _only(F.coalesce(known & (repaired != said), F.lit(False)), F.lit("element type is replaced")), _only(F.coalesce(~known, F.lit(False)), F.lit("element type is unknown")),
        *[_only(lacks[k] if k != "riskSignals" else up[k], F.lit(f"{k} is moved up")) for k in moved],
    )
    out = {
        "candidate_key": F.when(taken, F.trim(_text(alias))).otherwise(own),
        "geometry_kind": F.when(shape == "container", "boundary").otherwise(shape),
        "element_type": F.when(known, repaired).when(said.isNotNull(), ""),
        "dynamic_content": F.when(lacks["dynamicContent"], _at(inner("$.dynamicContent"), "$", "boolean")).otherwise(at("$.dynamicContent", "boolean")),
        "confidence": F.when(lacks["confidence"], _at(inner("$.confidence"), "$", "double")).otherwise(at("$.confidence", "double")),
        "risk_signals": F.array_distinct(risks),
        "issues": F.when(F.col("__e").isNotNull(), F.concat(repairs, F.col("meaning.issues"))),
    }
    return rows.select(*[F.col(c) for c in answers.columns], *[F.when(F.col("__e").isNotNull(), c).alias(n) for n, c in out.items()], "meaning")


def normalized_comparison(status: Column, changes: Column) -> Column:
    """changes (variants) of a comparison and whether they were repaired: none where none was requested; a text becomes an object with a summary."""
    dropped = (status == "not-requested") & (F.size(changes) > 0)
    texts = F.exists(changes, lambda c: _is(c, "STRING"))
    objects = F.transform(changes, lambda c: F.when(_is(c, "STRING"), F.parse_json(F.to_json(F.struct(_text(c).alias("summary"))))).otherwise(c))
    kept = F.when(dropped, F.array().cast("array<variant>")).when(texts, objects).otherwise(changes)
    return F.struct(kept.alias("changes"), F.coalesce(dropped | texts, F.lit(False)).alias("repaired"))


def complete(element: Column) -> Column:
    """A recovered element (JSON text) holds every part that a candidate needs, two of them in its meaning if not in itself. The text is parsed once, not for each part."""
    return F.get(F.transform(F.array(F.try_parse_json(element)), _whole), F.lit(0))


def _whole(e: Column) -> Column:
    has = lambda p, kind: _is(_at(e, p), kind)
    key = F.when(_given(_at(e, "$.candidateKey")), _at(e, "$.candidateKey")).otherwise(_at(e, "$.candidate_key"))
    parts = [present(F.trim(_text(key))), *[has(f"$.{f}", "STRING") for f in ("visualDescription", "elementType", "geometryKind")], has("$.interactive", "BOOLEAN"), has("$.geometryConfidence", "NUMBER")]
    parts += [has("$.approximateRegion", "OBJECT") | has("$.approximateRegion", "ARRAY"), has("$.meaning", "OBJECT") | has("$.meaning", "ARRAY")]
    parts += [has(f"$.{f}", kind) | has(f"$.meaning.{f}", kind) for f, kind in (("dynamicContent", "BOOLEAN"), ("confidence", "NUMBER"))]
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def consistency_issues(elements: DataFrame, relations: DataFrame, actions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(result, code, subject): what contradicts itself in an answer, one row for each occurrence.

    elements: result, key, pos, interactive, x, y, width, height; relations: result, from_key, to_key; actions: result, trigger; comparisons: result, basis, status.
    """
    row = lambda df, code, subject: df.select("result", F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    again = elements.groupBy("result", "key").count().where("count > 1").select("result", "key", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))))
    first = top_one(elements, ["result", "key"], F.col("pos")).select("result", "key", "interactive", F.lit(True).alias("known"))
    ends = relations
    for end in ("from_key", "to_key"):
        ends = ends.join(first.select("result", F.col("key").alias(end), F.col("known").alias(f"__{end}")), ["result", end], "left")
    used = actions.join(first.select("result", F.col("key").alias("trigger"), "interactive", "known"), ["result", "trigger"], "left")
    return all_of([
        row(again, "key_repeated", F.col("key")),
        row(elements.where("x + width > 1 OR y + height > 1"), "box_outside", F.col("key")),
        row(ends.where("__from_key IS NULL OR __to_key IS NULL"), "relation_unknown", F.concat("from_key", F.lit(" -> "), "to_key")),
        row(used.where("known IS NULL"), "action_unknown", F.col("trigger")),
        row(used.where("known AND NOT coalesce(interactive, false)"), "action_not_interactive", F.col("trigger")),
        row(comparisons.where("basis IS NOT NULL OR NOT status <=> 'not-requested'"), "comparison_requested", F.col("status")),
    ])


def prepared_actions(elements: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, actions): actions whose trigger is known and interactive; a trigger that is not gets the risk `model-action-inconsistent`. Of elements that share a key the last counts."""
    last = top_one(elements, ["result", "key"], F.col("pos").desc()).select("result", "key", "pos", "interactive")
    used = actions.join(last.select("result", F.col("key").alias("trigger"), "interactive"), ["result", "trigger"])
    wrong = used.where("NOT coalesce(interactive, false)").select("result", F.col("trigger").alias("key")).distinct().join(last, ["result", "key"]).select("result", "key", "pos", F.lit(True).alias("__wrong"))
    risk = F.array_union(F.coalesce("risk_signals", F.array().cast("array<string>")), F.array(F.lit("model-action-inconsistent")))
    marked = elements.join(wrong, ["result", "key", "pos"], "left").withColumn("risk_signals", F.when(F.col("__wrong"), risk).otherwise(F.col("risk_signals"))).select(elements.columns)
    return marked, used.where("interactive").select(actions.columns)


def worker_errors(answers: DataFrame, elements: DataFrame, required: DataFrame, special: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(answer, rule, detail): why a worker's answer is refused.

    answers: answer, state, expected_frame, frame, page, relationships, uncertainties; elements: answer, key, type, interactive, x, y, width, height;
    required: state, key. special: (part of a state, key, type): in such states the element must be an interactive one of the type.
    """
    row = lambda df, rule, detail: df.select("answer", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    missing = answers.select("answer", "state").join(required, "state").join(elements.select("answer", "key"), ["answer", "key"], "left_anti")
    sides = [F.col(c) for c in ("x", "y", "width", "height")]
    finite = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) & (c <= 1) for c in sides]) & (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] > 0) & (sides[3] > 0)
    rows = [
        row(answers.where(~F.col("frame").eqNullSafe(F.col("expected_frame"))), "frame_differs", F.col("frame")),
        row(answers.where("page IS NULL"), "page_missing", F.lit(None)),
        row(answers.where("relationships IS NULL OR uncertainties IS NULL"), "lists_missing", F.lit(None)),
        row(missing, "candidate_missing", F.col("key")),
        row(elements.where(~F.coalesce(finite, F.lit(False))), "region_invalid", F.col("key")),
    ]
    for part, key, kind in special:
        good = elements.where((F.col("key") == key) & (F.col("type") == kind) & F.col("interactive")).select("answer")
        rows.append(row(answers.where(F.contains("state", F.lit(part))).join(good, "answer", "left_anti"), "special_missing", F.lit(key)))
    return all_of(rows)


def role(kind: Column, interactive: Column) -> Column:
    """What an element is for."""
    return F.when(kind.isin("container", "label"), kind).when(kind.isin("status", "badge"), "status_indicator").when(interactive, "action_trigger").otherwise("content_anchor")


def actionability(enabled: Column, risk: Column, semantic_role: Column, refused: Column, allowed: Column) -> Column:
    """Whether a control may be tried. refused: a forbidden pattern matches it; allowed: the risks that are."""
    return (
        F.when(enabled.eqNullSafe(F.lit(False)), "disabled").when(risk.eqNullSafe(F.lit("unknown")) | semantic_role.eqNullSafe(F.lit("unknown")), "unresolved")
        .when(F.coalesce(refused, F.lit(False)), "skipped_policy").when(F.coalesce(F.array_contains(allowed, risk), F.lit(False)), "eligible_for_safe_exploration").otherwise("skipped_risk")
    )


def failure_status(name: Column, message: Column) -> Column:
    """A failed assertion is a fail, another error tells nothing."""
    return F.when(F.coalesce((name == "AssertionError") | message.rlike("(?i)^Assertion failed:"), F.lit(False)), "fail").otherwise("unknown")


def implementation(nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, kind (`rn`, `h5`, `native`, `unknown`): by the classes and packages of its nodes (frame, class, package); frames: frame, package, activity. The activity decides where it tells."""
    word = F.concat_ws(" ", "class", "package")
    seen = nodes.groupBy("frame").agg(F.bool_or(word.rlike(r"(?i)ReactRootView|ReactViewGroup|com\.facebook\.react")).alias("rn"), F.bool_or(word.rlike("(?i)WebView|BHWebActivity|WebViewActivity|h5cache")).alias("h5"))
    rows = frames.join(seen, "frame", "left")
    package = F.coalesce(F.col("package").rlike("(?i)WebView|BHWebActivity|h5cache"), F.lit(False))
    by_nodes = F.when(F.col("rn"), "rn").when(F.coalesce("h5", F.lit(False)) | package, "h5").when(F.col("rn").isNotNull(), "native").otherwise("unknown")
    told = F.when(F.col("activity").rlike("(?i)ZRNActivity|React"), "rn").when(F.col("activity").rlike("(?i)BHWebActivity|WebView|H5"), "h5")
    return rows.select("frame", F.coalesce(told, by_nodes).alias("kind"))
