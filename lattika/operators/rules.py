"""Many integrity rules as one plan.

Rules are data: a table, what to look at in each row, and when that is wrong. The compiler turns all rules on a table into one expression, so the table is scanned once and its
arrays are exploded once, whatever the number of rules. Rules about other rows become references (kind, id); all references of all tables meet one table of facts, in one join:
a row for each record by kind and id, and a row for each typed edge that records state. An edge has the id `a>b`, so that a rule about a relation is a reference too and
no array of a record with many relations travels with each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule. All parts are SQL; texts are compared as binary.

    code: names the rule. table: whose rows are its subjects. each: an array, each member `x` of which is looked at; without it the row. detail: what a violation says, from the row and `x`.
    fails: when that is a violation; a null is none. to, ref: the kind and id of a fact that is looked up; `fails` may then use `f`, the fact's columns (f.n: how many records
    have the id; f IS NULL: there is none), `ref`, `detail` and the columns that the table carries as `row.column`, but not `x`. unless: a code; a violation is dropped where the subject has one of that code with equal detail.
    """

    code: str
    table: str
    fails: str
    detail: str = "''"
    each: str | None = None
    to: str | None = None
    ref: str = "x"
    unless: str | None = None


@dataclass(frozen=True)
class Facts:
    """What a table states: its rows as records of a kind (columns: attribute -> SQL; id of the row), and edges by kind (SQL of an array of ids `a>b`)."""

    table: str
    kinds: tuple[str, ...] = ()
    id: str = "id"
    columns: tuple[tuple[str, str], ...] = ()
    edges: tuple[tuple[str, str], ...] = ()


def looked_up(facts: list[Facts], rules: list[Rule]) -> list[Facts]:
    """Of what the tables state, that which some rule looks up; at least one statement, so that there is a table of facts."""
    asked = {r.to for r in rules}
    part = [replace(f, kinds=tuple(k for k in f.kinds if k in asked), edges=tuple(e for e in f.edges if e[0] in asked)) for f in facts]
    return [f for f in part if f.kinds or f.edges] or facts[:1]


def facts_table(facts: list[Facts], tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id, n and the attributes of all records and edges, one row for each kind and id; of records that share both, the attributes of the greatest."""
    types = {}
    for f in facts:
        shape = tables[f.table].selectExpr(*[f"{sql} AS {name}" for name, sql in f.columns]).schema if f.columns else ()
        types |= {c.name: c.dataType.simpleString() for c in shape}
    none = {name: f"CAST(NULL AS {kind})" for name, kind in types.items()}

    def stated(f: Facts) -> DataFrame:
        own = none | dict(f.columns)
        attributes = lambda of: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in of.items()) + ")"
        rows = [f"array({', '.join(f'''named_struct('kind', '{k}', 'id', CAST({f.id} AS STRING), 'a', {attributes(own)})''' for k in f.kinds)})"] if f.kinds else []
        rows += [f"transform({sql}, e -> named_struct('kind', '{k}', 'id', CAST(e AS STRING), 'a', {attributes(none)}))" for k, sql in f.edges]
        together = [f"coalesce({r}, array())" for r in rows]
        return tables[f.table].selectExpr(f"explode({' || '.join(together)}) AS fact").select("fact.kind", "fact.id", "fact.a").where("id IS NOT NULL")

    every = reduce(DataFrame.unionByName, [stated(f) for f in facts])
    return every.groupBy("kind", "id").agg(F.count("*").alias("n"), F.max("a").alias("a")).select("kind", "id", F.struct("n", "a.*").alias("f") if types else F.struct("n").alias("f"))


def violations_of(rules: list[Rule], tables: dict[str, DataFrame], subjects: dict[str, str], carries: dict[str, list[str]], facts: DataFrame) -> DataFrame:
    """(rule, subject, detail): what breaks the rules. subjects: SQL of each table's subject; carries: the columns of each table that rules on facts use; they should be small."""

    def looked_at(table: str) -> DataFrame:
        parts = []
        for r in (r for r in rules if r.table == table):
            seen = f"named_struct('rule', '{r.code}', 'to', {repr(r.to) if r.to else 'CAST(NULL AS STRING)'}, 'ref', CAST({r.ref if r.to else 'NULL'} AS STRING), 'detail', CAST({r.detail} AS STRING))"
            if r.each:
                members = r.each if r.to else f"filter({r.each}, x -> {r.fails})"
                parts.append(f"coalesce(transform({members}, x -> {seen}), array())")
            else:
                parts.append(f"array({seen})" if r.to else f"CASE WHEN {r.fails} THEN array({seen}) ELSE array() END")
        kept = ", ".join(f"'{c}', {c}" for c in carries.get(table, [])) or "'none', 0"
        return tables[table].selectExpr(f"CAST({subjects[table]} AS STRING) AS subject", f"named_struct({kept}) AS row", f"explode({' || '.join(parts)}) AS c").select("subject", "row", "c.*")

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [looked_at(t) for t in dict.fromkeys(r.table for r in rules)])
    # a finding that looks nothing up, and a reference without an id, go to a partition of their own choice instead of all to one
    alone = F.concat(F.lit("?"), F.coalesce("subject", F.lit("")), F.lit("/"), F.coalesce("detail", F.lit("")))
    met = every.withColumns({"kind": F.coalesce("to", F.lit("")), "id": F.coalesce("ref", alone)}).join(facts, ["kind", "id"], "left")
    cases = " ".join(f"WHEN '{r.code}' THEN {r.fails}" for r in rules if r.to)
    found = met.where(F.col("to").isNull() | F.coalesce(F.expr(f"CASE rule {cases} END"), F.lit(False)) if cases else F.lit(True)).select("rule", "subject", "detail")
    spared = {r.code: r.unless for r in rules if r.unless}
    if spared:
        others = F.collect_set("rule").over(Window.partitionBy("subject", "detail"))
        excuse = F.create_map(*[F.lit(x) for kv in spared.items() for x in kv])[F.col("rule")]
        found = found.withColumn("__all", others).where(~F.coalesce(F.array_contains("__all", excuse), F.lit(False))).drop("__all")
    return found
