"""Secret scan with a trigram inverted index (operator 4).

Each rule's regular expression is parsed (Python's own parser) and turned into a Boolean query over the trigrams of
ASCII-lower-cased text: a literal run needs all its trigrams, a sequence all of its parts, an alternation one of
its branches. Each slice of texts is an index shard: for the trigrams that the queries name, sorted postings of
the rows that hold them. A rule's query intersects and unites postings, and only its candidates are verified with the
regular expression; rules whose query is empty (no mandatory trigram) scan every text.

Texts stay where they lie: an index shard is built, used and dropped within one task, so nothing is shuffled, and a
task that runs again does the same work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.batches import slices
from lattika.llm.common import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; those that `keep` refuses are dropped."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 20


# The base kinds in the order in which they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", _long_key),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs [0-9a-f]+ of 24 characters or more
)
#: Formats with fixed prefixes, found besides the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
)
RULES = BASE + MORE
#: Exact strings of a sequence's parts that are multiplied out, at most.
EXPANDED = 16

#: A query: None (anything), a trigram, or ("and" | "or", parts).
Query = object


def _join(kind: str, parts: list) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None)) if kind == "and" else list(dict.fromkeys(parts))
    if not parts or (kind == "or" and None in parts):
        return None
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _literal(text: str) -> Query:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    return _join("and", [low[i : i + 3] for i in range(len(low) - 2)])


def _needs(tree) -> tuple[set[str] | None, Query]:
    """Of a parsed expression: the few exact strings that it can match (None: not few), and what any match holds."""
    exact: set[str] | None = {""}
    run, parts = {""}, []  # run: the exact strings since the last part that is not exact

    def close() -> None:
        parts.append(_join("or", [_literal(s) for s in sorted(run)]))

    for op, value in tree:
        name = str(op)
        strings, query = None, None
        if name == "LITERAL":
            strings = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            strings = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            strings, query = _needs(value[3])
        elif name == "BRANCH":
            branches = [_needs(b) for b in value[1]]
            strings = set().union(*(s for s, _ in branches)) if all(s is not None for s, _ in branches) else None
            query = _join("or", [q for _, q in branches])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            inside, query = _needs(inner)
            if inside is not None and most == 1:
                strings = inside | ({""} if not least else set())
            query = query if least else None
        if strings is not None and len(run) * len(strings) <= EXPANDED:
            run = {a + b for a in run for b in strings}
            exact = run if exact is not None and not parts else None
            continue
        close()
        parts.append(query if strings is None else _join("or", [_literal(s) for s in sorted(strings)]))
        run, exact = {""}, None
    if exact is None:
        close()
        return None, _join("and", parts)
    return exact, _join("or", [_literal(s) for s in sorted(exact)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies, letter case aside; None: every text may match."""
    return _needs(_parser.parse(pattern, re.ASCII))[1]


def trigrams(query: Query) -> set[bytes]:
    """The trigrams that a query names."""
    if query is None or isinstance(query, bytes):
        return {query} - {None}
    return set().union(*(trigrams(p) for p in query[1]))


#: Bytes that are searched for trigrams at a time.
CHUNK = 1 << 18


@lru_cache(maxsize=4)
def _numbered(wanted: frozenset[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Trigrams in order, and the number of each from 1 by its code."""
    names = sorted(wanted)
    slots = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint16)
    slots[[int.from_bytes(n, "big") for n in names]] = np.arange(1, len(names) + 1)
    return names, slots


class Shard:
    """Postings of one slice of texts for the trigrams that queries name."""

    def __init__(self, texts: pa.Array, wanted: set[bytes]):
        self.rows = len(texts)
        names, slots = _numbered(frozenset(wanted))
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.postings: dict[bytes, np.ndarray] = {n: np.zeros(0, np.int64) for n in names}
        if not self.rows or offsets[-1] - offsets[0] < 3 or not names:
            return
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        edges, parts = offsets - offsets[0], []
        for begin in range(0, len(raw) - 2, CHUNK):
            part = raw[begin : begin + CHUNK + 2]  # trigrams that begin in this chunk
            low = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.int32)
            found = slots[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found)
            row = np.searchsorted(edges, at + begin, side="right") - 1
            inside = at + begin + 3 <= edges[row + 1]  # not across two texts
            parts.append(np.unique(found[at[inside]].astype(np.int64) * self.rows + row[inside]))
        keys = np.unique(np.concatenate(parts))
        number = keys // self.rows
        for i, name in enumerate(names):
            self.postings[name] = keys[np.searchsorted(number, i + 1) : np.searchsorted(number, i + 2)] % self.rows

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that satisfy a query, ascending."""
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        found = [self.candidates(p) for p in parts]
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if kind == "and" else np.union1d(out, more)
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, end exclusive, by start and then by the order of rules.

    Every row gives one row, whole texts are scanned, and a null text is empty. Null and repeated ids pass through;
    other columns are not read; an empty table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*(trigrams(q) for q in queries)) if rules else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.regex for r in rules]
        for batch in slices(batches):
            shard, texts = Shard(batch.column(1), wanted), batch.column(1).to_pylist()
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for rank, (rule, regex, query) in enumerate(zip(rules, compiled, queries)):
                for i in shard.candidates(query):
                    found[i].extend((m.start(), rank, m.end()) for m in regex.finditer(texts[i] or "") if rule.keep(m))
            spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, kind)})

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of a scan."""
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    own = listed(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *counts, F.sha2(own, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of a secret in `text` replaced by `mark` (overlapping spans by one); all rows and columns stay.

    Null texts stay null, repeated rows are treated alike, long texts are whole, and an empty table stays empty.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*(trigrams(q) for q in queries)) if rules else set()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.regex for r in rules]
        for batch in slices(batches):
            column = batch.column(at)
            shard, texts = Shard(column, wanted), column.to_pylist()
            found: dict[int, list[tuple[int, int]]] = {}
            for rule, regex, query in zip(rules, compiled, queries):
                for i in shard.candidates(query):
                    if spans := [m.span() for m in regex.finditer(texts[i] or "") if rule.keep(m)]:
                        found.setdefault(int(i), []).extend(spans)
            for i, spans in found.items():
                out, done = [], 0
                for start, end in sorted(spans):
                    if start >= done:
                        out += [texts[i][done:start], mark]
                    done = max(done, end)
                texts[i] = "".join(out) + texts[i][done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents under all rules."""
    return digest_columns(scan(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    found = " UNION ALL ".join(f"SELECT k, {i} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, '{_quoted(r)}') AS m, regexp_split_to_array(t, '{_quoted(r)}') AS p FROM texts" for i, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    span = "string_agg(kind || ':' || start || ':' || start + length(s), ',' ORDER BY start, rank)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (
  SELECT k, rank, kind, m[i] AS s, list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
kept AS (
  SELECT k, rank, kind, s, CAST(start AS BIGINT) AS start FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, '{_quoted(BASE[0])}', 2)) >= 6 WHEN 'access' THEN length(s) >= 20 ELSE true END),
listed AS (SELECT k, {counts}, {span} FILTER (kind IN ({base})) AS base, {span} AS spans FROM kept GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN listed USING (k)
"""


def _quoted(rule: Rule) -> str:
    return rule.pattern.replace("'", "''")


OP4_SQL = _oracle()
