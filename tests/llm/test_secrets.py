import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lattika.llm.secrets import RULES, Rule, Shard, digest_columns, redact, scan, trigram_query, trigrams

SCHEMA = "doc_id long, text string, spans string, kind int"
LETTERS = re.ASCII
BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", LETTERS), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, r, keep) in enumerate(BASE) for m in r.finditer(text or "") if keep(m)]
    return [f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def texts():
    rnd = random.Random(2)
    bits = ["password", "PassWD", "ſecret", "toKen", "api_key", "APIKEY", ": ", "=", " = '", '"', "abc123", "abcdef", "é", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "ghp_" + "a1" * 20, "xoxb-123456789012", "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----", "AKI"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(400)] + ["", None, "x" * 200_000 + " secret=abcdefg", "token" + " " * 5000]


def test_against_plain_regular_expressions(spark):
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = digest_columns(scan(df)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is None:
            continue
        want, r = brute(t), by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_queries_lose_no_match():
    patterns = [r"ab+cde", r"(foo|ba[rz])qux", r"(?i:Hello)\s+wor", r"x{2,3}yz", r"(abc)?def", r"[abc]xy", r"a.c", r"abcd|.", r"(ab|cd)(ef|gh)", r"q(?:we|rt)*y"]
    rnd = random.Random(3)
    column = ["".join(rnd.choice(["ab", "b", "cde", "foo", "bar", "baz", "qux", "HELLO ", "worx", "xx", "yz", "def", "cxy", "ef", "gh", "cd", "q", "we", "y"]) for _ in range(12)) for _ in range(500)]
    for p in [*patterns, *(r.pattern for r in RULES)]:
        query = trigram_query(p)
        rows = set(Shard(pa.array(column), trigrams(query)).candidates(query).tolist())
        assert {i for i, t in enumerate(column) if re.search(p, t)} <= rows
    assert trigram_query(r"[0-9a-f]+") is None and trigram_query(r"abcd") == ("and", (b"abc", b"bcd"))
    assert len(Shard(pa.array(["ab", "cd"]), {b"abc"}).candidates(b"abc")) == 0


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "é secret=abcdefgh end", "s", 1), (2, None, "s", 1), (3, "clean", "s", 1), (None, "", "s", 1)], SCHEMA)
    found = sorted((tuple(r) for r in redact(df).collect()), key=str)
    assert found == sorted([(1, "é [SECRET] end", "s", 1), (2, None, "s", 1), (3, "clean", "s", 1), (None, "", "s", 1)], key=str)


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trigrams_across_chunks(monkeypatch):
    import pyarrow as pa

    from lattika.llm import secrets

    texts = ["", "abcd", None, "xxabcxx" * 9, "ab", "c", "ABC"]
    want = secrets.Shard(pa.array(texts), {b"abc", b"bcx"}).postings
    for size in (1, 2, 5):
        monkeypatch.setattr(secrets, "CHUNK", size)
        found = secrets.Shard(pa.array(texts), {b"abc", b"bcx"}).postings
        assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in want.items()} == {b"abc": [1, 3, 6], b"bcx": [3]}
