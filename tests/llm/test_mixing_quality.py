import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lattika.llm import mixing
from lattika.llm.mixing import OP2_SQL, PACKET, first_words, mix, op2_mixing, take
from lattika.llm.quality import OP8_SQL, host_verdicts, judge, op8_quality

SCHEMA = "doc_id long, text string, source string, size string, target string, host string"


def rows(seed=1, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny" if i % 40 == 0 else "b"])
        words = [rnd.choice(["w", "x#", "yy", "|", "é"]) + str(rnd.randrange(30)) for _ in range(rnd.choice([0, 3, 19, 40, 90]))]
        text = rnd.choice([" ", "\n", " \x0b "]).join(words * rnd.choice([1, 1, 1, 3]))
        out.append((rnd.choice([i, i, i, 7]) if i % 60 else None, text if i % 31 else None, source))
    return out


def folder(spark, tmp_path, data):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query, sql", [(op2_mixing, OP2_SQL), (op8_quality, OP8_SQL)])
@pytest.mark.parametrize("data", [rows(), rows(2, 5), [(1, None, "a"), (2, "", None)]])
def test_against_sql(spark, tmp_path, query, sql, data):
    if query is op2_mixing:  # the order of unlike rows that share an id is the hash of their text, which SQL lacks
        data = [(i if r[0] is not None else None, *r[1:]) for i, r in enumerate(data) if r[0] is not None]
    where = folder(spark, tmp_path, data)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{where}/documents.parquet/*.parquet')")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    at = [d[0] for d in want.description]
    want = sorted((tuple(r[at.index(c)] for c in names) for r in want.fetchall()), key=str)
    found = query(spark, where)
    assert sorted(found.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=str) == want


def test_repeated_rows_without_words_stay(spark, tmp_path):
    data = [(1, "", "a")] * 3 + [(1, None, "a")] * 2 + [(None, None, None)] * 4 + [(2, "w x", "a"), (2, "w x", "a")]
    found = op2_mixing(spark, folder(spark, tmp_path, data)).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len((t or "").split())) for i, t, _ in data)


def test_mix_order_and_take(spark):
    data = rows(3)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    copies = mix(df).collect()
    assert [c.finish for c in copies] == sorted(c.finish for c in copies)
    per = Counter()
    for c in copies:
        per[c.source] += c.taken
    targets = {c.source: c.target for c in copies}
    assert all(abs(per[s] - t) <= PACKET for s, t in targets.items())
    assert sum(per.values()) == 3 * sum(c.size for c in copies if c.copy == 0) // 2
    whole = [c.finish for c in copies if 0 < c.taken == c.size]
    assert all(c.taken == c.size for c in copies if c.finish <= sorted(whole)[len(whole) * 9 // 10] and c.size <= PACKET)
    ordered = take(df).collect()
    want = [(c.doc_id, c.source, c.taken) for c in copies if c.taken]
    assert [(r.doc_id, r.source, len((r.text or "").split())) for r in ordered] == want
    assert len({s for _, s, _ in want[:40]}) > 2
    taken = take(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = Counter()
    for r in taken:
        got[r.source] += words(r.text)
        assert (r.size, r.target, r.host) == ("x", "y", "z")
    assert got == +per
    assert sorted(take(df).collect(), key=str) == sorted(taken, key=str)


def test_first_words_keep_the_text(spark):
    data = [("  a\tb\n c d ", n) for n in range(1, 6)] + [("a b", 1), ("a", 1)]
    found = spark.createDataFrame(data, "t string, n long").select(first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r.x for r in found] == ["  a", "  a\tb", "  a\tb\n c", "  a\tb\n c d", "  a\tb\n c d", "a", "a"]


def test_refused_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    data = [(i, good, f"h{i % 4}") for i in range(80)] + [(100 + i, "too short", "bad") for i in range(40)] + [(200, good, "bad"), (201, good, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    found = {r.doc_id: r.kept for r in judge(df).collect()}
    assert not found[200] and found[201] and all(found[i] for i in range(80)) and not any(found[100 + i] for i in range(40))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == take(empty).count() == judge(empty).count() == 0


@pytest.mark.parametrize("slots, step", [(4, 3), (2, 1), (4096, 10)])
def test_the_cut_is_found_by_refinement(spark, monkeypatch, slots, step):
    """However coarse the ranges and however few packets are ordered at once, also where most packets finish at one time."""
    rnd = random.Random(slots)
    rows = [(i % 97, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 64, 65, 300]))), rnd.choice(["a", "a", "a", "a", "b", None])) for i in range(150)]
    queued = mixing.queues(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = mixing.cut(queued)
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "STEP", step)
    assert want is not None and mixing.cut(queued) == want
