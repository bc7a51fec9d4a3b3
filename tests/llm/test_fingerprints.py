import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lattika.llm import fingerprints
from lattika.llm.fingerprints import classes, edited, fingerprint, likeness, op11_fingerprints, signatures
from lattika.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, class_id string, part int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def words_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def jaccard(a, b):
    a, b = words_of(a), words_of(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def cut(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_signatures_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(fingerprints, "STRIPE", 7)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdef") * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 4, 5, 30]))) for _ in range(40)]
    sets, counts = shingle_sets(pa.array(texts), 5)
    found, at = signatures(sets, counts), 0
    for row, n in zip(found, counts):
        for i in range(0, fingerprints.PERMUTATIONS, 17):
            a, b = int(fingerprints._A[i]), int(fingerprints._B[i])
            values = [((int(x) ^ int(x) >> 32) % 2**32 * a + b) % 2**64 >> 32 for x in sets[at : at + n]]
            assert row[i] == min(values, default=2**32 - 1)
        at += n


def test_likeness_estimates_jaccard():
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    off = []
    for share in (0.01, 0.03, 0.1, 0.3, 1.0) * 6:
        other = [w if rnd.random() > share else f"n{rnd.random()}" for w in base]
        a, b = (signatures(*shingle_sets(pa.array([" ".join(t)]), 5)) for t in (base, other))
        off.append(likeness(a, b)[0] - jaccard(" ".join(base), " ".join(other)))
    assert np.abs(off).max() < 0.16 and abs(np.mean(off)) < 0.03


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_against_plain_python(spark, parts):
    rnd = random.Random(parts)
    rows = [(i * 5, rnd.choice(["", "é", "\U0001f600 x", "A b c D e f g"]) + " ".join(f"ü{rnd.randint(0, 40)}" for _ in range(rnd.choice([0, 1, 3, 60, 400])))) for i in range(90)]
    rows[7] = (35, None)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    found = {r.doc_id: r for r in edited(table_of(spark, shuffled)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = [t or "" for _, t in rows]
    prints = {r.doc_id: bytes(r.fingerprint) for r in fingerprint(table_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    for k, (i, _) in enumerate(rows):
        after = (k + 1) % len(rows)
        changed = cut(texts[k], texts[after])
        own, other, following = (np.frombuffer(x, ">u2")[None] for x in (prints[i], found[i].edited_fingerprint, prints[rows[after][0]]))
        assert (found[i].n_chars, found[i].edited_sha256, bytes(found[i].fingerprint)) == (len(texts[k]), hashlib.sha256(changed.encode()).hexdigest(), prints[i])
        assert (bytes(found[i].edited_fingerprint) == prints[i]) >= (changed == texts[k])
        assert found[i].near_edited == likeness(own, other)[0] and found[i].near_next == likeness(own, following)[0]
        assert abs(found[i].near_edited - jaccard(texts[k], changed)) < 0.22


def test_slices_hand_over_their_last_document(spark):
    """More rows in a task than a slice holds, and a long text that is a slice of its own."""
    rows = [(i, f"text {i} " * (300_000 if i == 1_500 else i % 5)) for i in range(2_300)]
    found = {r.doc_id: r for r in edited(table_of(spark, rows).coalesce(1)).collect()}
    for i, t in rows:
        following = rows[(i + 1) % len(rows)][1]
        assert found[i].edited_sha256 == hashlib.sha256(cut(t, following).encode()).hexdigest()
        assert (found[i].near_next == 1) >= (words_of(t) == words_of(following))


def test_classes_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for family in range(20):
        base = [f"f{family}w{rnd.randint(0, 300)}" for _ in range(rnd.choice([1, 4, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 6])):
            rows.append((len(rows) * 7 % 1009, " ".join(w if rnd.random() > 0.01 * (family % 4) else f"z{rnd.random()}" for w in base)))
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if words_of(a) and 100 * len(words_of(a) & words_of(b)) >= 80 * len(words_of(a) | words_of(b)):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i, _ in rows):
            break
    assert {r.doc_id: r.class_id for r in classes(table_of(spark, rows)).collect()} == label


def test_nulls_repeated_ids_single_rows_and_empty_tables(spark):
    rows = [(None, "lone words without an id"), (3, None), (3, ""), (3, " \n"), (4, "x" * 9), (4, "x" * 9), (9, "long " * 200_000)]
    found = edited(table_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(i), len(t or "")) for i, t in rows)
    assert len({bytes(r.fingerprint) for r in found if r.doc_id == 3}) == 1 and {r.near_next for r in found if r.doc_id == 3} == {1.0, 0.0}
    last = next(r for r in found if r.doc_id == 9)
    assert last.edited_sha256 == hashlib.sha256(cut("long " * 200_000, rows[0][1]).encode()).hexdigest()
    assert [(r.near_edited, r.near_next, r.edited_sha256) for r in edited(table_of(spark, [(1, "abcd")])).collect()] == [(0.0, 1.0, hashlib.sha256(b"abab").hexdigest())]
    for f in (edited, fingerprint, classes):
        assert f(table_of(spark, [])).count() == 0


def test_query(spark, tmp_path):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(12)]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_fingerprints(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.class_id for r in found] == [i - i % 2 for i in range(12)]
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 512 for r in found) and found[0].fingerprint == found[1].fingerprint
    assert [r.near_next == 1 for r in found] == [True, False] * 6
