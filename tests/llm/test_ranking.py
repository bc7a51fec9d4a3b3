import math
import random
import re

import numpy as np
import pytest

from lattika.llm import ranking
from lattika.llm.ranking import build, search

DOCS, ITEMS = "doc_id long, text string, score string, rank int", "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, terms_of(t)) for i, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for item, text in items:
        scores = []
        for i, w in held:
            score = 0
            for t in set(terms_of(text)) & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * len(w) * n // total)))
            if score > 0:
                scores.append((-score, i if i is not None else -1, i))
        if scores:
            out[item] = [(i, -s) for s, _, i in sorted(scores)[:k]]
    return out


def ranked(spark, docs, items, k, parts=3):
    index = build(spark.createDataFrame([(i, t, "s", 1) for i, t in docs], DOCS).repartition(parts))
    found = {}
    for r in search(index, spark.createDataFrame([(i, t, "d") for i, t in items], ITEMS), k).orderBy("item_id", "rank").collect():
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    return found


@pytest.mark.parametrize("terms", [1 << 17, 40])
def test_against_all_scores(spark, monkeypatch, terms):
    """One group of queries, and several; frequent and rare terms, copies whose scores tie at the last rank."""
    monkeypatch.setattr(ranking, "GROUP_TERMS", terms)
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(20_000)]
    docs = [(i * 3 % 1009, rnd.choice([" ", ", ", "-\n"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(2_000 + i, "w1 W1 rare, copy") for i in range(60)]
    items = [(j, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 20])))) for j in range(25)] + [(99, "rare rare copy"), (98, "unknown")]
    assert ranked(spark, docs, items, 20) == brute(docs, items, 20)


def test_terms_nulls_empty_repeated_and_long_texts(spark):
    docs = [(1, "Äpfel ÄPFEL äpfel-x1"), (2, None), (3, ""), (None, "äpfel x1"), (5, "x1" + "y" * 300_000), (6, "z " * 200_000 + "x1"), (7, "x1 z"), (7, "x1 z"), (8, "\x7f_{}~ ")]
    items = [(1, "äpfel"), (2, "X1;x1"), (3, "z"), (4, None), (5, ""), (None, "x1"), (6, "ÄPFEL")]
    found = ranked(spark, docs, items, 4)
    assert found == brute(docs, items, 4) and set(found) == {1, 2, 3, 6, None}


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "b")])):
        assert ranked(spark, docs, items, 5) == {}


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    frequency, lengths = rng.integers(1, 2_000, 5_000), rng.integers(1, 10**7, 5_000)
    exact = ranking.impacts(frequency, lengths, 10**6, 10**9)
    coded = -(-exact // ranking.STEP)
    assert coded.max() < 256 and (exact <= ranking.STEP * coded).all() and (exact >= np.where(coded > 0, ranking.STEP * (coded - 1) + 1, 0)).all()
    assert ranking.impacts(np.array([3]), np.array([10**8]), 5 * 10**10, 10**13)[0] == 3 * 10**9 // (3000 + 20 * (50 + 50 * 10**8 * 5 * 10**10 // 10**13))
