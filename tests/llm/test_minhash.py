import itertools
import random
import re

import pytest

from lattika.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


def check(spark, rows, k):
    found = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), shingle=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, k)
    assert all(r.kept == (r.component_id in (None, r.doc_id)) for r in found)


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    rnd = random.Random(k)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for family in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 6, 40, 200]))]
        for _ in range(rnd.choice([1, 1, 3, 12])):
            words = [w if rnd.random() > 0.015 * (family % 5) else rnd.choice(vocabulary) for w in base]
            rows.append((len(rows) * 7 % 1009, rnd.choice([" ", "\n", " \t "]).join(words)))
    check(spark, rows, k)


def test_families_that_share_much_but_not_enough(spark):
    """A passage shared by all puts them in common buckets below the threshold; chains of edits lie among them."""
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(12):
        own = [f"f{family}x{i}" for i in range(30)]
        for step in range(8):
            rows.append((len(rows), " ".join(passage + own)))
            own = [w if rnd.random() > 0.1 else f"n{rnd.random()}" for w in own]
    check(spark, rows, 2)


def test_large_open_bucket_is_compared_in_blocks(spark, monkeypatch):
    from lattika.llm import minhash

    monkeypatch.setattr(minhash, "VOLUME", 900)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(passage + [f"d{i // 2}x{j}" for j in range(35)] + [f"e{i}x{j}" for j in range(2)])) for i in range(40)]
    rows += [(100 + i, " ".join(passage + [f"d{i}x{j}" for j in range(35)] + [f"e{200 + i}x{j}" for j in range(2)])) for i in range(15)]
    rnd.shuffle(rows)
    check(spark, rows, 2)


def test_nulls_empty_ties_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A b  c d e\nf"), (9, None), (8, ""), (7, " \n "), (6, "one"), (4, "ONE"), (5, "q r s t u v w"), (2, "q r s t u v w")]
    check(spark, rows, 2)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_between_in_stripes(monkeypatch):
    """However the rows and shingles of a group are cut, the same components are joined."""
    import numpy as np
    import pandas as pd

    from lattika.llm import minhash

    rnd = random.Random(9)
    pool = list(range(60))
    sets = [np.array(sorted(rnd.sample(pool, rnd.choice([1, 4, 40, 45, 50])))) for _ in range(70)]
    members = pd.DataFrame({"rep": range(70), "component": [i // 3 for i in range(70)], "shingles": sets})
    outliers = members[members.component > 4].reset_index(drop=True)
    want = set()
    for a, c in zip(outliers.component, outliers.shingles):
        for b, d in zip(members.component, members.shingles):
            both = len(np.intersect1d(c, d))
            if a != b and 100 * both >= 80 * (len(c) + len(d) - both):
                want.add((a, b))
    own = dict(zip(members.rep, members.component))
    for stripes, columns in (((512, 4096), 4096), ((3, 5), 7)):
        monkeypatch.setattr(minhash, "STRIPES", stripes)
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        found = minhash.links_between(outliers, members, 80, True)
        assert {(own[a], own[b]) for a, b in zip(found.a, found.b)} == want and want
