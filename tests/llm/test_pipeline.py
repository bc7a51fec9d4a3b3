import random
import re

import numpy as np

import corpus_pipeline
from lattika.llm.tokenization import public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string"


def documents():
    rnd = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "ze"]}
    rows = []
    for i in range(160):
        lang = rnd.choice(sorted(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(4)) for _ in range(rnd.randrange(30, 90))]
        if i % 20 == 0:
            words.insert(5, "password=hunter2secret")
        rows.append((len(rows), " ".join(words), lang, f"s{i % 4}"))
        if i % 10 == 0:  # copies, exact and near
            rows.append((len(rows), " ".join(words), lang, "s1"))
            rows.append((len(rows), " ".join([*words, "ende"]), lang, None))
    rows += [(len(rows), None, None, "s1"), (len(rows) + 1, "12 34", None, "s2"), (len(rows) + 2, "", "aa", None)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    data = documents()
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", "y") for i, t, lang, s in data], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    sets = lambda t: {tuple(w) for w in zip(*(t.lower().split()[k:] for k in range(5)))}

    def step(name, docs):
        out = f"file://{tmp_path}/{name}"
        stages[name](spark, docs, "").write.parquet(out)
        return spark.read.parquet(out)

    first = step("language", df)
    assert first.columns == df.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) == {i for i, t, *_ in data if t and re.search("[a-z]", t)}

    second = step("near_duplicates", first)
    groups, label = {}, {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            a, b = sets(kept[i].text), sets(kept[j].text)
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                label[j] = min(label[j], label[i])
    assert {r.doc_id for r in second.collect()} == {i for i in label if label[i] == i}

    third = step("secrets", second)
    assert third.columns == df.columns
    clean = {r.doc_id: r for r in third.collect()}
    assert all(clean[r.doc_id].text == r.text.replace("password=hunter2secret", "[SECRET]") for r in second.collect())
    assert all(r.n_chars == len(r.text) for r in clean.values())

    fourth = step("mixture", third)
    assert fourth.columns == df.columns
    taken = {}
    for r in fourth.collect():
        words, whole = r.text.split(), clean[r.doc_id].text.split()
        assert words == whole[: len(words)]
        taken[r.source] = taken.get(r.source, 0) + len(words)
    sizes = {s: sum(len(r.text.split()) for r in clean.values() if r.source == s) for s in {r.source for r in clean.values()}}
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not above:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in above}
        left, open_ = left - sum(2 * sizes[s] for s in above), open_ - above
    assert all(abs(taken.get(s, 0) - target[s]) <= 64 for s in order)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path())
    pieces = step("packing", fourth).collect()
    got = sorted(x for p in pieces for x in np.frombuffer(p.ids, np.uint32).tolist())
    assert got == sorted(x for r in fourth.collect() for x in [*library.encode(r.text).ids, 1])


def test_run_gives_what_the_last_stage_wrote(spark, tmp_path):
    data = documents()[:40]
    df = spark.createDataFrame([(i, t, lang, s, 0, "x", "y") for i, t, lang, s in data], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length > 0").count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_goes_by_the_language_found(spark, tmp_path):
    rows = [(i, t, None if i % 7 == 0 else lang, s, 0, "x", "y") for i, t, lang, s in documents()]
    stages = dict(corpus_pipeline.STAGES)
    found = {r.doc_id: r.lang for r in stages["language"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    told = {i: lang for i, t, lang, s in documents()}
    assert set(found.values()) == {"aa", "bb"} and sum(found[i] == told[i] for i in found) > 0.9 * len(found)
    docs = spark.createDataFrame([(i, t, found[i], s, 0, "x", "y") for i, t, _, s, *_ in rows if i in found], SCHEMA).coalesce(1)
    pieces = stages["packing"](spark, docs, "").collect()
    assert {(p.doc_id, p.lang) for p in pieces} == set(found.items())
    assert [(p.lang, p.length, p.sequence_id) for p in pieces] == sorted((p.lang, p.length, p.sequence_id) for p in pieces)


def test_packing_forgets_what_an_executor_cannot_hold(spark):
    from lattika.llm.packing import pack
    from lattika.llm.tokenization import tokenizer

    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join("%x" % rnd.getrandbits(40) for _ in range(60)), "aa") for i in range(120)], "doc_id long, text string, lang string").coalesce(1)
    whole = pack(docs).collect()
    assert [tuple(p)[:7] for p in sorted(pack(docs, by="lang", texts=(7, 2_000), remembered=5_000).collect(), key=lambda p: p.sequence_id)] == sorted(map(tuple, whole), key=lambda p: p[5])
    small = tokenizer(public_path(), 5_000)
    for i in range(20):
        small.encode([f"{i}a{k}" for k in range(60)])
        assert small.held < 5_000 + 60 * 200
    tokenizer(public_path())
