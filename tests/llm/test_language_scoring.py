import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm import scoring
from lattika.llm.language import held_out, identify, train
from lattika.llm.shingles import word_hashes

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "ö"], "cc": ["é", "que", "tion", "oui"]}
SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"


def documents(n=600, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.choice([4, 20, 300]))]
        out.append((i, " ".join(words), lang if i % 7 else None, lang))
    return out


def test_held_out_accuracy(spark):
    data = documents()
    odd = [(9001, None), (9002, ""), (9003, " 12 .,# \n"), (None, "ka lo mi tu lo ka mi")]
    df = spark.createDataFrame([(i, t, lang, 1, "s") for i, t, lang, _ in data] + [(i, t, None, 1, "s") for i, t in odd], SCHEMA)
    network = train(df)
    found = identify(df, network).withColumn("held", held_out()).collect()
    assert len(found) == len(data) + len(odd)
    truth = {i: lang for i, _, _, lang in data}
    tested = [r for r in found if r.held and r.doc_id in truth]
    assert len(tested) > 80 and sum(truth[r.doc_id] == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (9001, 9002, 9003)} == dict.fromkeys((9001, 9002, 9003), "und")
    again = identify(df, train(df)).collect()
    assert sorted(map(str, again)) == sorted(str(r).replace(f", held={r.held}", "") for r in found)


def test_network_against_plain_loops():
    """Every filter at every place of every window, one multiplication after the other: greatest response, rectifier, softmax."""
    from lattika.llm import language

    rng = np.random.default_rng(3)
    network = language.ByteNetwork(["a", "b", "c"])
    network.p["b"] = rng.normal(0, 0.1, network.p["b"].shape).astype(np.float32)
    texts = ["Straße 12!", "the end of it", "ab", "Été à l'œuvre", "x" * 40]
    length = 24
    windows = np.zeros((len(texts), length), np.int32)
    for i, t in enumerate(texts):
        part = [language._SYMBOL[b] for b in t.encode()[:length]]
        windows[i, : len(part)] = part
    found = network.predict(windows, step=2)
    for x, probabilities in zip(windows, found):
        pooled = []
        for k in language.WIDTHS:
            w = network.p[f"w{k}"].astype(float)
            for f in range(language.FILTERS):
                responses = []
                for at in range(length - k + 1):
                    total = 0.0
                    for o in range(k):
                        for symbol in range(language.SYMBOLS):
                            if symbol == x[at + o]:  # the one-hot input is 1 here and 0 elsewhere
                                total += w[o, symbol, f]
                    responses.append(total)
                pooled.append(max(responses))
        hidden = [max(0.0, p + float(b)) for p, b in zip(pooled, network.p["b"])]
        z = [sum(h * float(v) for h, v in zip(hidden, network.p["v"][:, c])) + float(network.p["c"][c]) for c in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(probabilities, [v / sum(e) for v in e], atol=1e-4)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, 1, "s")], SCHEMA)
    assert train(df) is None and [r.lang_pred for r in identify(df, None).collect()] == ["und"]
    assert identify(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_scores_against_brute_force(spark):
    """With all words and pairs in the model, losses equal those counted by hand."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["É", "x"]
    rows = [(i, " ".join(rnd.choice(words[: 15 + i % 27]).upper() if rnd.random() < 0.1 else rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(80)]
    rows += [(500, None), (501, " \n"), (None, "w1 w2"), (3, "w1 w1")]
    target = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    models = scoring.fit(docs, spark.createDataFrame(target, schema))
    found = scoring.score(docs, models).collect()

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ones, twos, seen = ({k: Counter() for k in "bt"} for _ in range(3))
    for kind, texts in (("b", rows), ("t", target)):
        for _, t in texts:
            w = split(t)
            ones[kind].update(w)
            twos[kind].update(zip([None, *w], w))
            seen[kind].update([None, *w][: len(w)])
    v, k = len(ones["b"]) + 1, scoring.PRIOR
    base = lambda w: (ones["b"][w] + 1) / (sum(ones["b"].values()) + v)
    uni = {m: lambda w, m=m: (ones[m][w] + k * v * base(w)) / (sum(ones[m].values()) + k * v) for m in "bt"}
    want = []
    for i, t in rows:
        w = split(t)
        losses = [-sum(math.log((twos[m][a, b] + k * uni[m](b)) / (seen[m][a] + k)) for a, b in zip([None, *w], w)) / len(w) if w else None for m in "tb"]
        want.append((i, len(w), *losses))
    for r, expected in zip(sorted(found, key=lambda r: str((r.doc_id, r.n_tokens, r.target_loss))), sorted(want, key=str)):
        assert (r.doc_id, r.n_tokens) == expected[:2]
        assert (r.target_loss, r.background_loss) == (pytest.approx(expected[2]), pytest.approx(expected[3]))
        assert r.score is None if r.n_tokens == 0 else r.score == pytest.approx(expected[2] - expected[3])


def test_bounded_model(spark, monkeypatch):
    monkeypatch.setattr(scoring, "VOCABULARY", 5)
    monkeypatch.setattr(scoring, "PAIRS", 7)
    docs = spark.createDataFrame([(i, f"a b a b c d e{i} f{i}") for i in range(30)], "doc_id long, text string")
    models = scoring.fit(docs, docs.where("doc_id < 3"))
    assert len(models.words) <= 5 and len(models.pairs) <= 7
    rows = scoring.score(docs, models).collect()
    assert all(math.isfinite(r.score) for r in rows) and len(rows) == 30


@pytest.mark.parametrize("other", [False, True])
def test_rare_words_and_pairs_count(spark, monkeypatch, other):
    """What is broadcast of the models does not change a score, nor do buckets."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words[: 3 + i % 57]) for _ in range(rnd.randrange(50)))) for i in range(90)] + [(None, "w1 w2"), (3, "w1 w1"), (3, "w1 w1"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.where("doc_id % 3 = 0")
    scored = spark.createDataFrame([*rows[:20], (900, "never w1 seen never w2")], docs.schema) if other else docs
    run = lambda: sorted((tuple(r) for r in scoring.score(scored, scoring.fit(docs, target)).collect()), key=lambda r: str(r[:2]))
    want = run()
    monkeypatch.setattr(scoring, "VOCABULARY", 8)
    monkeypatch.setattr(scoring, "PAIRS", 6)
    monkeypatch.setattr(scoring, "BUCKET_WORDS", 200, raising=False)
    found = run()
    assert len(found) == len(want) == scored.count()
    if not other:
        found += sorted((tuple(r) for r in scoring.score(docs, scoring.fit(docs, target), F.expr("doc_id % 3 = 0")).collect()), key=lambda r: str(r[:2]))
    for r, expected in zip(found, want * 2):
        assert r[:2] == expected[:2]
        assert all(x == pytest.approx(y) for x, y in zip(r[2:], expected[2:]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scoring.score(empty, scoring.fit(empty, empty)).count() == 0


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    """However bytes are cut, words hash alike, very long ones too."""
    import pyarrow as pa

    from lattika.llm import shingles

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab É\n") for _ in range(n)) for n in (0, 1, 50, 400)] + ["x" * 300, None, " " * 90, "end"]
    want = [a.tolist() for a in word_hashes(pa.array(texts))]
    for size in (1, 7, 64):
        monkeypatch.setattr(shingles, "CHUNK", size)
        assert [a.tolist() for a in word_hashes(pa.array(texts))] == want
    monkeypatch.undo()
    hashes, counts = word_hashes(pa.array(["word " * 4_000_000, "word"]))
    assert counts.tolist() == [4_000_000, 1] and len(set(hashes.tolist())) == 1


def test_long_text_has_a_language(spark):
    """20 million characters, of which only the windows at hand are held as symbols."""
    data = documents(300)
    df = spark.createDataFrame([(i, t, lang, 1, "s") for i, t, lang, _ in data], SCHEMA)
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("kalomitu "), 2_200_000).alias("text"))
    assert [r.lang_pred for r in identify(long, train(df)).select("lang_pred").collect()] == ["aa"]
