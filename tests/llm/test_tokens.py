import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm.packing import pack, write_buckets
from lattika.llm.token_files import SequenceFile, read_token_files, write_token_files
from lattika.llm.tokenization import PieceTokenizer, public_path

SCHEMA = "doc_id long, text string, start string, ids int"
ODD = ["", " ", "  a", "a  b", "a   b \n c", "x\n\ny z ", "it's  we'll\tgo", "a b c", "a \x1c b", "<|endoftext|> hi", "a <|endoftext|> b<|endoftext|>", "<|endof", "text|>", " é   è  x  ", "a​ b", "\n", " \n \n", "1 22 333 don't 's", "😀 😀😀", None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


def texts(n=60, seed=4):
    rnd = random.Random(seed)
    words = ["the", "of", "naïve", "Straße", "don't", "x1", "42", "\n", "  ", "end.", "\t"]
    return ODD + [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 50, 3000]))) for _ in range(n)]


def ids(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def rows(spark, seed=1):
    found = [(i * 13 % 101, t, "x", 1) for i, t in enumerate(texts())] + [(None, "no id", "x", 1), (13, "twice", "x", 1)]
    random.Random(seed).shuffle(found)
    return found, spark.createDataFrame(found, SCHEMA).repartition(3)


def test_ids_equal_the_library(library, monkeypatch):
    from lattika.llm import tokenization

    monkeypatch.setattr(tokenization, "CACHE_BYTES", 2_000)
    ours = PieceTokenizer(public_path())
    for segment, remembered in ((1 << 20, 64), (1 << 20, 3), (50, 64), (7, 0)):
        monkeypatch.setattr(tokenization, "SEGMENT", segment)
        monkeypatch.setattr(tokenization, "REMEMBERED", remembered)
        flat, counts = ours.encode(texts(), 7)
        assert np.split(flat, np.cumsum(counts)[:-1])[5].tolist() == ids(library, texts()[5], 7)
        assert flat.tolist() == [i for t in texts() for i in ids(library, t, 7)]


def unspaced(n, seed=2):
    """Runs without a space: ideographs with and without marks, digits and letters of code, white space of other kinds, added tokens."""
    rnd = random.Random(seed)
    parts = ["\u6c49\u5b57", "\u3002", "abc", "Q7", "==", "+/", "\n\n", "\t", "'s", "\u00a0", "{}", "9" * 12, "\u3042" * 30, " "]
    return "".join(rnd.choice(parts[:-1]) if rnd.random() < 0.999 else "<|endoftext|>" for _ in range(n))


def test_long_texts_without_spaces(library, monkeypatch):
    from lattika.llm import tokenization

    for segment in (40, 1_000):
        monkeypatch.setattr(tokenization, "SEGMENT", segment)
        for n in (5, 300, 4_000):
            found = PieceTokenizer(public_path()).encode([unspaced(n), unspaced(n, 3)], 7)[0].tolist()
            assert found == ids(library, unspaced(n), 7) + ids(library, unspaced(n, 3), 7)


def test_memory_does_not_follow_what_was_read(library):
    """Thousands of different texts without a space leave nothing behind, and a long text with an added token is cut."""
    rnd = random.Random(9)
    ours = PieceTokenizer(public_path())
    for _ in range(200):
        one = "".join(chr(rnd.randint(0x4E00, 0x9F00)) for _ in range(2_000))
        ours.encode([one], 7)
    assert len(ours.index) == 0 and sum(map(len, ours.ids)) == 0
    long = ("some words, and 12 more " * 100_000) + "<|endoftext|>" + "x" * 50_000
    flat, counts = ours.encode([long], 7)
    assert flat.tolist() == ids(library, long, 7) and counts[0] == len(flat) and ours.held < 10_000


def test_packing(spark, library):
    found, df = rows(spark)
    pieces = pack(df, longest=256).collect()
    assert all(p.length & (p.length - 1) == 0 and p.length <= 256 and p.offset == 0 for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    groups = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id)):
        groups.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = sorted(([i] + ids(library, t, 1) for i, t, *_ in found), key=str)
    whole = []
    for (doc, total), parts in groups.items():
        at = 0
        for p in parts:
            if p.start == 0:
                whole.append([doc])
                at = 0
            assert p.start == at
            whole[-1] += np.frombuffer(p.ids, np.uint32).tolist()
            at += p.length
    assert sorted(whole, key=str) == want


def test_buckets_hold_equal_lengths(spark, tmp_path):
    write_buckets(pack(rows(spark)[1]), f"file://{tmp_path}/b")
    assert spark.read.parquet(f"file://{tmp_path}/b").where("bucket <> length").count() == 0


def test_token_files(spark, library, tmp_path):
    found, df = rows(spark)
    manifest = write_token_files(df, f"file://{tmp_path}/t", length=32)
    back = read_token_files(manifest).withColumn("crc", F.crc32("ids")).collect()
    assert len(back) == len(found)
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back if r.doc_id is not None] == sorted(i for i, *_ in found if i is not None)
    at, by_id = 0, {}
    for i, t, *_ in found:
        by_id.setdefault(i, []).append(ids(library, t, 2))
    for r in back:
        assert r.start == at
        at += r.n_tokens
        got = np.frombuffer(r.ids, np.uint32).tolist()
        assert got in by_id[r.doc_id] and len(got) == r.n_tokens and r.crc == zlib.crc32(np.array(got, np.uint32).tobytes())
    for m in manifest.collect():
        file = SequenceFile(m.file)
        assert file.ids().tolist() == [x for r in back if m.first_token <= r.start < m.first_token + m.tokens for x in np.frombuffer(r.ids, np.uint32).tolist()]
        view, mask = file[0]
        assert len(view) == len(mask) == 32 and not view.flags.owndata


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty).count() == 0
    assert read_token_files(write_token_files(empty, f"file://{tmp_path}/e")).count() == 0
