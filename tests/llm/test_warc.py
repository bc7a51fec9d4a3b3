import base64
import hashlib
import random

from lattika.llm import warc
from lattika.llm.warc import MAGIC, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def brute(rows):
    first, out = {}, []
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in rows:
        data = (html or "").encode()
        home = first.get(html or "")
        revisit = home is not None and i != home
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", home if revisit else None))
    return sorted(out, key=str)


def check(spark, rows, path, **how):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA).repartition(2)
    write_archives(df, path, **how)
    found = read_archives(spark, path).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def fake(payload):
    return f"{MAGIC}WARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n"


def test_magic_inside_payloads_and_splits(spark, tmp_path):
    rnd = random.Random(1)
    pieces = ["text é ", MAGIC, fake("inner"), fake(""), "\r\n\r\n", MAGIC + "WARC-Type: response\r\nContent-Length: 7\r\n\r\n", "WARC/1.", "plain " * 50]
    rows = [(i, f"http://h/{i}", "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9)))) for i in range(120)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        check(spark, rows, f"file://{tmp_path}/a", compression="none")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    check(spark, rows, f"file://{tmp_path}/b")


def test_second_read_is_split_otherwise(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"{i} " * (i % 50) + (MAGIC + fake(str(i % 3)) if i % 4 == 0 else "")) for i in range(120)]
    read, before, sizes = warc._pieces, spark.conf.get("spark.sql.files.maxPartitionBytes"), iter(["2000", "900"])

    def pieces(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return read(spark, path)

    monkeypatch.setattr(warc, "_pieces", pieces)
    try:
        check(spark, rows, f"file://{tmp_path}/f", compression="none")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nulls_ties_and_headers(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u\r\nX-Page-Id: 7", "same"), (1, "u", "same"), (None, "u", "same"), (None, None, "alone"), (5, None, None), (6, "", ""), (2, "u", "x" * 100_000)]
    check(spark, rows, f"file://{tmp_path}/c")


def test_empty_table(spark, tmp_path):
    check(spark, [], f"file://{tmp_path}/d")


def test_short_payloads_are_not_revisited(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abc", "", ""), (4, "u", "abc", "", "")], SCHEMA)
    write_archives(df, f"file://{tmp_path}/e", least_bytes=3)
    assert sorted((r.page_id, r.record_type) for r in read_archives(spark, f"file://{tmp_path}/e").collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
