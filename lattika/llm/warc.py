"""WARC archives: writing with revisit records, reading with boundary-chain verification (operator 7).

Writing goes through Spark's text sink, one file per task, so the output committer keeps lost or repeated tasks out.
Reading cuts the files at every occurrence of the record magic, wherever a task's split lies: each piece is a
candidate record that names its successor's offset through its Content-Length. Candidates whose successor is the very
next candidate form runs; pointer jumping over the runs, from offset 0 of each file, keeps the reachable records
and rejects magic inside payloads. Only offsets and digests travel; payload bytes are hashed where they are read, except in
the rare records whose payload holds the magic, which are read once more and put together. The second read finds a piece by the
SHA-256 of its bytes, as its place depends on how a read is split among tasks, which may change in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattika.llm.common import materialize, scratch_path, table

# Fixed values of the format.
MAGIC, PROFILE = "WARC/1.1\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary: each five hexadecimal digits are four base32 digits."""
    hexed = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.upper(F.concat(*[part(i) for i in range(8)])), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _header(name: str, value: Column) -> Column:
    """A header line; absent where the value is null, and on one line whatever the value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def record_id(page_id: Column) -> Column:
    return F.regexp_replace(F.md5(page_id.cast("string")), r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one record per row of `pages` (page_id, url, html) under `path`.

    The payload is the html in UTF-8, a null html being empty. Of the rows whose payloads are equal and at least
    `least_bytes` long, the one with the smallest page_id is a response and rows with other ids revisit it without a payload. Rows
    without page_id are responses unless a row with one has their payload. Payloads of any length are written whole; columns other than these three are not read.
    An empty table writes no record.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads are dealt out by page, not by digest, so that equal payloads are many tasks; only pages of repeated payloads are looked up
    again = narrow.join(first, "digest").distinct().select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "first")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), record_id(F.coalesce(c.cast("string"), F.lit("null"))), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.when(revisit, F.col("first"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between occurrences of the magic: file, block, place (rising along a file within its block, in this read alone), value and piece (its hash)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value")).withColumn("piece", F.sha2("value", 256))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per occurrence of the magic: file, block, place, piece, at (its offset), next (the offset that its record names), and what the record says.

    whole: the record ends where the next magic begins, so its payload's digest is known here.
    """
    pieces = _pieces(spark, path)
    size = F.octet_length("value")
    # positions are bytes: the head is looked for in a single-byte reading of the piece
    latin = F.decode(F.col("value"), "iso-8859-1")
    split = F.instr(latin, "\r\n\r\n")
    rows = pieces.select("file", "block", "place", "piece", size.cast("long").alias("size"), "value", split.alias("split"), F.substring(latin, F.lit(1), split).alias("head"))
    rows = rows.withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1), '') AS BIGINT)"))
    rows = rows.withColumn("length", F.when(F.col("split") > 0, F.col("length")))
    whole = F.col("split") + 3 + F.col("length") + 4 == F.col("size")
    payload = F.substring(F.col("value"), F.col("split") + 4, F.col("length").cast("int"))
    rows = rows.select(
        "file", "block", "place", "piece", "size", "split", "length",
        F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(whole, base32_sha1(payload)).alias("digest"),
        _field("WARC-Type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(head, '(?im)^X-Page-Id:[ \\\\t]*(-?[0-9]+)', 1), '') AS BIGINT)").alias("page_id"),
        F.expr("try_cast(nullif(regexp_extract(head, '(?im)^X-Refers-To-Page-Id:[ \\\\t]*(-?[0-9]+)', 1), '') AS BIGINT)").alias("refers_to"),
        F.regexp_extract("head", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:(\w+)", 1).alias("said"),
    )
    along = Window.partitionBy("file").orderBy("block", "place")
    magic = F.lit(len(MAGIC)).cast("long")
    before = F.sum(F.col("size") + magic).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", before - magic)  # null for what lies before a file's first magic
    return rows.withColumn("next", F.when(F.col("length").isNotNull(), F.col("at") + magic + F.col("split") + 3 + F.col("length") + 4)).where("at IS NOT NULL")


def reachable(found: DataFrame) -> DataFrame:
    """file, run, entry: the runs of linked candidates that the chain from offset 0 enters, and where.

    found: file, run, at, next. A run's candidates name each other in turn, so its last one's successor is where any of them leads.
    """
    runs = found.groupBy("file", "run").agg(F.max_by("next", "at").alias("exit"))
    spots = found.select("file", F.col("at").alias("exit"), F.col("run").alias("to"))
    hops = materialize(runs.join(spots, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "hops")
    reached = found.where("at = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    if hops.isEmpty():
        return reached
    reached, count = materialize(reached, "reached"), -1
    while count != (count := reached.count()):
        step = reached.select("file", "run").join(hops, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = materialize(reached.union(step).distinct(), "reached")
        onward = hops.select("file", F.col("run").alias("to"), F.col("to").alias("further"), F.col("entry").alias("then"))
        hops = materialize(hops.join(onward, ["file", "to"]).select("file", "run", F.col("further").alias("to"), F.col("then").alias("entry")), "hops")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that the chain of its file reaches: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are those of the full payload, for a revisit those of the response with its digest. A record cut
    short by the end of its file is left out, and so is all behind a broken header; an empty folder of archives gives no rows.
    """
    found = materialize(candidates(spark, path), "candidates")
    along = Window.partitionBy("file").orderBy("at")
    breaks = F.when(F.lag("next").over(along) == F.col("at"), 0).otherwise(1)
    found = found.withColumn("break", breaks).withColumn("run", F.sum("break").over(along))
    entered = reachable(found.select("file", "run", "at", "next"))
    marked = found.join(entered, ["file", "run"], "left").withColumn("record", F.when(F.col("at") >= F.col("entry"), F.col("at")))
    marked = materialize(marked.withColumn("record", F.last("record", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))), "records")
    records = marked.where("record = at AND length IS NOT NULL")
    plain = records.where("whole").select("page_id", "length", "digest", "record_type", "refers_to", "said")

    torn = records.where("NOT whole").select("file", "record", "split", "length", "page_id", "record_type", "refers_to", "said")
    if not torn.isEmpty():
        parts = marked.join(torn.select("file", "record"), ["file", "record"], "left_semi").select("file", "piece", "at", "record")
        again = _pieces(spark, path).join(parts.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.first("value").alias("value"))
        parts = parts.join(again, "piece").select("file", "record", "at", "value")
        bodies = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        joined = F.aggregate("parts", F.unhex(F.lit("")), lambda whole, part: F.concat(whole, F.lit(MAGIC).cast("binary"), part["value"]))
        bodies = bodies.select("file", "record", joined.alias("bytes"))
        payload = F.substring(F.col("bytes"), F.col("split") + 4 + len(MAGIC), F.col("length").cast("int"))
        complete = F.octet_length("bytes") >= F.col("split") + 3 + len(MAGIC) + F.col("length") + 4
        plain = plain.union(torn.join(bodies, ["file", "record"]).where(complete).select("page_id", "length", base32_sha1(payload).alias("digest"), "record_type", "refers_to", "said"))

    responses = plain.where("record_type = 'response'")
    revisits = plain.where("record_type = 'revisit'")
    full = responses.groupBy(F.col("digest").alias("said")).agg(F.min("length").alias("bytes"))
    own = responses.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = revisits.join(full, "said").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", "refers_to")
    return own.union(again)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through archives in the shared folder."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP7_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
digests AS (
  SELECT page_id, octet_length(payload) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM payloads),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM digests GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (payload_digest)
"""
