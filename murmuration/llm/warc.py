"""Content-addressed WARC archive.

Two Parquet tables make an archive: `payloads` keeps the bytes of each distinct payload once under
its SHA-256, `records` keeps one exact header block per record with the digest it points to. A
record is rebuilt by a join of the two; the header says whether it carries the payload (response)
or names the record that does (revisit). Digests are verified: on writing, payloads of one SHA-256
must agree in SHA-1 and length; on reading, the stored bytes are digested again. A digest that stands
for other bytes fails the job and never merges two payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.llm import scratch

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 (32 characters), without Python: 5 bytes of hex at a time."""
    digest = F.sha1(payload)
    parts = []
    for g in range(4):
        value = F.conv(F.substring(digest, 10 * g + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(ALPHABET), (F.shiftright(value, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def _verified(ok: Column, what: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("string"))


@scratch.sized
def write_archive(pages: DataFrame, path: str, dedup_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html) into `path`/payloads and `path`/records.

    Of records with equal payloads of at least `dedup_from` bytes, that with the smallest page_id is
    the response (of equal rows, one of them) and the others revisit it; smaller payloads are all
    responses. Null html is an empty payload; null url an empty target; null page_ids come last. An
    empty table gives an empty archive. Other columns are ignored, whatever they are called. A payload is one value,
    so up to 2 GB; it is moved once for each task that reads a copy of it. Pages of equal page_id make records of
    equal id, each with its own header.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    described = F.length(payload).cast("long").alias("n"), F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1")
    # the tie-breaker among equal page_ids is drawn once, here; no payload is moved for it
    rows = scratch.materialize(pages.select("page_id", "url", *described, F.monotonically_increasing_id().alias("row")), "warc-rows")
    # one copy of the bytes by digest leaves each task that reads them
    held = pages.select(payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).groupBy("digest").agg(F.first("payload").alias("payload"))
    held.write.option("compression", "zstd").parquet(f"{path}/payloads")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    owners = rows.groupBy("digest").agg(F.min(order).alias("own"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("n").alias("x"), F.max("n").alias("y"))
    same = (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))
    owners = owners.select(_verified(same, "two payloads share a SHA-256", F.col("digest")).alias("of"), F.col("own.page_id").alias("own_page"), F.col("own.row").alias("own_row"))
    # written first: the join then stands right above two exchanges and is split where a payload is hot
    owners = scratch.materialize(owners, "warc-owners")
    linked = rows.join(owners, F.col("digest") == F.col("of"))
    revisit = (F.col("row") != F.col("own_row")) & (F.col("n") >= dedup_from)
    # line ends would break the header; they are kept as a URL writes them
    one_line = F.replace(F.replace(F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(f">{END}WARC-Date: {date}{END}WARC-Target-URI: "), one_line,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Refers-To: <urn:page:"), text("own_page"), F.lit(f">{END}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{END}X-Payload-Length: "), F.col("n").cast("string"),
        F.lit(f"{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string")),
        F.lit(END + END),
    )
    linked.select(header.cast("binary").alias("header"), "digest", revisit.alias("revisit")).write.parquet(f"{path}/records")


def read_archive(spark, path: str) -> DataFrame:
    """Every record rebuilt: header, block (the record's exact content), payload (a revisit's, through its
    response), and the payload's sha1 and length as the stored bytes have them.

    The stored bytes are digested again, once each, before the join repeats them: a payload whose SHA-256
    does not match fails the read. A reader that selects no bytes moves none. An empty archive gives no rows.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("kept"), F.col("payload").alias("bytes"))
    sound = _verified(F.sha2("bytes", 256) == F.col("kept"), "a stored payload is damaged", F.col("kept"))
    payloads = payloads.select(sound.alias("kept"), "bytes", base32_sha1(F.col("bytes")).alias("sha1"), F.length("bytes").cast("long").alias("length"))
    joined = spark.read.parquet(f"{path}/records").join(payloads, F.col("digest") == F.col("kept"))
    block = F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("bytes"))
    return joined.select("header", block.alias("block"), F.col("bytes").alias("payload"), "sha1", "length")


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as they stand in a .warc file: header, block and two line ends."""
    return records.select(F.concat("header", "block", F.lit(END + END).cast("binary")).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Ordinary gzipped .warc part files: the text writer puts bytes out as they are, and the two line ends that close a
    record are its line separator."""
    content = F.concat("header", "block").cast("string").alias("value")
    records.select(content).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def parse_headers(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url, from the header bytes."""
    head = F.col("header").cast("string")
    field = lambda name, more="": F.regexp_extract(head, rf"(?m)^{name}: {more}", 1)
    ident = lambda name: field(name, r"<urn:page:(.*)>\r\n")
    digest = _verified(field("WARC-Payload-Digest", r"sha1:(\w+)\r\n") == F.col("sha1"), "a payload does not match its record", F.col("sha1"))
    return records.select(
        ident("WARC-Record-ID").try_cast("bigint").alias("page_id"),
        F.col("length").alias("payload_bytes"),
        digest.alias("payload_digest"),
        field("WARC-Type", r"(\w+)\r\n").alias("record_type"),
        ident("WARC-Refers-To").try_cast("bigint").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
r AS (SELECT *, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS own, row_number() OVER (PARTITION BY b ORDER BY page_id) AS k FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN own END AS refers_to FROM r
"""


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parse_headers(read_archive(spark, path))
