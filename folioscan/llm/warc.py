"""Content-addressed WARC archive: payloads once by digest, headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import CLEANUP, settings, text_of

MIN_REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"
_END = "\r\n\r\n"
#: Fixed values of the format: what a response's block holds before its payload, and a revisit's profile.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(payload: Column) -> list[Column]:
    """The address is SHA-256 with the length; SHA-1 is what WARC headers carry."""
    size = F.octet_length(payload).cast("long")
    return [F.concat(F.sha2(payload, 256), F.lit("-"), size.cast("string")).alias("address"), F.sha1(payload).alias("sha1"), size.alias("payload_bytes")]


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: Column) -> Column:
    """<urn:uuid:...> of a page id, the same wherever it is made."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    return F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "<urn:uuid:$1-$2-3$3-8$4-$5>")


def _field(header: str, name: str, rx: str) -> Column:
    return F.regexp_extract(header, f"\r\n{name}: {rx}\r\n", 1)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes ``path/headers`` (one exact record header per page, and the address
    of its payload) and ``path/blobs`` (each payload once).

    Of records with equal payloads of at least 1000 bytes, that with the largest
    id is the response and the others are revisits of it; smaller payloads are
    always responses, though stored once all the same.  Winners and record types
    come from (id, address) rows alone; payload bytes are shuffled once, to meet
    by address, each task's repetitions having been dropped before.  A null
    payload is empty, a null url is left out of the header, line ends in a url are
    percent-encoded, null ids lose to any other; repeated rows give a record each
    (of one record id); an empty table gives empty tables.
    """
    payload = text_of(payload_col).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = p.select("page_id", "url", *_digests(F.col("payload")))
    win = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("address").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    typed = rows.join(win, "address", "left").withColumn("revisit", F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")))
    revisit = F.col("revisit")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("winner"))), _line("Refers-To-Page", F.col("winner").cast("string")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, refers).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.when(revisit, 0).otherwise(F.col("payload_bytes")) + len(HTTP)).cast("string")),
        F.lit("\r\n"),
    )
    with settings(pages.sparkSession, {CLEANUP: "true"}):
        p.select("payload", *_digests(F.col("payload"))).groupBy("address").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/blobs")
        typed.select("page_id", "address", header.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, address, record, payload): the WARC record byte for byte, and the payload
    at its address (a revisit's record has none of its own).  Many records of one
    address are a skewed join, which adaptive execution splits."""
    h, b = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/blobs")
    own = F.when(_field("header", "WARC-Type", "(\\w+)") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), F.lit(HTTP.encode()), own, F.lit(_END.encode()))
    return h.join(b, "address", "left").select("page_id", "address", record.alias("record"), "payload")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records say, one row each: header fields are parsed from the
    record, size and digest computed anew from the payload it stands for.  ``verified``
    holds where the record is framed as its header says, its own payload is the stored one
    (a revisit has none), the stored one has its address, and the digests agree."""
    text = F.col("record").cast("string")
    r = reconstruct(spark, path).withColumn("header", F.concat(F.substring_index(text, _END, 1), F.lit("\r\n")))
    r = r.withColumn("start", F.octet_length("header") + 3)
    length = F.coalesce(_field("header", "Content-Length", "(\\d+)").try_cast("int"), F.lit(-1))
    r = r.withColumns({"kind": _field("header", "WARC-Type", "(\\w+)"), "length": length, "block": F.substring("record", F.col("start"), length)})
    r = r.withColumn("own", F.substring("block", F.lit(len(HTTP) + 1), F.octet_length("block")))
    again = F.struct(*_digests(F.col("payload")))
    r = r.select("page_id", "header", "kind", "address", again.alias("d"), (
        (F.octet_length("record") == F.col("start") - 1 + F.col("length") + len(_END)) & F.col("block").startswith(F.lit(HTTP.encode()))
        & (F.col("own") == F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload")))
    ).alias("framed"))
    sound = F.col("framed") & (F.col("d.address") == F.col("address")) & (_field("header", "WARC-Payload-Digest", "sha1:(\\w+)") == F.col("d.sha1"))
    refers = F.nullif(_field("header", "Refers-To-Page", "(-?\\d+)"), F.lit("")).try_cast("long")
    return r.select("page_id", F.col("d.payload_bytes").alias("payload_bytes"), F.col("d.sha1").alias("payload_digest"), F.col("kind").alias("record_type"), refers.alias("refers_to"), sound.alias("verified"))
