"""WARC archives: writing, reading, and assembling captures from their records.

Every step is column expressions and joins. Records are bounded by Content-Length; the text
reader only cuts the archive where a record may start, and pieces of a payload that looks
like such a place are put together again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import broadcast_if_small, materialize, with_groups

CUT = "\r\n\r\nWARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT_BYTES = 1000


def _urn(*parts: Column) -> Column:
    """A record id that any task computes alike from the same capture."""
    h = F.md5(F.concat_ws("|", *parts))
    dashed = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *dashed), F.lit(">"))


def _record(headers: list[tuple[str, Column]], kind: str, block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    return F.concat(
        F.lit("WARC/1.1\r\n"), *lines, F.lit(f"Content-Type: {kind}\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row, as gzip WARC files.

    The payload is the column's text in UTF-8 (null: empty). Of rows with equal payloads of
    at least 1000 bytes the one with the largest id is a response and the others are revisits
    that refer to it; smaller payloads are all responses. Ids may be null or repeat, and every
    row is a capture of its own. Control
    characters in a url are written as spaces; a null url becomes ``urn:none``. An empty table
    writes an archive without records.

    Payload digests are SHA-1. Which row is the response is decided on narrow rows that are
    equal in SHA-256 over all bytes, with partial aggregation, so payloads are not shuffled
    by group; a group with very many rows is joined back by a broadcast of its own (with_groups).
    Rows that repeat id, url and payload are numbered, and their ids with them.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x1f\x7f]", " "), F.lit("urn:none"))
    page = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    plain = pages.select(
        F.col(id_col).cast("long").alias("id"), page.alias("page"), url.alias("url"), payload.alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload")})
    large = F.col("n") >= LEAST_REVISIT_BYTES
    content = F.when(large, F.sha2("payload", 256))
    digests = materialize(plain.select("id", "page", "url", "sha1", content.alias("content")), "warc-digests")
    again = materialize(digests.groupBy("page", "url", "sha1").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "warc-repeats")
    n_again = again.count()
    rows = plain.withColumn("copy", F.lit(0).cast("long"))
    if n_again:
        few = broadcast_if_small(again, n_again)
        keys = ["page", "url", "sha1"]
        one = plain.join(few, keys, "left_semi").groupBy(*keys).agg(F.first("id").alias("id"), F.first("payload").alias("payload"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
        every = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        rows = rows.join(few, keys, "left_anti").unionByName(every.select(*rows.columns))
    rows = rows.withColumn("response_id", _urn(F.lit("response"), "page", "url", "sha1", F.col("copy").cast("string")))
    # The largest id's first copy answers for the group.
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", _urn(F.lit("response"), "page", "url", "sha1", F.lit("0")).alias("response_id")))
    first = digests.where("content is not null").groupBy("content").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = materialize(first.select("content", "copies", F.col("best.response_id").alias("refers_to")), "warc-groups")
    rows = with_groups(rows.withColumn("content", content), first, "content", "copies")
    rows = rows.withColumn("is_revisit", F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("response_id")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"), F.lit("\r\n\r\n"),
    )
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    linked = [*common, ("WARC-Concurrent-To", F.col("response_id"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"))
    own = ("WARC-Record-ID", F.col("response_id"))
    response = _record([("WARC-Type", F.lit("response")), own, *common, digest], "application/http;msgtype=response", F.concat(http, "payload"))
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), own, *common, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.col("refers_to"))],
        "application/http;msgtype=response", http,
    )
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), "page", "url", "sha1", F.col("copy").cast("string"))), *linked],
        "application/http;msgtype=request",
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), "page", "url", "sha1", F.col("copy").cast("string"))), *linked],
        "application/warc-fields", F.concat(F.lit("page-id: "), "page", F.lit("\r\n")),
    )
    main = F.when(F.col("is_revisit"), revisit).otherwise(response)
    # Each record ends in CR LF CR and the writer adds the last LF.
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", CUT).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"),
    )
    return found.where(F.octet_length("value") > 0)


def _sized(pieces: DataFrame) -> DataFrame:
    """Adds the header's text and length, the stated and the present length of the block."""
    head = F.substring_index("value", "\r\n\r\n", 1)
    return (
        pieces.withColumn("head", head)
        .withColumn("head_n", F.octet_length("head"))
        .withColumn("stated", F.coalesce(F.expr("try_cast(" + r"regexp_extract(head, '(?im)^content-length:[ \\t]*([0-9]+)', 1)" + " as bigint)"), F.lit(0).cast("long")))
        .withColumn("present", F.octet_length("value").cast("long") - F.col("head_n") - 4)
    )


def _heads(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one file's pieces, the piece that each belongs to: a record lasts as long as it states."""
    rows = rows.sort_values(["block", "piece"])
    heads, head, missing = [], -1, 0
    for piece, n, stated, present in zip(rows["piece"], rows["n"], rows["stated"], rows["present"], strict=True):
        if missing > 0:
            missing -= len(CUT) + n
        else:
            head, missing = piece, stated - present
        heads.append(head)
    return pd.DataFrame({"piece": rows["piece"], "head_piece": heads})


def _rejoined(pieces: DataFrame) -> DataFrame:
    """Pieces of files that hold a cut within a record, put together by record.

    Only lengths go to the per-file fold; texts are joined by record afterwards.
    """
    light = _sized(pieces).select("file", "block", "piece", F.octet_length("value").cast("long").alias("n"), "stated", "present")
    heads = light.groupBy("file").applyInPandas(_heads, "piece long, head_piece long")
    grouped = pieces.join(heads, "piece").groupBy("head_piece").agg(
        F.array_sort(F.collect_list(F.struct("block", "piece", "value"))).alias("parts"), F.first("file").alias("file")
    )
    return grouped.select(F.array_join(F.col("parts.value"), CUT).alias("value"), "file")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: type, ids, links, headers and block (its exact bytes).

    Reads plain or compressed archives of WARC 1.0 or 1.1. A payload may contain anything,
    the text that starts a record too. A record without a Content-Length has an empty block.
    """
    pieces = _fragments(spark, path)
    sized = _sized(pieces)
    broken = sized.where("present < stated").select("file").distinct()
    if broken.isEmpty():
        whole = sized
    else:
        rest = sized.join(broken, "file", "left_anti").select("value", "file")
        whole = _sized(rest.unionByName(_rejoined(pieces.join(broken, "file", "left_semi"))))

    def header(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found == "", None).otherwise(F.trim(found))

    body = F.col("value").cast("binary").substr(F.col("head_n") + 5, F.col("stated").cast("int"))
    return whole.select(
        F.lower(header("WARC-Type")).alias("type"), header("WARC-Record-ID").alias("record_id"),
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1).alias("concurrent_to"),
        header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("uri"), header("WARC-Date").alias("date"),
        header("WARC-Payload-Digest").alias("payload_digest"), header("Content-Type").alias("content_type"),
        body.alias("block"),
    )


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    ``response`` is the response, revisit or resource record. Requests and metadata records
    belong to it when either names the other in WARC-Concurrent-To, or when a metadata record
    names a request that does. Repeated record ids count once; records that link to nothing
    are left out, and a response without others has empty lists.
    """
    record = F.struct("type", "record_id", "refers_to", "uri", "date", "payload_digest", "content_type", "block")
    main = (
        records.where(F.col("type").isin("response", "revisit", "resource") & F.col("record_id").isNotNull())
        .groupBy("record_id").agg(F.first(record).alias("response"), F.first("concurrent_to").alias("concurrent_to"))
    )
    others = (
        records.where(F.col("type").isin("request", "metadata") & F.col("record_id").isNotNull())
        .groupBy("record_id").agg(F.first(record).alias("record"), F.first("concurrent_to").alias("concurrent_to"))
    )
    ids = main.select(F.col("record_id").alias("capture_id"))
    stated = others.select("record_id", F.explode("concurrent_to").alias("target"))
    forward = stated.join(ids, stated["target"] == ids["capture_id"]).select("record_id", "capture_id")
    backward = main.where(F.size("concurrent_to") > 0).select(
        F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")
    )
    direct = forward.unionByName(backward)
    through = stated.join(direct.withColumnRenamed("record_id", "via"), F.col("target") == F.col("via")).select("record_id", "capture_id")
    links = direct.unionByName(through).distinct()
    attached = (
        links.join(others, "record_id").groupBy("capture_id")
        .agg(
            F.collect_list(F.when(F.col("record.type") == "request", F.col("record"))).alias("requests"),
            F.collect_list(F.when(F.col("record.type") == "metadata", F.col("record"))).alias("metadata"),
        )
    )
    none = F.array().cast(attached.schema["requests"].dataType)
    return main.join(attached, main["record_id"] == attached["capture_id"], "left").select(
        F.col("record_id").alias("capture_id"), "response",
        F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"),
    )


def http_payload(block: Column) -> Column:
    """The bytes after the HTTP header of a response's block."""
    head = F.substring_index(block.cast("string"), "\r\n\r\n", 1)
    return block.substr(F.octet_length(head) + 5, F.octet_length(block))


def payload_table(assembled: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to (a page id), url.

    A revisit takes the length and digest from the payload of the response that it refers to.
    """
    page = F.expr(r"try_cast(regexp_extract(cast(metadata[0].block as string), '(?im)^page-id:[ \\t]*(-?[0-9]+)', 1) as bigint)")
    payload = http_payload(F.col("response.block"))
    own = assembled.select(
        "capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.uri").alias("url"),
        F.col("response.refers_to").alias("target"), F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha1"),
    )
    own = materialize(own, "captures")
    response = own.where("record_type <> 'revisit'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    revisits = own.where("record_type = 'revisit'").select("page_id", "url", "target")
    asked = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("times"))
    source = own.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"))
    answered = with_groups(revisits, materialize(asked.join(source, "target"), "warc-answers"), "target", "times")
    return response.unionByName(answered.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", "url"))
