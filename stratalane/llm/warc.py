"""WARC records, and revisits that a server answered with "not modified" resolved to the response they stand for.

A revisit (status 304) holds no body. It is resolved by an as-of join on the canonical URL: the latest full response
captured before it gives the body, if the validators agree (entity tags compared weakly where the revisit has one, else
the dates of last modification; a revisit with neither is taken on trust). The headers of the result are the response's,
overlaid with those that a 304 may renew.

The as-of join carries validators and headers only, never bodies. Rows of one URL are cut into SLICES stretches of time of
about equal numbers of captures, each a window of its own. What is the latest response before a stretch comes from a table
with one row a URL and stretch that holds captures, so nothing is carried to stretches without any. So a URL with a
third of all captures is dealt to many tasks, whatever dates stray far from the others.

Defined results: null URLs are one canonical URL of their own, the empty one; records without a time, or with a date that
can't be read, never match and count as unresolved; times count to the microsecond; of responses at one time the one of
the greatest record_id is the latest; equal rows get equal rows; a map of headers that is null counts as empty, header
names compare in lower case, and the values of names that differ in case alone are joined by commas, in order of these names; an empty table gives
an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StringType

SLICES = 128
#: What a 304 may renew in the stored response.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"
RECORD_SCHEMA = "warc_type string, record_uri string, target_uri string, warc_date string, refers_to string, http_status int, http_headers map<string,string>, payload binary"


def canonical(url: Column) -> Column:
    """Host in lower case without www, user or default port; path without empty steps; sorted query without tracking."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?([\s\S]*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _instant(records: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp, a date string or fractional seconds; whole numbers are ticks of their own."""
    kind = records.schema[name].dataType
    if isinstance(kind, IntegralType):
        return F.col(name).cast("long")
    if isinstance(kind, FractionalType):
        return (F.col(name) * 1_000_000).cast("long")
    return F.unix_micros(F.expr(f"try_cast(`{name}` AS timestamp)") if isinstance(kind, StringType) else F.col(name).cast("timestamp"))


def _lowered(headers: Column) -> Column:
    entries = F.array_sort(F.map_entries(headers))
    of = lambda k: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == k), lambda e: e["value"]), ", ")
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    return F.coalesce(F.map_from_arrays(names, F.transform(names, of)), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit of records (record_id, url, captured_at, status, etag, last_modified, headers).

    Returns record_id, canonical_url, response_id (null unless resolved), verdict and the merged headers.
    """
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("u"), _instant(records, "captured_at").alias("t"), (F.col("status") == 304).alias("revisit"),
        "etag", "last_modified", _lowered(F.col("headers")).alias("headers"), "status",
    ).where("revisit OR status BETWEEN 200 AND 299")
    cuts = rows.agg(F.percentile_approx("t", [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("slice", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("t"))), F.lit(-1)))
    full = F.when(~F.col("revisit") & F.col("t").isNotNull(), F.struct("t", "record_id", "etag", "last_modified", "headers"))
    rows = rows.withColumn("full", full)
    # Rows of one time see only earlier times; within a window the frame is by time, not by row.
    here = Window.partitionBy("u", "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    order = F.struct(F.col("full.t"), F.col("full.record_id"))
    ended = rows.groupBy("u", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("full"), F.max("revisit").alias("asked"))
    sooner = Window.partitionBy("u").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ended.select("u", "slice", "asked", F.last("full", ignorenulls=True).over(sooner).alias("carried")).where("asked AND carried IS NOT NULL").drop("asked")
    seen = rows.withColumn("found", F.max(F.when(F.col("full").isNotNull(), F.struct(F.col("full.t"), F.col("full.record_id"), F.col("full.etag"), F.col("full.last_modified"), F.map_entries("full.headers").alias("headers")))).over(here))
    out = seen.where("revisit").join(carried, ["u", "slice"], "left")
    pick = lambda name: F.coalesce(F.col(f"found.{name}"), F.col(f"carried.{name}"))
    got_headers = F.when(F.col("found").isNotNull(), F.map_from_entries("found.headers")).otherwise(F.col("carried.headers"))
    some = (F.col("found").isNotNull() | F.col("carried").isNotNull()) & F.col("t").isNotNull()
    agree = F.when(F.col("etag").isNotNull(), _tag(F.col("etag")) == _tag(F.when(F.col("found").isNotNull(), F.col("found.etag")).otherwise(F.col("carried.etag"))))
    agree = F.coalesce(F.when(F.col("etag").isNotNull(), agree).when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.when(F.col("found").isNotNull(), F.col("found.last_modified")).otherwise(F.col("carried.last_modified"))).otherwise(F.lit(True)), F.lit(False))
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWED))
    verdict = F.when(~some, "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    merged = F.when(verdict == "resolved", F.map_concat(F.map_filter(got_headers, lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed))
    return out.select("record_id", F.col("u").alias("canonical_url"), F.when(verdict == "resolved", pick("record_id")).alias("response_id"), verdict.alias("verdict"), merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of two crawls over pages: each page as a full response, and 1000 ticks later a revisit of it.

    Revisits have the entity tag of what the page held, but by page_id: every fourth only a date of last modification,
    every eighth (from 5) the tag of something else, every sixteenth (from 8) neither.
    """
    tag, day = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    length = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    k = F.col("page_id")
    first = pages.select(
        (2 * k).alias("record_id"), "url", k.alias("captured_at"), F.lit(200).alias("status"), F.concat(F.lit('"'), tag, F.lit('"')).alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("Date"), k.cast("string")).alias("headers"),
    )
    again_tag = F.when((k % 4 == 3) | (k % 16 == 8), F.lit(None)).when(k % 8 == 5, F.lit('"gone"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
    again = pages.select(
        (2 * k + 1).alias("record_id"), "url", (k + 1000).alias("captured_at"), F.lit(304).alias("status"), again_tag.alias("etag"), F.when(k % 16 != 8, day).alias("last_modified"),
        F.create_map(F.lit("Date"), (k + 1000).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), F.lit("never")).alias("headers"),
    )
    return first.unionByName(again)


def digest(pages: DataFrame) -> DataFrame:
    """The revisits of captures(pages) resolved, headers as sorted `name: value` lines."""
    found = resolve(captures(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.withColumn("headers", lines)


SQL = r"""
WITH b AS (SELECT page_id, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#[\s\S]*$', '') AS x FROM pages),
h AS (SELECT page_id, md5(html) AS tag, length(html) AS len, 'day ' || (page_id % 365) AS day,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(x, '^[^?]*\?([\s\S]*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM b),
c AS (SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u FROM h),
r AS (SELECT c.page_id, c.u, c.tag, c.day, (SELECT max(p.page_id) FROM c p WHERE p.u = c.u AND p.page_id < c.page_id + 1000) AS hit FROM c),
j AS (SELECT r.*, p.tag AS ptag, p.day AS pday, p.len AS plen,
    CASE WHEN r.hit IS NULL THEN 'no_earlier_response'
         WHEN r.page_id % 16 = 8 THEN 'resolved'
         WHEN r.page_id % 4 = 3 THEN CASE WHEN r.day = p.day THEN 'resolved' ELSE 'validator_mismatch' END
         WHEN r.page_id % 8 <> 5 AND r.tag = p.tag THEN 'resolved' ELSE 'validator_mismatch' END AS verdict
    FROM r LEFT JOIN c p ON p.page_id = r.hit)
SELECT 2 * page_id + 1 AS record_id, u AS canonical_url, CASE WHEN verdict = 'resolved' THEN 2 * hit END AS response_id, verdict,
    CASE WHEN verdict = 'resolved' THEN 'content-length: ' || plen || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 1000) || chr(10) || 'expires: never' END AS headers
FROM j
"""


def exchanges(read: DataFrame) -> DataFrame:
    """What read_warc gives as records for resolve(): responses and revisits with their validators."""
    h = _lowered(F.col("http_headers"))
    return read.where("warc_type IN ('response', 'revisit')").select(
        F.col("record_uri").alias("record_id"), F.col("target_uri").alias("url"), F.col("warc_date").alias("captured_at"), F.col("http_status").alias("status"),
        h["etag"].alias("etag"), h["last-modified"].alias("last_modified"), h.alias("headers"),
    )


def _inflated(data: bytes) -> bytes:
    """The members of a gzip file in a row; of a broken one what can be had, and nothing behind it."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, plain or in gzip members.

    A record that breaks off, in the file or in its member, ends the file; one whose length can't be read is passed over.
    """
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _fields(data[at:end])
        if not (said := fields.get("content-length", "0")).isascii() or not said.isdigit():
            at = end + 4
            continue
        size = int(said)
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        status, headers, payload = None, None, block
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            first = head.split(b"\r\n", 1)[0].split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() and len(first[1]) < 6 else None
            headers = list(_fields(head).items())
        yield {
            "warc_type": fields.get("warc-type"), "record_uri": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"),
            "refers_to": fields.get("warc-refers-to"), "http_status": status, "http_headers": headers, "payload": payload,
        }
        at = end + 4 + size


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by name in lower case; the values of a repeated name are joined by commas."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, mark, value = line.partition(b":")
        if mark:
            key, value = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            out[key] = f"{out[key]}, {value}" if key in out else value
    return out


def record_bytes(warc_type: str, record_uri: str, target_uri: str, date: str, status: str, headers: dict[str, str], payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record holding an HTTP response."""
    lines = lambda first, items: "\r\n".join([first, *(f"{k}: {v}" for k, v in items)]).encode() + b"\r\n\r\n"
    block = lines(f"HTTP/1.1 {status}", headers.items()) + payload
    fields = {"WARC-Type": warc_type, "WARC-Record-ID": record_uri, "WARC-Target-URI": target_uri, "WARC-Date": date}
    fields |= {"WARC-Refers-To": refers_to} if refers_to else {}
    return lines("WARC/1.1", (fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}).items()) + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under a path, one task a file at least."""

    def run(batches):
        schema = pa.schema([(n, pa.string()) for n in ("warc_type", "record_uri", "target_uri", "warc_date", "refers_to")] + [("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column("content").to_pylist():
                held: list[dict] = []
                size = 0
                for record in parse(data):
                    held.append(record)
                    size += len(record["payload"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)
