"""WARC records and the resolution of not-modified revisits.

``read_records`` parses WARC bytes, plain or in gzip members.  ``resolve``
gives every not-modified ``revisit`` record the latest full response of its
canonical URL that is earlier by (time, nanos, record id), checks the
validators and merges the headers that a 304 may update into the response's.

The as-of join sorts (URL, time block) groups, not URLs: inside a block a
running window finds the latest response, and a table of one row a (URL,
block) hands the last response of earlier blocks over.  A URL that holds a
third of all records is spread over its time blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowline.llm.common import stored

BLOCK_SECONDS = 6 * 3600
# The header fields that a 304 response updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
# Fixed value: how the profile of a not-modified revisit ends, in all versions.
NOT_MODIFIED = "/server-not-modified"
GZIP = b"\x1f\x8b\x08"
# A date in any of the precisions of the format; a part left out is its first.
DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?Z)?)?)?")
PIECE = 1 << 16             # bytes of gzip data read at a time
BATCH_BYTES = 32 << 20      # of the records that are handed on at a time

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("time", T.LongType()), T.StructField("nanos", T.IntegerType()), T.StructField("profile", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.BinaryType())])


def canonical_url(url: Column) -> Column:
    """Host and path as one key: no scheme, user, ``www.``, default port,
    fragment, trailing slash or tracking parameters; host in lower case, other
    parameters sorted.  NULL and URLs without a host give NULL."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^:]*://[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    key = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", key)


def _fields(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            key, text = name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace")
            out[key] = f"{out[key]}, {text}" if key in out else text
    return out


def _when(text: str) -> tuple[int | None, int | None]:
    """Seconds since 1970 and nanoseconds of a WARC date; bad dates have none."""
    found = DATE.fullmatch(text)
    if not found:
        return None, None
    year, month, day, hour, minute, second = (int(g) if g else d for g, d in zip(found.groups(), (0, 1, 1, 0, 0, 0)))
    try:
        at = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        return None, None
    return int(at.timestamp()), int((found.group(7) or "0").ljust(9, "0"))


def _malformed(name: str | None = None) -> dict:
    return {"record_type": "malformed", "record_id": name}


def _plain(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = _fields(data[at:end]) if end >= 0 else {}
        length = head.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            yield _malformed(head.get("warc-record-id"))
            at += 5
            continue
        block = data[end + 4:end + 4 + int(length)]
        at = end + 4 + int(length)
        url = head.get("warc-target-uri")
        if url is not None and url.startswith("<") and url.endswith(">"):
            url = url[1:-1]
        time, nanos = _when(head.get("warc-date", ""))
        row = {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "url": url, "time": time, "nanos": nanos,
               "profile": head.get("warc-profile"), "status": None, "headers": None, "body": block}
        if block.startswith(b"HTTP/"):
            http, _, row["body"] = block.partition(b"\r\n\r\n")
            code = http.split(b"\r\n", 1)[0].split(b" ")
            row["status"] = int(code[1]) if len(code) > 1 and code[1].isdigit() else None
            row["headers"] = _fields(http)
        yield row


def _records(data: bytes) -> Iterator[dict]:
    if not data.startswith(GZIP):
        yield from _plain(data)
        return
    at = 0
    while (at := data.find(GZIP, at)) >= 0:
        member, parts, fed = zlib.decompressobj(wbits=31), [], at
        try:
            # fed piece by piece: what a member leaves over is copied by zlib
            while not member.eof and fed < len(data):
                parts.append(member.decompress(data[fed:fed + PIECE]))
                fed += PIECE
        except zlib.error:
            pass
        if not member.eof:
            yield _malformed()
            at += len(GZIP)
            continue
        yield from _plain(b"".join(parts))
        at = min(fed, len(data)) - len(member.unused_data)


def parse(data: bytes) -> list[dict]:
    """Records of WARC bytes, plain or as gzip members (one or more records
    each).  A record whose head is no WARC head, or whose length is missing or
    beyond the data, is of type ``malformed``, and so is a member that cannot
    be read; reading goes on at the next ``WARC/`` line or member head."""
    return list(_records(data))


def read_records(files: DataFrame, content: str = "content", bodies: bool = True) -> DataFrame:
    """Records of every row's WARC bytes (a ``binaryFile`` scan, or any binary
    column).  NULL and empty bytes have none.  ``bodies`` adds the bodies;
    their SHA-256 and length are given in any case.  A row's bytes are read in
    one task, its records handed on in batches of ``BATCH_BYTES``."""
    import hashlib

    arrow = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("time", pa.int64()),
                       ("nanos", pa.int32()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()),
                       ("body_sha256", pa.string()), ("body_length", pa.int64())])
    schema = T.StructType([*RECORD.fields, T.StructField("body_sha256", T.StringType()), T.StructField("body_length", T.LongType())])

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in _records(data or b""):
                    body = r.get("body") or b""
                    r["body_sha256"], r["body_length"] = hashlib.sha256(body).hexdigest(), len(body)
                    r["body"] = body if bodies else None
                    r["headers"] = list((r.get("headers") or {}).items())
                    rows.append(r)
                    held += 1000 + (len(body) if bodies else 0)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(F.col(content).cast("binary")).mapInArrow(run, schema)


def resolve(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url_key, verdict, target_id, headers
    (merged, by name), body_sha256 and body_length.

    A full response has type ``response``, status 200 and a time.  Verdicts:
    ``other_revisit`` (the profile is another than not-modified, the status
    another than 304, or both are missing: its target is named by digest, not
    by validators), ``resolved`` (an ETag equal but for weakness, or where the
    revisit has none, an equal Last-Modified), ``mismatch``, ``unverified``
    (the revisit has no validator, or the response lacks that one) and
    ``no_response`` (no earlier response, or no URL or time).  Only resolved
    rows carry headers and body.  Of responses at one time the largest record
    id is the latest; responses at a revisit's own time are earlier if their id
    is smaller.  Repeated revisit rows stay repeated.  Records without columns
    ``nanos`` and ``profile`` count as whole seconds and unnamed profiles.
    """
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    wanted = F.coalesce(full, F.lit(False)) | is_revisit
    profile, status = has("profile", "string"), F.col("status")
    same = F.coalesce(F.endswith(F.lower(profile), F.lit(NOT_MODIFIED)), status == 304, F.lit(False)) & F.coalesce(status == 304, F.lit(True))
    nanos = F.coalesce(has("nanos", "int"), F.lit(0)).alias("nanos")
    row = F.struct("time", nanos, "record_id", "headers", "body_sha256", "body_length")
    events = records.where(wanted).select(
        "record_id", "record_type", "time", nanos, "headers", (is_revisit & ~same).alias("other"), canonical_url(F.col("url")).alias("url_key"),
        F.when(full & F.col("time").isNotNull(), row).alias("response")).withColumn("block", F.floor(F.col("time") / block_seconds))
    # several uses below: stored once, without bodies, instead of parsed each time
    events = stored(events, "captures")
    usable = F.col("url_key").isNotNull() & F.col("time").isNotNull() & ~F.col("other")
    none = F.lit(None)
    # revisits that nothing can answer meet no window: they may be any share of the rows
    idle = events.where((F.col("record_type") == "revisit") & ~usable).select(
        "record_id", "url_key", F.when(F.col("other"), "other_revisit").otherwise("no_response").alias("verdict"), none.cast("string").alias("target_id"),
        none.cast("map<string,string>").alias("headers"), none.cast("string").alias("body_sha256"), none.cast("long").alias("body_length"))
    events = events.where(usable)
    order = ["time", "nanos", "record_id"]
    inside = Window.partitionBy("url_key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("record_type = 'revisit'").drop("response")
    # maps have no order: the last response of a block by (time, nanos, id) alone
    last = events.where("response is not null").groupBy("url_key", "block").agg(F.max_by("response", F.struct(*order)).alias("response"))
    asked = near.select("url_key", "block").distinct()
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = (asked.join(last, ["url_key", "block"], "full").withColumn("far", F.last("response", ignorenulls=True).over(before))
              .select("url_key", "block", "far").where("far is not null"))
    found = near.join(handed, ["url_key", "block"], "left").withColumn("target", F.coalesce("near", "far"))
    theirs = F.col("target")["headers"]
    strong = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    dated = lambda h: F.try_element_at(h, F.lit("last-modified"))
    mine = F.col("headers")
    equal = F.when(strong(mine).isNotNull(), strong(mine) == strong(theirs)).otherwise(dated(mine) == dated(theirs))
    verdict = (F.when(F.col("target").isNull(), "no_response").when(equal.isNull(), "unverified")
               .when(equal, "resolved").otherwise("mismatch"))
    found = found.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    return found.select("record_id", "url_key", "verdict", F.col("target")["record_id"].alias("target_id"),
                        F.when(ok, merged).alias("headers"), F.when(ok, F.col("target")["body_sha256"]).alias("body_sha256"),
                        F.when(ok, F.col("target")["body_length"]).alias("body_length")).unionByName(idle)
