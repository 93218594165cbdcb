"""Registered query of the WARC operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.llm import warc
from sowline.llm.common import table
from sowline.llm.registry import query

START = 1_700_000_000


def captures(spark, sf_dir):
    """WARC bytes of two captures a page: the page itself, and a 304 whose URL
    is spelled in another way, some minutes earlier or later, with a strong, a
    weak, a wrong or no ETag."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    i = F.col("page_id")
    stamp = lambda t, f: F.date_format(F.timestamp_seconds(t), f)
    iso, http = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss"
    tag = F.substring(F.md5("html"), 1, 16)
    seen = i * 60 + START
    again = seen + (F.pmod(i * 7919, F.lit(1000)) - 100) * 60
    other = F.concat(F.regexp_replace("url", "^https?://(www\\.)?", F.lit("HTTPS://WWW.")), F.when(i % 3 == 0, "#again").otherwise(""))
    etag = (F.when(i % 5 == 0, 'ETag: "stale"\r\n').when(i % 5 == 1, "").when(i % 5 == 2, F.concat(F.lit('ETag: W/"'), tag, F.lit('"\r\n')))
            .otherwise(F.concat(F.lit('ETag: "'), tag, F.lit('"\r\n'))))
    full = F.concat(F.lit('HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nCache-Control: max-age=60\r\nETag: "'), tag,
                    F.lit('"\r\nLast-Modified: '), tag, F.lit("\r\nDate: "), stamp(seen, http), F.lit("\r\n\r\n"), "html")
    short = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nContent-Type: text/none\r\nCache-Control: max-age="), (i % 100).cast("string"),
                     F.lit("\r\n"), etag, F.when(i % 10 == 1, "").otherwise(F.concat(F.lit("Last-Modified: "), tag, F.lit("\r\n"))),
                     F.lit("Date: "), stamp(again, http), F.lit("\r\n\r\n"))
    record = lambda kind, name, url, t, block: F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}"), F.lpad(i.cast("string"), 12, "0"), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: "), stamp(t, iso), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
        F.lit("\r\n\r\n"))
    return p.select(F.concat(record("response", "r", F.col("url"), seen, full), record("revisit", "v", other, again, short))
                    .cast("binary").alias("content"))


WARC_SQL = f"""
with p as (select page_id as i, url, coalesce(html, '') as html, substr(md5(coalesce(html, '')), 1, 16) as tag,
                  {START} + page_id * 60 as seen, {START} + page_id * 60 + ((page_id * 7919) % 1000 - 100) * 60 as again from pages),
k as (select *, regexp_replace(trim(url), '#.*$', '') as bare from p),
u as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www\\.', '') as host,
             regexp_replace(regexp_extract(bare, '^[^:]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
             list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) as args from k),
c as (select *, host || path || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as key from u),
v as (select *, case i % 5 when 0 then 'stale' when 1 then null else tag end as vtag, case when i % 10 = 1 then null else tag end as vmod from c),
m as (select v.i, v.key, v.again, v.vtag, v.vmod, arg_max(r.i, (r.seen, r.i)) as target
      from v left join c as r on r.key = v.key and r.seen <= v.again group by all),
j as (select m.*, r.tag, r.html, r.seen from m left join c as r on r.i = m.target),
d as (select *, case when target is null then 'no_response' when coalesce(vtag, vmod) is null then 'unverified'
                     when coalesce(vtag, vmod) = tag then 'resolved' else 'mismatch' end as verdict from j)
select i as page_id, key as url_key, verdict, target as target_id,
       case when verdict = 'resolved' then 'cache-control: max-age=' || (i % 100) || chr(10) || 'content-type: text/html' || chr(10)
         || 'date: ' || strftime(to_timestamp(again) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10)
         || 'etag: ' || case i % 5 when 1 then '"' || tag || '"' when 2 then 'W/"' || tag || '"' else '"' || tag || '"' end || chr(10)
         || 'last-modified: ' || tag end as headers,
       case when verdict = 'resolved' then sha256(html) end as body_sha256,
       case when verdict = 'resolved' then strlen(html)::bigint end as body_length
from d
"""


@query("op7_warc_revisits", WARC_SQL)
def op7(spark, sf_dir):
    """All revisits among the captures of all pages, resolved."""
    found = warc.resolve(warc.read_records(captures(spark, sf_dir), bodies=False))
    number = lambda c: F.substring(c, 2, 12).cast("long")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select(number("record_id").alias("page_id"), "url_key", "verdict", number("target_id").alias("target_id"),
                        lines.alias("headers"), "body_sha256", "body_length")
