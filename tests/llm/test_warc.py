from sowline.llm import warc


def record(kind, name, url, date, block, length=None):
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
            f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def http(status, body=b"", **headers):
    return f"HTTP/1.1 {status} X\r\n".encode() + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body


def test_parse():
    body = "é WARC/1.1 inside\r\n\r\n".encode()
    data = (record("warcinfo", "i", "", "2024-01-01T00:00:00Z", b"software: x") + record("response", "a", "http://x/", "2024-01-01T00:00:01Z", http(200, body, ETag="1", Set_Cookie="a"))
            + b"WARC/1.1\r\nWARC-Record-ID: bad\r\n\r\n" + record("revisit", "b", "http://x/", "bad date", http(304)) + record("response", "c", "u", "", b"", 99))
    rows = warc.parse(data)
    assert [(r["record_type"], r["record_id"]) for r in rows] == [("warcinfo", "i"), ("response", "a"), ("malformed", "bad"), ("revisit", "b"), ("malformed", "c")]
    assert rows[1]["body"] == body and rows[1]["status"] == 200 and rows[1]["headers"] == {"etag": "1", "set-cookie": "a"}
    assert rows[3]["time"] is None and rows[3]["status"] == 304 and warc.parse(b"") == []


def test_canonical_url(spark):
    cases = {"http://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com/a/b?a=1&b=2": "example.com/a/b?a=1&b=2",
             "https://user:pw@m.example.com:8080": "m.example.com:8080", "http://e.com/?ref=x": "e.com", " http://e.com/A/ ": "e.com/A", "nothing": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.k for r in df.select("u", warc.canonical_url(df.u).alias("k")).collect()} == cases


RECORDS = [
    # id, type, url, time, status, headers
    ("r1", "response", "http://e.com/a", 100, 200, {"etag": '"1"', "content-type": "t", "date": "d1", "vary": "v"}),
    ("r2", "response", "http://e.com/a/", 50_000, 200, {"etag": '"2"', "last-modified": "m2"}),
    ("r3", "response", "http://e.com/a", 60_000, 404, {"etag": '"3"'}),
    ("v0", "revisit", "http://e.com/a", 100, 304, {"etag": '"1"'}),
    ("v1", "revisit", "https://www.e.com/a#x", 40_000, 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no", "x": "no"}),
    ("v2", "revisit", "http://e.com/a", 500_000, 304, {"etag": '"1"'}),
    ("v3", "revisit", "http://e.com/a", 500_000, 304, {"last-modified": "m2"}),
    ("v4", "revisit", "http://e.com/a", 500_000, 304, {}),
    ("v5", "revisit", "http://e.com/a", 50, 304, {"etag": '"1"'}),
    ("v6", "revisit", None, 500, 304, {"etag": '"1"'}),
    ("v7", "revisit", "http://e.com/a", None, 304, {"etag": '"1"'}),
    ("v8", "revisit", "http://other.com/", 9, 304, None),
    ("v9", "revisit", "http://e.com/a", 500, 304, {"last-modified": "m"}),
    ("x", None, "http://e.com/a", 1, None, None),
]


def test_resolve(spark):
    df = spark.createDataFrame([(*r, f"sha-{r[0]}", 7) for r in RECORDS] * 2,
                               "record_id string, record_type string, url string, time long, status int, headers map<string,string>, body_sha256 string, body_length long")
    df = df.selectExpr("*", "1 as block", "'t' as target", "2 as verdict")
    for seconds in (warc.BLOCK_SECONDS, 10, 10**9):
        rows = warc.resolve(df, seconds).collect()
        got = {r.record_id: r for r in rows}
        assert len(rows) == 20 and len(got) == 10
        assert {k: (r.verdict, r.target_id) for k, r in got.items()} == {
            "v0": ("resolved", "r1"), "v1": ("resolved", "r1"), "v2": ("mismatch", "r2"), "v3": ("resolved", "r2"), "v4": ("unverified", "r2"),
            "v5": ("no_response", None), "v6": ("no_response", None), "v7": ("no_response", None), "v8": ("no_response", None), "v9": ("unverified", "r1")}
        assert got["v1"].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2", "vary": "v"}
        assert got["v1"].body_sha256 == "sha-r1" and got["v2"].headers is None
    assert warc.resolve(df.limit(0)).count() == 0


def test_read_records(spark):
    files = spark.createDataFrame([(bytearray(record("response", "a", "http://x/", "2024-01-01T00:00:01Z", http(200, b"hi"))),), (None,), (bytearray(b""),)], "content binary")
    rows = warc.read_records(files).collect()
    assert [(r.record_id, r.time, bytes(r.body), r.body_length) for r in rows] == [("a", 1704067201, b"hi", 2)]


def test_gzip_members_and_their_faults():
    import gzip
    one = record("response", "a", "<http://x/>", "2024-01-01T00:00:01Z", http(200, b"hi" * 5000))
    two = record("revisit", "b", "http://x/", "2024-01-01T00:00:02.5Z", http(304))
    rows = warc.parse(gzip.compress(one) + gzip.compress(two + one))
    assert [(r["record_type"], r["record_id"], r["url"]) for r in rows] == [("response", "a", "http://x/"), ("revisit", "b", "http://x/"), ("response", "a", "http://x/")]
    assert warc.parse(gzip.compress(one))[0]["body"] == b"hi" * 5000 and warc.parse(gzip.compress(b"")) == []
    many = [record("response", f"r{i}", "u", "", http(200, bytes(range(256)) * i)) for i in range(300)]
    assert [len(r["body"]) for r in warc.parse(b"".join(gzip.compress(m, i % 3) for i, m in enumerate(many)))] == [256 * i for i in range(300)]
    broken = gzip.compress(one)
    names = [r["record_id"] for r in warc.parse(broken[:-9] + gzip.compress(two)) if r["record_type"] != "malformed"]
    assert names == ["b"] and any(r["record_type"] == "malformed" for r in warc.parse(broken[:20]))


def test_dates_of_any_precision():
    at = lambda text: warc._when(text)
    assert at("2024-01-01T00:00:01Z") == (1704067201, 0) and at("2024-01-01T00:00:01.05Z") == (1704067201, 50_000_000)
    assert at("2024-01-01T00:00:01.123456789Z") == (1704067201, 123456789) and at("2024-01-01T00:01Z") == (1704067260, 0)
    assert at("2024") == at("2024-01") == at("2024-01-01") == (1704067200, 0)
    assert {at(t) for t in ("", "bad", "2024-13-01", "2024-01-01T00:00:01", "2024-01-01T00:00:01.Z", "2024-01-01T25:00:00Z")} == {(None, None)}


def test_other_revisits_and_parts_of_seconds(spark):
    tag = '"1"'
    rows = [("r1", "response", "http://e.com/", 100, 0, None, 200, {"etag": '"0"'}), ("r2", "response", "http://e.com/", 100, 500, None, 200, {"etag": tag}),
            ("a1", "revisit", "http://e.com/", 100, 400, "http://netpreserve.org/warc/1.1/revisit/server-not-modified", 304, {"etag": '"0"'}),
            ("a2", "revisit", "http://e.com/", 100, 600, None, 304, {"etag": tag}),
            ("a3", "revisit", "http://e.com/", 100, 600, "http://netpreserve.org/warc/1.0/revisit/server-not-modified", None, {"etag": tag}),
            ("o1", "revisit", "http://e.com/", 100, 600, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", 200, {"etag": tag}),
            ("o2", "revisit", "http://e.com/", 100, 600, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", 304, {"etag": tag}),
            ("o3", "revisit", "http://e.com/", 100, 600, None, 200, {"etag": tag}), ("o4", "revisit", None, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "sha", 7) for r in rows], "record_id string, record_type string, url string, time long, nanos int, profile string, "
                               "status int, headers map<string,string>, body_sha256 string, body_length long")
    for seconds in (warc.BLOCK_SECONDS, 1):
        got = {r.record_id: (r.verdict, r.target_id) for r in warc.resolve(df, seconds).collect()}
        assert got == {"a1": ("resolved", "r1"), "a2": ("resolved", "r2"), "a3": ("resolved", "r2"), **{f"o{i}": ("other_revisit", None) for i in (1, 2, 3, 4)}}


def test_a_hot_url_and_many_revisits_without_one(spark):
    rows = [("r", "response", "http://e.com/", 0, 200, {"etag": "1"})] + [(f"v{i}", "revisit", "http://e.com/" if i % 2 else None, i, 304, {"etag": "1"}) for i in range(3000)]
    df = spark.createDataFrame([(*r, "sha", 7) for r in rows], "record_id string, record_type string, url string, time long, status int, headers map<string,string>, body_sha256 string, body_length long")
    counts = {r.verdict: r["count"] for r in warc.resolve(df, 100).groupBy("verdict").count().collect()}
    assert counts == {"resolved": 1500, "no_response": 1500}


def test_batches_of_a_large_file_keep_every_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 5000)
    data = b"".join(record("response", f"r{i}", "http://x/", "2024-01-01T00:00:01Z", http(200, b"x" * i)) for i in range(300))
    files = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert sorted(r.body_length for r in warc.read_records(files).collect()) == list(range(300))
