import random

from stratalane.llm import warc
from stratalane.session import load

SCHEMA = "record_id long, url string, captured_at long, status int, etag string, last_modified string, headers map<string,string>, extra string, t int"


def brute(rows):
    """rows: dicts with the canonical URL under u."""
    out = []
    for r in rows:
        if r["status"] != 304:
            continue
        full = [x for x in rows if x["u"] == r["u"] and 200 <= x["status"] <= 299 and None not in (x["captured_at"], r["captured_at"]) and x["captured_at"] < r["captured_at"]]
        last = max(full, key=lambda x: (x["captured_at"], x["record_id"]), default=None)
        if last is None:
            out.append((r["record_id"], None, "no_earlier_response", None))
            continue
        weak = lambda e: e.removeprefix("W/") if e else e
        if r["etag"] is not None:
            agree = weak(r["etag"]) == weak(last["etag"])
        elif r["last_modified"] is not None:
            agree = r["last_modified"] == last["last_modified"]
        else:
            agree = True
        if not agree:
            out.append((r["record_id"], None, "validator_mismatch", None))
            continue
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        merged = low(last["headers"]) | {k: v for k, v in low(r["headers"]).items() if k in warc.RENEWED}
        out.append((r["record_id"], last["record_id"], "resolved", tuple(sorted(merged.items()))))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(9)
    urls = {"http://A.org/x": "a.org/x", "https://www.a.org:443/x/#f": "a.org/x", "b.org/?b=2&a=1&utm_x=3": "b.org?a=1&b=2", None: ""}
    rows = []
    for i in range(600):
        url = rng.choice([*urls, "http://hot.org/", "http://hot.org/"])
        rows.append({
            "record_id": i, "url": url, "captured_at": rng.choice([None, *range(40)]), "status": rng.choice([200, 206, 304, 304, 404]), "etag": rng.choice([None, '"a"', 'W/"a"', '"b"']),
            "last_modified": rng.choice([None, "mon", "tue"]), "headers": rng.choice([None, {"ETag": str(i), "Content-Length": "0"}, {"X": "y", "date": "d"}]), "u": urls.get(url, "hot.org"),
        })
    table = spark.createDataFrame([(r["record_id"], r["url"], r["captured_at"], r["status"], r["etag"], r["last_modified"], r["headers"], "e", 1) for r in rows], SCHEMA)
    found = warc.resolve(table).collect()
    assert sorted((r.record_id, r.response_id, r.verdict, tuple(sorted(r.headers.items())) if r.headers is not None else None) for r in found) == brute(rows)
    assert {r.canonical_url for r in found} <= {*urls.values(), "hot.org"}
    assert warc.resolve(table.where("status = 999")).collect() == []


def test_sql(same_as_sql):
    rows = same_as_sql(lambda s, d: warc.digest(load(s, d, "pages")), warc.SQL)
    assert {r.verdict for r in rows} == {"resolved", "validator_mismatch"}


def test_warc_files(spark, tmp_path):
    import gzip

    one = warc.record_bytes("response", "<urn:1>", "http://a.org/", "2024-01-01T00:00:00Z", "200 OK", {"ETag": '"x"'}, b"body\r\n\r\nWARC/ inside")
    two = warc.record_bytes("revisit", "<urn:2>", "http://a.org/", "2024-01-02T00:00:00Z", "304 Not Modified", {"ETag": '"x"'}, b"", refers_to="<urn:1>")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + b"")
    (tmp_path / "c.warc").write_bytes(one + two[: len(two) // 2])
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.http_status for r in rows) == [200, 200, 200, 304, 304]
    assert {bytes(r.payload) for r in rows if r.http_status == 200} == {b"body\r\n\r\nWARC/ inside"}
    assert {r.refers_to for r in rows if r.warc_type == "revisit"} == {"<urn:1>"} and rows[0].http_headers == {"etag": '"x"'}


def test_from_files_to_verdicts(spark, tmp_path):
    """Captures half a second apart, repeated header names, a broken member and a length that is no number."""
    import gzip

    made = lambda kind, n, date, status, headers: warc.record_bytes(kind, f"<urn:{n}>", "http://www.a.org/p", date, status, headers, b"body" if kind == "response" else b"")
    first = made("response", 1, "2024-01-01T00:00:00.000Z", "200 OK", {"ETag": '"x"', "Vary": "a", "vary": "b", "X-One": "1"})
    again = made("revisit", 2, "2024-01-01T00:00:00.500Z", "304 Not Modified", {"ETag": 'W/"x"', "Date": "later"})
    other = made("revisit", 3, "2024-01-01T00:00:01Z", "304 Not Modified", {"ETag": '"y"'})
    early = made("revisit", 4, "2023-01-01T00:00:00Z", "304 Not Modified", {})
    undated = made("revisit", 5, "no date", "304 Not Modified", {})
    odd = made("response", 6, "2024-01-01T00:00:00.100Z", "200 OK", {}).replace(b"Content-Length: ", b"Content-Length: x")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (first, again, other))) + gzip.compress(early)[:-30])
    (tmp_path / "b.warc").write_bytes(odd + early + undated)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(first)[:40])
    found = {r.record_id: (r.response_id, r.verdict, r.headers) for r in warc.resolve(warc.exchanges(warc.read_warc(spark, str(tmp_path)))).collect()}
    assert found == {
        "<urn:2>": ("<urn:1>", "resolved", {"etag": 'W/"x"', "vary": "a, b", "x-one": "1", "date": "later"}),
        "<urn:3>": (None, "validator_mismatch", None), "<urn:4>": (None, "no_earlier_response", None), "<urn:5>": (None, "no_earlier_response", None),
    }


def test_header_names_that_differ_in_case(spark):
    rows = [(1, "a.org", 1, 200, None, None, {"X": "1", "x": "2"}), (2, "a.org", 2, 304, None, None, {"ETAG": "a", "etag": "b"}), (3, "a.org", 10**15, 304, None, None, None)]
    found = {r.record_id: r.headers for r in warc.resolve(spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA)).collect()}
    assert found == {2: {"x": "1, 2", "etag": "a, b"}, 3: {"x": "1, 2"}}


def test_nothing_is_carried_to_empty_stretches(spark):
    plan = warc.resolve(warc.captures(load(spark, "/root/testdata/sf0.001", "pages")))._jdf.queryExecution().toString()
    assert "Generate explode" not in plan
