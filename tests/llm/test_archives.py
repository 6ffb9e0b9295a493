import gzip
import hashlib

from tablesmith.llm import archives
from tablesmith.session import scratch_path

SF = "/root/testdata/sf0.001"


def expected(rows):
    best = {}
    for i, (page_id, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 1000:
            key = -1 if page_id is None else page_id
            best[body] = max(best.get(body, key), key)
    taken, out = set(), []
    for page_id, _, html in rows:
        body = (html or "").encode()
        kind, refers = "response", None
        if len(body) >= 1000 and (best[body] != (-1 if page_id is None else page_id) or body in taken):
            kind, refers = "revisit", best[body]
        elif len(body) >= 1000:
            taken.add(body)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), kind, refers))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                "refers_to").collect()), key=str)


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = scratch_path(spark, "warc")
    archives.pages_to_warc(pages, path)
    records = archives.read_warc(spark, path)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(records) == expected(rows)
    text = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in records.where("record_type = 'response'").collect():
        assert bytes(r["payload"]).decode() == (text[r["page_id"]] or "")
    ids = {r["record_id"]: r["page_id"] for r in records.collect()}
    assert len(ids) == len(rows)
    for r in records.where("record_type = 'revisit'").collect():
        assert ids[r["refers_to_id"]] == r["refers_to"] and r["payload"] is None


def test_odd_pages(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/ b", long), (1, "http://a/ b", long), (2, None, long), (3, "", None), (None, "x", ""),
            (4, "u", "short"), (5, "u", "short"), (6, "u", "x" * 3_000_000), (7, "v", "\n" * 1200), (8, "w", "\n" * 1200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    path = scratch_path(spark, "warc")
    archives.pages_to_warc(pages, path)
    records = archives.read_warc(spark, path)
    assert got(records) == expected(rows)
    urls = {r["page_id"]: r["url"] for r in records.collect()}
    assert urls[1] == "http://a/%20b" and urls[2] is None and urls[4] == "u"


def test_empty(spark):
    path = scratch_path(spark, "warc")
    archives.pages_to_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archives.read_warc(spark, path).count() == 0


def test_versions_agree(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "t" * i) for i in range(0, 3000, 500)],
                                  "page_id long, url string, html string").coalesce(1)
    seen = []
    for version in (1, 2):
        path = scratch_path(spark, "arc")
        archives.write_arc(pages, path, version)
        seen.append(sorted((r["page_id"], r["url"], bytes(r["block"]), r["payload_start"])
                           for r in archives.read_arc(spark, path).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 6


def test_members_and_header_errors():
    body = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    first = b"filedesc://a 0.0.0.0 20240101000000 text/plain %d\n" % len(body) + body + b"\n"
    record = b"http://a 1.2.3.4 20200102030405 text/html 5\nab\ncd\n"
    data = gzip.compress(first) + gzip.compress(record) + gzip.compress(record)
    rows = list(archives.arc_records("f", archives._Stream(data)))
    assert [r[7] for r in rows] == [b"ab\ncd"] * 2 and rows[0][3] == "http://a"
    bad = first + b"http://a 1.2.3.4 20200102030405 text/html 200 5\nabcde\n"
    try:
        list(archives.arc_records("f", archives._Stream(bad)))
    except ValueError as e:
        assert "header fields" in str(e)
    else:
        raise AssertionError("wrong header accepted")
