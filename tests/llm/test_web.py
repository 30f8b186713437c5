"""URL filter and archives."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from cohortlens import storage
from cohortlens.llm import url_filter, warc

URLS = [
    None, "", "no scheme/here", "http://a.net/x?y=1", "http://a.net", "HTTP://WWW.Example.NET/en/1", "https://example.net/de/1#f",
    "http://example.com/de/", "http://example.com/de", "http://xexample.com/de/q", "http://b.org/fr/z", "http://org/fr/", "http://a.org/en/",
    "http://net/", "ftp://h?q://x/", "http://Ünï.NET/é", "http://" + "a" * 50_000 + ".com/" + "b/" * 20_000, "x://y\n.net/a\nb",
]
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("host", T.StringType()), T.StructField("payload", T.StringType())])


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, at, start in url_filter.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(start):
            if best is None or len(at + start) > len(best[0]):
                best = (at + start, verdict)
    return host, path, *(best or (None, None))


def test_rules_on_edges(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(URLS * 2)], PAGES)
    rows = url_filter.judge(pages, ["page_id", "url", "host"]).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule, verdict = plain(r.row.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_and_nothing_to_learn(spark):
    rows = [(i, f"http://bad{i}.net/{i}/{i * 7919}?a={i}&b=2" if i % 2 else f"https://good.org/fr/page-{'x' * (i % 9)}", None, "", "") for i in range(400)]
    pages = spark.createDataFrame(rows, PAGES)
    lexical = url_filter.lexical(pages, ["page_id"])
    statistics = url_filter.suffix_statistics(lexical, 20.0)
    lexical = lexical.withColumn("suffix", url_filter.public_suffix(lexical.host)).join(statistics, "suffix")
    score = url_filter.fit(lexical, url_filter.Settings(max_rows=300, trees=3))
    right = lexical.withColumn("score", score).filter("(score >= 0.5) = (by_rule = 'block')").count()
    assert right == 400
    one_kind = spark.createDataFrame([(1, "http://a.net/", None, "", ""), (2, "http://b.com/", None, "", "")], PAGES)
    got = {r.row.page_id: r.verdict for r in url_filter.judge(one_kind).collect()}
    assert got == {1: "block", 2: "allow"}
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


HTML = ["<p>one</p>", "<p>one</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é" * 90_000, "<p>one</p>", "\r\n\r\n", "x"]


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "c", "c") for i, h in enumerate(HTML)]
    rows += [(None, "u", "x", "", ""), (None, None, "alone", "", ""), (0, "u", "<p>one</p>", "", "")]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = storage.scratch_path(spark, "warc_test")
    got = warc.archive(pages, path).collect()
    assert len(got) == len(rows)
    smallest = {}
    for page, _, html, _, _ in rows:
        body = (html or "").encode()
        smallest[body] = min([x for x in (smallest.get(body), page) if x is not None], default=None)
    want = []
    for page, _, html, _, _ in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = smallest[body]
        want.append((page, len(body), digest, "response" if page == first else "revisit", None if page == first else first))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, want)) == sorted(key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    payloads = {bytes(r.payload) for r in warc.read(spark, path).filter("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h, _, _ in rows}


def test_archive_members_and_small_payloads(spark):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 14\r\n\r\nHTTP/1.1\r\n\r\nab\r\n\r\n"
    twice = gzip.compress(record) + gzip.compress(record)
    assert [r["payload"] for r in warc.parse(twice)] == [b"ab", b"ab"]
    with pytest.raises(ValueError):
        list(warc.parse(record[:60]))
    pages = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", "")], PAGES)
    assert {r.record_type for r in warc.resolve(pages, min_bytes=3).collect()} == {"response"}
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
