import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from cuelake.llm import queries, urlfilter, warc
from cuelake.llm.workdir import Scratch


def verdicts(spark, rows, **more):
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), **more)
    return {r.page_id: r for r in out.collect()}


def test_rules(spark):
    urls = {
        1: ("http://x.net/a", "net/", "block"), 2: ("http://A.Example.NET/en/x?y", "example.net/en/", "allow"), 3: ("https://example.com/de/", "example.com/de/", "block"), 4: ("https://notexample.com/de/", None, "allow"),
        5: ("ftp://w.org/fr/1", "org/fr/", "allow"), 6: ("http://x.net", None, "allow"), 7: ("http://x.net?/a", None, "allow"), 8: (None, None, "allow"), 9: ("net/a", None, "allow"), 10: ("http://net/#", "net/", "block"), 11: ("a://b://c.net/", None, "allow"), 12: ("http://ÄB.net/Ö#x", "net/", "block"), 13: ("", None, "allow"),
    }
    out = verdicts(spark, [(i, u, None) for i, (u, _, _) in urls.items()])
    assert {i: (r.rule, r.verdict) for i, r in out.items()} == {i: v[1:] for i, v in urls.items()}
    assert (out[2].host, out[2].path, out[12].host, out[12].path, out[7].path, out[8].host) == ("a.example.net", "/en/x", "Äb.net", "/Ö", "", "")


def test_blocks_reach_aliases(spark):
    rows = [
        (1, "http://a.com/1", '<LINK rel="canonical" href="http://b.com/2">'), (2, "https://b.com/2#top", '<meta http-equiv="Refresh" content="0; url=/3">'), (3, "http://b.com/3", "<link href='http://bad.net/x' rel='nofollow canonical'>"),
        (4, "http://w.org/fr/4", '<link rel=canonical href=http://bad.net/x>'), (5, "http://c.com/5", '<link rel="stylesheet" href="http://bad.net/x">'), (6, "http://d.com/6", '<link rel="canonical" href="http://e.com/7">'), (7, None, '<link rel="canonical" href="http://bad.net/x">'), (8, "http://f.com/8", None), (8, "http://f.com/8", None),
    ]
    out = verdicts(spark, rows)
    assert {i: r.verdict for i, r in out.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    assert [i for i, r in out.items() if r.aliased] == [1, 2, 3]
    hops = spark.createDataFrame([("http://d.com/6", "http://bad.net/y")], "source_url string, target_url string")
    assert verdicts(spark, rows, redirects=hops)[6].verdict == "block"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urlfilter.judge_urls(df.withColumn("host", F.lit(1))).count() == 9 and urlfilter.judge_urls(df.limit(0)).count() == 0
    assert "Python" not in urlfilter.judge_urls(df)._jdf.queryExecution().executedPlan().toString()


def test_relative_and_escaped_targets(spark):
    want = {
        ("other.html", "http://a.com/x/y?q"): "http://a.com/x/other.html", ("../z", "http://a.com/x/y/w"): "http://a.com/x/z", ("../../../z/./", "http://a.com/x/y"): "http://a.com/z/", ("?id=1", "http://a.com/x/y?q#f"): "http://a.com/x/y?id=1",
        ("#f", "http://a.com/x?q"): "http://a.com/x?q#f", ("b", "http://A.com"): "http://a.com/b", ("/l?u=http://c.com/", "https://a.com/x"): "https://a.com/l?u=http://c.com/", ("//b.com", "https://a.com/x"): "https://b.com/", ("http://b.com/p/../q", None): "http://b.com/q",
        ("mailto:a@b.com", "http://a.com/x"): None, ("b", None): None, ("b", "a.com/x"): None, ("..", "http://a.com/x/y/z"): "http://a.com/x/",
    }
    rows = spark.createDataFrame([(t, u, w) for (t, u), w in want.items()], "t string, u string, w string")
    assert [(r.t, r.u, r.got) for r in rows.select("*", urlfilter.resolved(F.col("t"), F.col("u")).alias("got")).collect() if r.got != r.w] == []
    texts = {"?a=1&amp;b=2": "?a=1&b=2", "&#38;&#x26;&amp;amp;": "&&&amp;", "&#233;&#x1F600;&#xD800;&copy;&": "é\U0001F600&#xD800;&copy;&", "a": "a"}
    rows = spark.createDataFrame(list(texts.items()), "t string, w string")
    assert [r for r in rows.select("*", urlfilter.unescaped(F.col("t")).alias("got")).collect() if r.got != r.w] == []


def test_blocks_reach_relative_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.com/f/1", link("2?a=1&amp;b=2")), (2, "http://a.com/f/2?a=1&b=2", link("http://bad.net/x")), (3, "http://b.com", link("http://bad.net/y")), (4, "http://c.com/p", link("http://b.com/")),
        (5, "http://d.com/p/q", link("../e")), (6, "http://d.com/e", link("//bad.net/z")), (7, "http://e.com/p?x", '<meta http-equiv=refresh content="0; url=?id=1">'), (8, "http://e.com/p?id=1", link("https://bad.net/")),
        (9, "http://f.com/p", '<base href="http://g.com/h/">' + link("i")), (10, "http://g.com/h/i", link("http://bad.net/w")), (11, "http://f.com/i", None), (12, "http://h.com/x", link("/r?u=http://bad.net/w")),
    ]
    assert {i: r.verdict for i, r in verdicts(spark, rows).items()} == {i: "allow" if i in (11, 12) else "block" for i in range(1, 13)}


def read_back(spark, rows, **more):
    folder = Scratch(spark, "t").path("warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), folder, **more)
    return folder, warc.catalogue(spark, folder).collect()


def test_round_trip(spark):
    big = "é<p>WARC/1.1\r\n\r\nhallo\r\n0\r\n\r\n" * 900
    rows = [(5, "http://a/\r\nX: y", big, "k"), (3, None, big, "k"), (9, "u", big, "k"), (1, "u", "short", None), (2, "u", "short", None), (4, "u", None, None), (6, "u", "", None), (7, "u", "z" * 100, None), (8, "u", "z" * 100, None), (8, "u", "z" * 100, None), (None, "u", "z" * 100, None), (None, "u", "only" * 50, None)]
    for more in ({}, {"segment_bytes": 700, "chunk_bytes": 64, "records_per_file": 3}):
        folder, out = read_back(spark, rows, **more)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
        want = []
        for i, _, h, _ in rows:
            b = (h or "").encode()
            same = [j for j, _, g, _ in rows if g == h and j is not None]
            first = min(same, default=None) if len(b) >= 100 else None
            again = first is not None and i != first
            want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
        assert got == sorted(want, key=repr)
        whole = warc.payloads(warc.read_archives(spark, folder)).where("page_id = 3").first()
        assert bytes(whole.payload) == big.encode() and whole.ok
    assert read_back(spark, [(1, "u", "x", "k")][:0] or [])[1] == []


def members(content):
    """The uncompressed gzip members of a file, one by one."""
    import zlib

    while content:
        d = zlib.decompressobj(31)
        out = d.decompress(content)
        assert d.eof
        yield out
        content = d.unused_data


def independent_reader(folder):
    """Records by their names as an archive tool would see them: (fields, block), read without the library."""
    found = {}
    for f in sorted(folder.glob("*.txt")):
        for content in members(f.read_bytes()):
            head, _, rest = content.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            block = rest[: int(fields["Content-Length"])]
            assert first == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert fields["WARC-Record-ID"] not in found
            found[fields["WARC-Record-ID"]] = fields, block
    return found


def test_archives_are_valid_records(spark, tmp_path):
    """A member a record, fields that the standard asks for, names that are unique and the same in each run, references that lead to a record."""
    rows = [(1, "http://a/", "x" * 300), (2, "http://b/", "x" * 300), (2, "http://b/", "x" * 300), (3, "http://c/", "short"), (3, "http://c/", "short"), (4, None, "é" * 200_000), (None, "http://d/", "x" * 300), (5, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, "file://" + str(tmp_path / "w"), segment_bytes=4096)
    found = independent_reader(tmp_path / "w")
    kinds = [f["WARC-Type"] for f, _ in found.values()]
    assert kinds.count("revisit") == 3 and kinds.count("response") == 5 and kinds.count("continuation") == len(kinds) - 8
    for fields, _ in found.values():
        if fields["WARC-Type"] == "revisit":
            target, _ = found[fields["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and target["X-Page-Id"] == "1" and target["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        if fields["WARC-Type"] == "continuation":
            assert found[fields["WARC-Segment-Origin-ID"]][0]["WARC-Segment-Number"] == "1"
        else:
            assert fields["Content-Type"] == "application/http; msgtype=response"
    last = [f for f, _ in found.values() if "WARC-Segment-Total-Length" in f and f["WARC-Segment-Origin-ID"] in found]
    assert len(last) == 1 and int(last[0]["WARC-Segment-Total-Length"]) == sum(len(b) for f, b in found.values() if f["WARC-Type"] == "continuation") + 4096
    warc.write_archives(df.repartition(3), "file://" + str(tmp_path / "again"), segment_bytes=4096)
    assert independent_reader(tmp_path / "again") == found


def segments(spark, parts):
    rows = [("page", None, "continuation" if n > 1 else "response", "r" if n == 1 else f"r:{n}", None, hashlib.sha256(b"hello").hexdigest() if n == 1 else None, n, None if n == 1 else "r", total, bytearray(b)) for n, total, b in parts]
    df = spark.createDataFrame([(1, *r[1:]) for r in rows], warc.RECORDS)
    return warc.payloads(df).collect()


def test_broken_segments(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello", 2)
    a, b, c = block[:20], block[20:50], block[50:]
    good = segments(spark, [(3, len(block), c), (1, None, a), (2, None, b)])
    assert bytes(good[0].payload) == b"hello" and good[0].ok
    for parts in ([(1, None, a), (3, len(block), c)], [(1, None, a), (2, None, b), (3, len(block) + 1, c)], [(1, None, a), (2, None, b), (3, None, c)], [(1, None, a), (2, len(block) - 1, b + c[:-1])], [(2, len(block), b + c)]):
        out = segments(spark, parts)
        assert [(r.payload, r.ok) for r in out] == [(None, False)]


def test_framing():
    for size in (1, 3, 100):
        for payload in (b"", b"a", b"\r\n" * 40):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    for broken in (b"5\r\nhell", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n")))


def test_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = queries.op10_warc(spark, small).join(pages, "page_id")
    assert out.count() == pages.count()
    assert out.where((F.col("payload_digest") != F.sha2("html", 256)) | (F.col("payload_bytes") != F.octet_length("html"))).count() == 0
