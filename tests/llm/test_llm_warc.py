import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from meterloom.llm import warc
from meterloom.llm.common import shared_dir

ODD = [
    (1, "http://b.example.com/x?q=1", "<p>one</p>"), (2, "http://a.example.com/", "<p>one</p>"), (3, "https://b.example.com:8443/x", "two\r\n\r\nthree"),
    (4, None, None), (5, "", ""), (6, "http://[broken", "é" * 10), (None, "http://b.example.com/x?q=1", "<p>one</p>"), (None, None, "only null ids"),
    (None, None, "only null ids"), (7, "http://b.example.com/x?q=1", "z" * 3_000_000), (8, "not a url\twith tab\n", "w"), (9, "http://r.org/", "again"), (9, "http://r.org/", "again"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size long, digest string")


def stored_pages(spark, rows, folder, **more):
    captures = warc.write_archives(pages(spark, rows), folder, archive_bytes=1000, **more)
    return captures, warc.build_index(captures, lines=2)


def test_what_is_read_back_equals_the_pages(spark):
    folder = shared_dir(spark)
    captures, blocks = stored_pages(spark, ODD, folder)
    assert blocks.count() >= len(ODD) // 2
    found = warc.look_up(blocks, warc.url_keys(pages(spark, ODD)))
    got = [tuple(r) for r in warc.read_captures(found, folder).collect()]
    first = {}
    for i, _, html in ODD:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, url, html in ODD:
        data = (html or "").encode()
        owner = first.get(html or "")
        again = owner is not None and i != owner
        line = url if url is None else url.replace("\n", "%0A")
        want.append((i, line, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", owner if again else None, None if again else data))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_lookup_finds_one_key_only(spark):
    folder = shared_dir(spark)
    rows = [(k, f"http://host{k % 5}.example.com/{k % 3}", f"text {k}") for k in range(200)]
    _, blocks = stored_pages(spark, rows, folder)
    asked = spark.createDataFrame([(warc.url_key("http://host3.example.com/1"),), ("com,missing)/",), (None,)], "key string")
    got = warc.read_captures(warc.look_up(blocks, asked), folder).collect()
    assert sorted(r["page_id"] for r in got) == [k for k in range(200) if k % 5 == 3 and k % 3 == 1]


def test_archives_are_gzip_members_and_small_payloads_may_stay(spark):
    folder = shared_dir(spark)
    captures, _ = stored_pages(spark, ODD[:3], folder, least_bytes=100)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 3 and b"revisit" not in data
    assert captures.count() == 3


def test_damage_is_an_error(spark):
    data = warc.record(1, "http://x/", b"payload", warc.digest_of(b"payload"), None)
    assert warc.parsed(data)[2:5] == (7, warc.digest_of(b"payload"), "response")
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table(spark):
    folder = shared_dir(spark)
    captures, blocks = stored_pages(spark, [], folder)
    assert warc.read_captures(warc.look_up(blocks, warc.url_keys(pages(spark, []))), folder).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b" and warc.url_key("https://x.org:8443") == "org,x:8443)/"
