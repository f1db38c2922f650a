import base64
import fnmatch
import hashlib
import random
import re

import numpy as np
import pyarrow.fs
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.queries import RULES
from tagloom.llm.url_filter import GlobAutomaton, Rule, filter_urls
from tagloom.llm.warc import archive_pages, lookup, read_frame, read_record, read_warc, seek_table, write_warc

SCHEMA = "page_id long, url string, html string, payload string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def matches(globs, texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return GlobAutomaton(globs).match(data, offsets)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?", max_size=8), min_size=1, max_size=30), st.lists(st.text("abc", max_size=12), min_size=1, max_size=8))
def test_globs_against_fnmatch(globs, texts):
    found = matches([g.encode() for g in globs], [t.encode() for t in texts])
    assert found.tolist() == [[bool(re.fullmatch(fnmatch.translate(g), t)) for g in globs] for t in texts]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in cut[1]), cut[2]
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.net/es/1",
            "http://net/fr/", "http://net/frx", "http://evilexample.com/en/", "http://x.org/example.com/en/", "a://b://net/es/",
            "http://münchen.net/fr/ä\nb", "http://x.net?/es/", "http://com", "x" * 5000 + "://net/es/" + "y" * 20_000, "http://net/es/"]
    found = filter_urls(pages(spark, [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://net/es/", None)]), RULES)
    out = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert {i: judged(u) for i, u in enumerate(urls)} == {i: v for i, v in out.items() if i is not None}
    assert out[None][2:] == ("net/es/", "block")
    assert filter_urls(pages(spark, []), RULES).collect() == [] and filter_urls(pages(spark, [(1, "u", "")]), []).first().rule is None


def test_many_rules_fill_several_words(spark):
    rules = [Rule(f"host{i}.org", f"/p{i}/", "block") for i in range(100)]
    urls = [(i, f"http://sub.host{i}.org/p{i if i % 2 else i + 1}/x", None) for i in range(100)]
    found = {r.page_id: r.rule for r in filter_urls(pages(spark, urls), rules).collect()}
    assert found == {i: f"host{i}.org/p{i}/" if i % 2 else None for i in range(100)}


def warc_rows():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\n%0D%", "body é " + "z" * rng.randrange(400)) for i in range(40)]
    rows += [(100 + i, None, "same") for i in range(30)] + [(50, "u", "same"), (50, "u", "same"), (200, "u", None), (201, "u", ""),
             (None, "u", "lone"), (None, "u", "lone"), (None, "u", "same"), (300, "u", "big\r\n\r\n" * 60_000)]
    return rows


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(ids, default=None)
        later = len(data) >= least and first is not None and page_id != first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_warc_round_trip(spark, tmp_path):
    rows = warc_rows()
    assert plain(archive_pages(pages(spark, rows))) == expected(rows)
    index = write_warc(pages(spark, rows), str(tmp_path / "w"), min_revisit_bytes=5, frame_bytes=2000, bundle_bytes=1000)
    assert index.select("bundle").distinct().count() > 3
    assert plain(read_warc(index)) == expected(rows, 5)
    urls = {r.page_id: (r.url, r.payload) for r in lookup(index, spark.createDataFrame([(3,), (300,)], "page_id long")).collect()}
    assert urls == {p: (u, bytearray(h.encode())) for p, u, h in rows if p in (3, 300)}
    # Every index row leads to its record through the seek table of its bundle.
    for r in index.limit(20).collect():
        with pyarrow.fs.LocalFileSystem().open_input_file(r.bundle) as file:
            at, size, _ = seek_table(file)[r.frame]
            assert (at, size) == (r.frame_at, r.frame_size)
            record, end = read_record(read_frame(file, at, size), r["at"])
            assert record["page_id"] == r.page_id and end - r["at"] == r.size


def test_warc_empty_table(spark):
    assert archive_pages(pages(spark, [])).collect() == []
