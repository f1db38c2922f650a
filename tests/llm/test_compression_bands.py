"""Counts against plain Python, verdicts against plain zstandard."""

import random
import re
from collections import Counter

import pytest
import zstandard

from tagloom.llm import compression_bands as cb
from tagloom.llm.queries import QUERIES
from tests.llm.common import frame, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, rules=cb.Rules()):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    data = text.encode()

    def outside(part):
        ratio = len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(part)) / len(part)
        band = [b for b in rules.bands if len(part) <= b.upto][0]
        return not band.low <= ratio <= band.high

    kept = not failed
    if kept:
        parts = [data[i:i + 4096] for i in range(0, len(data), 4096)]
        bad = sum(len(p) for p in parts if outside(p))
        kept = not outside(data) and bad * 100 <= 25 * len(data)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed, kept)


def noise(n):
    rng = random.Random(3)
    return " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(8)) for _ in range(n))


TEXTS = [
    None, "", " \n\t", "\n\n\n", "one", "a b c a b c", "a b c\na b c\n\na b c", "x\ny\nx \nx", "x\x0bx\x0cy\r\nx\x0bx\x0cy\r\n",
    "#*$ %&| <> ä", "äöü ß x 𝄞", "\x00 \x01", "é\n" * 70, prose(1, 60), prose(2, 3000), prose(3, 400) + "\n" + prose(3, 400),
    " ".join(["again"] * 5000), noise(900), prose(4, 800) + " " + "ab" * 9000 + " " + prose(5, 100), prose(6, 60000), "Wort wort " * 40,
    prose(7, 49), prose(8, 50), "a b c d " * 30 + prose(9, 200)]


def test_judge_equals_plain_python(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[14]), (3, TEXTS[14]), (3, TEXTS[14])])
    found = cb.judge(docs)
    got = rows(found.select("doc.doc_id", "doc.score", "doc.text", *cb.COUNTS, "base_failed", "kept"))
    assert got == sorted(((r.doc_id, "x", r.text, *plain(r.text)) for r in docs.collect()), key=repr)
    by_id = {r[0]: r[1] for r in found.select("doc.doc_id", "reason").collect() if r[0] is not None}
    assert by_id[17] == "incompressible" and by_id[18] in ("repetitive", "chunks") and by_id[13] is None and by_id[16] == "repeated"


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab é\n\t#") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    docs = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in cb.judge(docs).select("doc.doc_id", *cb.COUNTS, "base_failed", "kept").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_pieces_do_not_matter(spark):
    docs = frame(spark, list(enumerate(TEXTS)))
    before = rows(cb.judge(docs).drop("doc"))
    assert rows(cb.judge(docs, piece_bytes=10).drop("doc")) == before


def test_chunks_reject_what_the_whole_text_hides(spark):
    """A long text with a third of pure repetition has an ordinary ratio, but not in its chunks."""
    rng = random.Random(5)
    good = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(6000))
    text = good + " " + " ".join(str(i % 7) * 60 for i in range(250))
    r = cb.judge(frame(spark, [(1, text)])).first()
    assert not r.base_failed or r.reason == "repeated"
    part = cb.compression(memoryview(text.encode()), cb.Rules(), zstandard.ZstdCompressor(level=3))
    assert part[3] == "chunks" and 0 < part[2] < part[1]


def test_empty_table_names_with_dots_and_bands(spark):
    assert cb.judge(frame(spark, [])).count() == 0
    odd = frame(spark, [(1, prose(1, 80))]).withColumnRenamed("score", "a.b").withColumnRenamed("text", "the text")
    assert cb.judge(odd, text_name="the text").select("doc.`a.b`", "kept").first() == ("x", True)
    with pytest.raises(ValueError):
        cb.judge(odd, cb.Rules(bands=cb.BANDS[:-1]), "the text")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_compression_bands"](spark, sf).select(
        "doc_id", *cb.COUNTS, "base_failed", "kept").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: plain(r.text) for r in docs}
