import re

from tagloom.llm.decontaminate import decontaminate

from .common import frame, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            n = min(window, len(p))
            for s in range(len(p) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == p[s:s + n]:
                        hit.update(range(i, i + n))
                        names |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), len(names), ",".join(sorted(names))))
    return sorted(out, key=repr)


def tables(spark):
    base = [prose(i, 40) for i in range(20)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(50, base[0] + "\n" + base[1]), (51, "A b, C"), (52, "a b c a b c"), (None, base[2]), (None, None), (53, ""),
             (54, "..."), (51, "A b, C"), (55, "Äpfel x1"), (56, prose(77, 5000) + " " + base[3])]
    items = [(1, " ".join(base[0].split()[5:25])), (2, "A, B! c"), (10, "b c a"), (None, " ".join(base[4].split()[:12])),
             (4, None), (5, ""), (6, "?!"), (2, "x1"), (7, base[3]), (1, "c a")]
    return docs, items


def found(spark, docs, items, **options):
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    df = decontaminate(frame(spark, docs), bench, **options)
    assert all((r.n_hit > 0) == r.contaminated for r in df.collect())
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs, items = tables(spark)
    assert found(spark, docs, items) == brute(docs, items, 10)
    assert found(spark, docs, items, window=3, segment_bytes=200) == brute(docs, items, 3)


def test_benchmark_in_blocks(spark):
    docs, items = tables(spark)
    assert found(spark, docs, items, block_bytes=150) == brute(docs, items, 10)


def test_near(spark):
    docs = [(1, "red one green two blue"), (2, "blue x x x x x red green"), (3, "green blue red"), (4, "red green")]
    out = {r[0]: r[2] for r in found(spark, docs, [(1, "red green blue")], near=5)}
    assert out == {1: 5, 2: 0, 3: 3, 4: 0}


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert found(spark, [], items) == []
    assert all(r[2:] == (0, 0, "") for r in found(spark, docs, []))
