import random
import zlib

from tagloom.llm import language, quality, toxicity

from .common import frame, prose

LABELS = "doc_id long, quality int, toxic int, text string"
ODD = [(None, None), (None, "red green"), (900, ""), (901, "?!"), (902, "a" * 300_000), (3, None), (903, "123 456")]


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def quality_docs(n=240):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(i, rng.randrange(20, 120))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), ("spam " * 80), text.replace(" ", "### ")])
        docs.append((i, text))
        labels.append((i, int(good), 0, "x"))
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = quality_docs()
    found = quality.classify(frame(spark, docs + ODD), spark.createDataFrame(labels + [(None, 1, 0, "x"), (5, None, 0, "x")], LABELS))
    rows = found.collect()
    assert len(rows) == len(docs) + len(ODD)
    truth = {x[0]: x[1] for x in labels}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 4) == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = quality_docs(120)
    turned = [(i, 1 - q if fold(i, 4) == 2 else q, 1 if fold(i, 3) == 1 else t, x) for i, q, t, x in labels]
    for module in (quality, toxicity):
        one, two = (sorted((r.doc_id, r.score) for r in module.classify(frame(spark, docs), spark.createDataFrame(x, LABELS)).collect())
                    for x in (labels, turned))
        assert one == two


def test_without_labels(spark):
    for module in (quality, toxicity):
        rows = module.classify(frame(spark, ODD), spark.createDataFrame([], LABELS)).collect()
        assert len(rows) == len(ODD) and len({round(r.score, 6) for r in rows}) == 1
        assert module.classify(frame(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def toxic_docs(n=400):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = prose(i, rng.randrange(20, 80)).split()
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "dunderpate", "nincompoop"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), "x"))
    return docs, labels


def test_toxicity_on_held_out_documents_and_misspellings(spark):
    docs, labels = toxic_docs()
    spelt = [(1000, prose(5000, 30) + " blockhaed nincompop dunderpatte"), (1001, prose(5001, 30))]
    rows = toxicity.classify(frame(spark, docs + spelt + ODD), spark.createDataFrame(labels, LABELS)).collect()
    truth = {x[0]: x[2] for x in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    score = {r.doc_id: r.score for r in rows}
    assert score[1000] > 0.7 > score[1001] and len(rows) == len(docs) + 2 + len(ODD)


WORDS = {"xx": "lorem ipsum dolor sit amet vita brevis ars longa tempus fugit".split(),
         "yy": "kala maja puu vesi tuli päev öö lumi jää meri saar".split(),
         "zz": "αβγ δεζ ηθι κλμ νξο πρσ τυφ χψω".split()}


def test_language_on_held_out_documents(spark):
    rng = random.Random(3)
    docs = []
    for i in range(200):
        lang = rng.choice(sorted(WORDS))
        docs.append((i, prose(i, rng.randrange(1, 60), WORDS[lang]), lang, "s"))
    docs.append((800, prose(1, 20_000, WORDS["yy"]), None, "s"))
    rows = language.identify(frame(spark, docs + ODD), sample=20).collect()
    truth = {d[0]: d[2] for d in docs}
    found = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert found[800] == "yy" and {found[900], found[901], found[903]} == {"und"}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 4) == 2) for r in rows)


def test_language_without_languages(spark):
    rows = language.identify(frame(spark, [(1, "text"), (2, None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert language.identify(frame(spark, [])).collect() == []


def phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, count = max(end - 1, at + 1), count + 1
    return count


def test_phrases_against_brute_force():
    rng = random.Random(4)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    model = language.fit({"x": [sample]})
    clean = language.prepared(sample).decode()
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 900))) for _ in range(50)]
    blocks = [model.code[list(t.encode())] for t in sorted(texts, key=len, reverse=True)]
    import numpy as np
    table = np.zeros((len(blocks), max(map(len, blocks))), np.int64)
    for i, b in enumerate(blocks):
        table[i, :len(b)] = b
    found = model.automata[0].phrases(table, np.array([len(b) for b in blocks]))
    assert found.tolist() == [phrases(t, clean) for t in sorted(texts, key=len, reverse=True)]


def _many_languages(n):
    """Each language has twelve words of its own; all languages are equally frequent."""
    words = {}
    for k in range(n):
        rng = random.Random(k)
        words[f"l{k:03}"] = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12)]
    return [(8 * k + i, " ".join(random.Random(i).choices(w, k=30)), name, "s")
            for k, (name, w) in enumerate(words.items()) for i in range(8)]


def test_more_languages_than_two_hundred(spark):
    docs = _many_languages(210)
    rows = language.identify(frame(spark, docs), block=70).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {d[0]: d[2] for d in docs} and len(rows) == len(docs)


def test_blocks_of_languages_judge_alike(spark):
    docs = _many_languages(7) + [(1, None, "l000", "s"), (1, "..", "l000", "s"), (None, "abc", None, "s"), (None, "abc", None, "s"), (3, "xyz", None, "s"), (3, "xyz", None, "s")]
    def found(**options):
        return sorted((repr(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in language.identify(frame(spark, docs), **options).collect())
    assert found(block=3) == found() and len(found()) == len(docs)
