"""Registered queries against their SQL, and the pipeline's stages against what they must keep."""

import pytest

import corpus_pipeline
from tagloom.llm.common import saved, table
from tagloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

from .common import frame, prose
from .test_partenum import shingles

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest set has too few bad documents to learn from
    documents = table(spark, sf_dir, "documents")
    kept = {0: {r.doc_id: r for r in documents.collect()}}
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = saved(stage(spark, docs, sf_dir), name)
        kept[i] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[i]) <= set(kept[i - 1])
        if i < 5:
            assert docs.columns == documents.columns
    quality = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [d for d in quality if quality[d] == 1]
    assert sum(d in kept[1] for d in good) >= 0.95 * len(good)
    assert sum(d in kept[1] for d in quality if quality[d] == 0) <= 0.3 * sum(q == 0 for q in quality.values())
    sets = {d: shingles(r.text, 5) for d, r in kept[1].items()}
    for a in kept[1]:
        smaller = [b for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
        if a in kept[2]:
            assert not smaller
        elif not smaller:
            raise AssertionError(f"{a} went without a near copy")
    assert set(kept[3]) == set(kept[2]) and all(len(kept[3][d].text) <= len(kept[2][d].text) for d in kept[3])
    assert all(r.n_chars == len(r.text) for r in kept[3].values())
    assert set(kept[5]) == set(kept[4]) and len({(r.mix_slot, r.mix_place) for r in kept[5].values()}) == len(kept[5])


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[-4:] == ["mix_source", "mix_block", "mix_slot", "mix_place"]


EDGE = [(1, None), (2, ""), (None, None), (2, ""), (None, prose(1, 60)), (3, prose(1, 60)), (4, prose(1, 60)), (4, prose(1, 60)),
        (4, prose(2, 60)), (4, prose(2, 60)), (5, prose(1, 60) + " x"), (6, prose(3, 60)), (4, prose(4, 60)), (7, prose(2, 60)),
        (7, prose(5, 60)), (8, "a b"), (8, "a b"), (9, "A B")]


def test_copies_go_by_id_and_text(spark):
    """Where ids repeat only rows whose own text is a copy go, and one of equal rows stays."""
    docs = frame(spark, EDGE).repartition(4)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()), key=repr)
    assert left == sorted([(1, None), (2, ""), (2, ""), (None, None), (None, prose(1, 60)), (3, prose(1, 60)), (4, prose(2, 60)),
                           (6, prose(3, 60)), (4, prose(4, 60)), (7, prose(5, 60)), (8, "a b")], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).columns == docs.columns


def test_contaminated_rows_go_by_text(spark):
    item = table(spark, SF_DIR, "benchmark").filter("length(text) > 100").first().text
    docs = frame(spark, [*EDGE, (3, f"so {item} so"), (None, item), (1, item)]).repartition(3)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, SF_DIR).collect()), key=repr)
    assert left == sorted(EDGE, key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_an_empty_table_and_clashing_names(spark, name, stage):
    assert stage(spark, frame(spark, []), SF_DIR).count() == 0
    docs = frame(spark, EDGE).withColumnsRenamed({"score": "a.b", "node": "root", "spans": "doc_key", "_url": "_order"}).repartition(3)
    got = stage(spark, docs, SF_DIR)
    assert got.columns[:len(docs.columns)] == docs.columns
    assert all(r["a.b"] == "x" and r["root"] == 7 and r["doc_key"] == 3 for r in got.collect())
