import random

import pytest
from brute import extract_ed, extract_jaccard

from gramforge.operators import extraction


def tables(spark, docs, entities):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(entities)), "entity_id long, entity string")


def words(seed, n, lo, hi, alphabet="abc"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(lo, hi))) for _ in range(n)]


def test_hand_case(spark):
    got = {(r.pos, r.len, r.dist) for r in extraction.extract_ed(*tables(spark, ["xabcx"], ["abc"]), 1).collect()}
    assert got == {(1, 3, 0), (0, 4, 1), (1, 2, 1), (1, 4, 1), (2, 2, 1)}


@pytest.mark.parametrize("tau", [0, 1, 2])
def test_edit_distance(spark, tau):
    docs, names = [*words(1, 8, 0, 30), None], [*words(2, 6, 1, 9), "", None]
    got = [(r.doc_id, r.entity_id, r.pos, r.len, r.dist) for r in extraction.extract_ed(*tables(spark, docs, names), tau).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j, *m) for i, d in enumerate(docs) for j, e in enumerate(names) if d and e for m in extract_ed(d, e, tau)}


def test_long_segments_are_verified(spark):
    e = "".join(random.Random(3).choice("abcdefgh") for _ in range(90))
    doc = "zz" + e[:40] + "X" + e[41:] + "yy" + e[:20] + "q" * 70
    got = {(r.pos, r.len, r.dist) for r in extraction.extract_ed(*tables(spark, [doc], [e]), 2).collect()}
    assert got == extract_ed(doc, e, 2)


@pytest.mark.parametrize("q,theta", [(2, 0.6), (1, 0.8), (3, 1.0)])
def test_jaccard(spark, q, theta):
    docs, names = words(4, 6, 0, 25), words(5, 5, 1, 8)
    got = {(r.doc_id, r.entity_id, r.pos, r.len) for r in extraction.extract_jaccard(*tables(spark, docs, names), q, theta).collect()}
    assert got == {(i, j, *m) for i, d in enumerate(docs) for j, e in enumerate(names) for m in extract_jaccard(d, e, q, theta)}


def test_jaccard_query_takes_whole_documents(spark, sf_dir):
    """Benchmark texts as they stand in documents are all found."""
    from gramforge.plans import catalogue

    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.doc_id, r.entity_id, r.pos, r.len) for r in catalogue.entity_extract_jaccard(spark, sf_dir).collect()}
    want = {(d.doc_id, i.item_id, d.text.find(i.text), len(i.text)) for d in docs for i in items if d.text and i.text and i.text in d.text}
    assert want and want <= got
    assert "entity_extract_jaccard_names" in catalogue.queries()
