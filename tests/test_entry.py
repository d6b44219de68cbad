import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from gramforge.plans import catalogue

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SLOW = {"jaccard_search", "jaccard_join", "gram_df", "entity_extract_ed"}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["jaccard_search_brute", "ed_search_brute", "index_search", "t_occurrence", "search_lines"])
def test_searches_name_every_row(spark, sf_dir, db, name):
    """A query finds all rows that have its own string, not one of them alone."""
    df = catalogue.queries()[name](spark, sf_dir)
    found = {(r.query_id, r[1] if name == "search_lines" else r.id) for r in df.collect()}
    own = db.sql("select a.p_partkey, b.p_partkey from part a join part b on a.p_name = b.p_name where a.p_partkey % 50 = 0").fetchall()
    assert len(own) > len({q for q, _ in own}) and set(own) <= found


@pytest.mark.parametrize("name, left, right", [("ed_join_two", "name", "type"), ("ed_join", "url", "url"), ("join_lines", "name", "name"), ("jaccard_join_count", "name", "name")])
def test_joins_lose_no_row_of_a_copy(spark, sf_dir, db, name, left, right):
    """Pairs of representatives, with each side's membership, are the pairs of rows."""
    column = {"name": ("part", "p_partkey", "p_name"), "type": ("part", "p_partkey", "p_type"), "url": ("pages", "page_id", "url")}
    member = lambda c: {r.id: r.rep for r in catalogue.queries()[f"{c}_membership"](spark, sf_dir).collect()}
    a, b = member(left), member(right)
    for c, m in ((left, a), (right, b)):
        table, key, value = column[c]
        assert set(m.items()) == set(db.sql(f"select x.{key}, min(y.{key}) from {table} x join {table} y on x.{value} = y.{value} group by 1").fetchall())
    pairs = {(r.id1, r.id2) for r in catalogue.queries()[name](spark, sf_dir).collect()}
    assert all(a[x] == x and b[y] == y for x, y in pairs)
    if name in ("ed_join_two", "join_lines"):
        (t, k, v), (u, l, w) = column[left], column[right]
        want = db.sql(f"select x.{k}, y.{l} from {t} x, {u} y where levenshtein(x.{v}, y.{w}) <= {7 if left != right else 3}" + (f" and x.{v} <> y.{w}" if left == right else "")).fetchall()
        either = pairs if left != right else pairs | {(y, x) for x, y in pairs}
        assert {(x, y) for x in a for y in b if (a[x], b[y]) in either} == set(want)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "sim"]


def test_entry_without_the_optional_folder(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(catalogue.queries()) and set(alone.oracle_sql()) == set(catalogue.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
