import random

import pytest
from brute import ed, jaccard
from pyspark.sql import functions as F

from gramforge.functions import strings as S
from gramforge.operators import similarity as sim


def frame(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "id long, s string")


def words(seed, n, alphabet="ab", longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("strategy", sim.STRATEGIES)
@pytest.mark.parametrize("q,theta", [(2, 0.5), (3, 1.0)])
def test_jaccard_pairs(spark, strategy, q, theta):
    a, b = words(1, 40), words(2, 40)
    got = {(r.id1, r.id2): r.sim for r in sim.jaccard_pairs(frame(spark, a), frame(spark, b), q, theta, strategy=strategy).collect()}
    want = {(i, j): jaccard(x, y, q) for i, x in enumerate(a) for j, y in enumerate(b) if len(x) >= q and len(y) >= q and jaccard(x, y, q) >= theta}
    assert got == want


def near_copies(seed, n):
    """Distinct strings of all sizes in groups of near copies, some of repeated letters."""
    r, out = random.Random(seed), {"", "a", "éé", "a" * 300, "a" * 310, "ab" * 200}
    for size in (5, 9, 20, 60, 127, 131, 400, 1300):
        for _ in range(n):
            s = "".join(r.choice("abcdefgh ") for _ in range(size))
            for _ in range(4):
                t = list(s)
                for _ in range(r.randint(0, size // 100 + 1)):
                    t[r.randrange(len(t))] = r.choice("xyz")
                out.add("".join(t)[: r.randint(size * 4 // 5, size)])
    return sorted(out)


@pytest.mark.parametrize("q,theta", [(3, 0.8), (8, 0.8), (2, 0.9)])
def test_parts_lose_no_pair(spark, q, theta):
    from gramforge.operators import parts

    strings = near_copies(21, 4)
    got = [(r.id1, r.id2, r.sim) for r in parts.near_pairs(frame(spark, strings), q, theta).collect()]
    want = [(i, j, jaccard(x, y, q)) for i, x in enumerate(strings) for j, y in enumerate(strings) if i < j and jaccard(x, y, q) >= theta]
    assert sorted(got) == want and len(want) > 20


def test_jaccard_join_links_every_copy(spark, tmp_path):
    """Each row that is a copy is linked to the smallest id of its text, which has the links to other texts."""
    from gramforge.plans import catalogue

    texts = [*near_copies(22, 1), None]
    rows = [(i, texts[i % len(texts)]) for i in range(2 * len(texts) + 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.id1, r.id2) for r in catalogue.jaccard_join(spark, str(tmp_path)).collect()]
    rep, link = {i: i % len(texts) for i, s in rows}, set(got)
    assert len(link) == len(got)
    for i, x in rows:
        for j, y in rows[i + 1 :]:
            if x is not None and y is not None and jaccard(x, y, 8) >= 0.8:
                a, b = sorted((rep[i], rep[j]))
                assert (a == b or (a, b) in link) and all(k == rep[k] or (rep[k], k) in link for k in (i, j))


def test_jaccard_hand_cases(spark):
    one = lambda a, b, q, theta: [r.sim for r in sim.jaccard_pairs(frame(spark, [a]), frame(spark, [b]), q, theta).collect()]
    assert one("aaaa", "aa", 2, 0.1) == [1 / 3]
    assert one("abcdef", "abc", 2, 0.1) == [0.4]
    assert one("ab", "ab", 3, 0.5) == []
    assert one("ab", "ab", 3, 0.0) == [0.0]
    assert one("x", None, 1, 0.5) == []


def test_jaccard_search_has_thresholds_of_its_own(spark):
    data, asked = words(3, 50), words(4, 10)
    q = spark.createDataFrame([(i, s, 0.3 + 0.07 * i) for i, s in enumerate(asked)], "query_id long, query string, threshold double")
    got = {(r.query_id, r.id) for r in sim.jaccard_search(q, frame(spark, data), 2).collect()}
    assert got == {(i, j) for i, x in enumerate(asked) for j, y in enumerate(data) if len(x) > 1 and len(y) > 1 and jaccard(x, y, 2) >= 0.3 + 0.07 * i}


@pytest.mark.parametrize("strategy", ["prefix", "brute"])
@pytest.mark.parametrize("q,tau", [(3, 1), (2, 2), (3, 0)])
def test_ed_pairs(spark, strategy, q, tau):
    a, b = words(5, 45), words(6, 45)
    got = {(r.id1, r.id2, r.dist) for r in sim.ed_pairs(frame(spark, a), frame(spark, b), q, tau, strategy=strategy).collect()}
    assert got == {(i, j, ed(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if ed(x, y) <= tau}


@pytest.mark.parametrize("tau", [0, 1])
def test_ed_pairs_on_both_sides_of_the_deletion_limit(spark, monkeypatch, tau):
    monkeypatch.setattr(sim, "DELETION_CHARS", 6)
    a, b = [*words(15, 40), "", "é", None], [*words(16, 40), "", "e", "aaaaaaa", None]
    got = [(r.id1, r.id2, r.dist) for r in sim.ed_pairs(frame(spark, a), frame(spark, b), 3, tau).collect()]
    assert sorted(got) == sorted((i, j, ed(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and ed(x, y) <= tau)


def test_names_that_count_meet_few_others(spark, monkeypatch):
    """Every gram of such names is common; by deletions a name meets those within two edits alone, and no grams are counted."""
    monkeypatch.setattr(sim, "bucket_counts", None)
    data = frame(spark, [f"Customer#{i:09d}" for i in range(2000)])
    asked = data.filter("id % 50 = 0")
    assert sim._deletion_pairs(asked, data, 1).distinct().count() < 5 * sim.ed_pairs(asked, data, 3, 1).count()
    assert {r.id2 for r in sim.ed_pairs(asked.filter("id = 50"), data, 3, 1).collect()} == {50, 1050, *range(50, 1000, 100), *range(0, 100, 10), *range(50, 60)}


def test_ed_search_names_every_row_of_copies(spark, tmp_path):
    from gramforge.plans import catalogue

    names = [(i, f"Customer#{i % 60:09d}") for i in range(120)] + [(200, None), (201, "")]
    spark.createDataFrame(names, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted((r.query_id, r.id, r.dist) for r in catalogue.ed_search(spark, str(tmp_path)).collect())
    assert got == sorted((i, j, ed(x, y)) for i, x in names if i % 50 == 0 and x is not None for j, y in names if y is not None and ed(x, y) <= 1)


def test_ed_hand_cases(spark):
    one = lambda a, b, q, tau: [r.dist for r in sim.ed_pairs(frame(spark, [a]), frame(spark, [b]), q, tau).collect()]
    assert one("a", "b", 3, 1) == [1]
    assert one("abcde", "abXde", 3, 1) == [1]
    assert one("", "ab", 2, 2) == [2]
    assert one("ab", "ba", 2, 1) == []
    assert one("kitten", "sitting", 2, 3) == [3]
    assert one("kitten", "sitting", 2, 2) == []
    assert one("é", "e", 2, 1) == [1]


def test_self_join_and_empty_tables(spark):
    df = frame(spark, ["abcd", "abcd", "abce", None])
    assert {(r.id1, r.id2) for r in sim.jaccard_pairs(df, df, 2, 0.5, self_join=True).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {(r.id1, r.id2) for r in sim.ed_pairs(df, df, 2, 1, self_join=True).collect()} == {(0, 1), (0, 2), (1, 2)}
    none = df.limit(0)
    assert sim.jaccard_pairs(none, df, 2, 0.5).count() == sim.ed_pairs(df, none, 2, 1).count() == 0
    assert {(r.id, r.rep) for r in S.membership(df).collect()} == {(0, 0), (1, 0), (2, 2)}


def test_t_occurrence(spark):
    data, asked = [w for w in words(7, 40) if len(w) > 1], words(8, 8)
    q = spark.createDataFrame([(i, s, 0.6) for i, s in enumerate(asked)], "query_id long, query string, threshold double")
    got = {(r.query_id, r.id) for r in sim.t_occurrence(q, frame(spark, data), 2).collect()}
    want = {(r.query_id, r.id) for r in sim.jaccard_search(q, frame(spark, data), 2).collect()}
    assert want <= got  # the bound is necessary, not sufficient


def test_string_functions(spark):
    df = spark.createDataFrame([("a  b ", "abba"), ("é", "e"), ("", "x"), (None, "y")], "a string, b string")
    rows = df.select(S.qgrams(F.col("a"), 2).alias("g"), S.tokens(F.col("a")).alias("t"), S.histogram_bound(F.col("a"), F.col("b")).alias("h"), F.length(S.as_bytes(F.col("a"))).alias("n"), F.levenshtein(S.as_bytes(F.col("a")), S.as_bytes(F.col("b"))).alias("d")).collect()
    assert rows[0].g == ["a ", "  ", " b", "b "] and rows[0].t == ["a", "", "b"]
    assert rows[1].g == [] and rows[1].n == 2 and rows[1].d == 2
    assert rows[2].g == [] and rows[3].g is None
    assert rows[0].h <= ed("a  b ", "abba")


def test_segments(spark):
    rows = sim.segments(frame(spark, ["abcdefgh"]), 2).orderBy("seg_no").collect()
    assert [(r.seg_off, r.seg) for r in rows] == [(0, "abc"), (3, "def"), (6, "gh")]


def test_byte_distance_takes_whole_texts(spark, sf_dir):
    from gramforge.plans import catalogue

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r.item_id: (r.n_bytes, r.dist) for r in catalogue.byte_distance(spark, sf_dir).collect()}
    assert got == {k: (len(t.encode()), ed(t.encode(), t[::-1].encode())) for k, t in texts.items()}


def test_stored_index_gives_what_searches_give(spark, tmp_path):
    from gramforge.operators import index

    data, asked = [*words(11, 60), None, ""], [*words(12, 15), None]
    index.build(frame(spark, data), 2, str(tmp_path / "a"), 0.3, 2)
    known = index.GramIndex.load(spark, str(tmp_path / "a"))
    for step in (0.05, 0.0):
        q = spark.createDataFrame([(i, s, 0.3 + step * (i % 10)) for i, s in enumerate(asked)], "query_id long, query string, threshold double")
        got = {(r.query_id, r.id, r.sim) for r in known.jaccard_search(q).collect()}
        assert got == {tuple(r) for r in sim.jaccard_search(q, frame(spark, data), 2, "brute").collect()} and got
    for tau in (0, 1, 2):
        assert {tuple(r) for r in known.ed_search(q, tau).collect()} == {tuple(r) for r in sim.ed_search(q, frame(spark, data), 2, tau, "brute").collect()}
    with pytest.raises(ValueError):
        known.ed_search(q, 3)
    with pytest.raises(ValueError):
        known.jaccard_search(q.withColumn("threshold", F.lit(0.2)))
    none = index.build(frame(spark, data).limit(0), 2, str(tmp_path / "b"))
    assert none.jaccard_search(q.withColumn("threshold", F.lit(0.5))).isEmpty() and none.ed_search(q, 1).isEmpty()
    assert known.jaccard_search(q.limit(0)).isEmpty()
