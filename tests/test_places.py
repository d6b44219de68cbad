import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gramforge.functions.order import with_rank
from gramforge.operators import infix, spatial
from gramforge.plans import service
from gramforge.sources import files
from gramforge.streaming.serve import serve


@pytest.fixture
def places(spark):
    r = random.Random(1)
    names = ["red gizmo", "blue ring", "a%b_c.d", "ring", "", "old gear"]
    rows = [(i, f"addr {i}", r.choice(names), i % 7, r.choice([0.0, 1.0, r.random()]), r.random() ** 4) for i in range(300)]
    return spark.createDataFrame(rows, "id long, addr string, name string, pcode int, lat double, lng double")


def test_nearest_and_ties(spark):
    points = spark.createDataFrame([(3, 0.0, 1.0), (1, 1.0, 0.0), (2, 0.0, 5.0), (4, None, 0.0)], "id long, lat double, lng double")
    assert [r.id for r in spatial.nearest(points, 0, 0, 2).collect()] == [1, 3]
    assert [r.id for r in spatial.nearest(points, 0, 0, 2, F.col("id") > 1).collect()] == [3, 2]
    assert spatial.nearest(points.limit(0), 0, 0).collect() == []
    assert {r.id for r in spatial.in_rectangle(points, 0, 0, 1, 1).collect()} == {1, 3}


def test_nearest_batch_equals_single(spark, places):
    asked = [(0, 0.5, 0.5), (1, 0.0, 0.0), (2, 9.0, -9.0), (3, 1.0, 0.01)]
    for k in (1, 10, 400):
        rows = spatial.nearest_batch(places, spark.createDataFrame(asked, "req_id long, lat double, lng double"), k).collect()
        for req, lat, lng in asked:
            got = [r.id for r in sorted((r for r in rows if r.req_id == req), key=lambda r: r["rank"])]
            assert got == [r.id for r in spatial.nearest(places, lat, lng, k).collect()]
    one = places.filter("id = 5")
    assert spatial.nearest_batch(one, spark.createDataFrame(asked, "req_id long, lat double, lng double")).count() == 4
    assert spatial.nearest_batch(places.limit(0), spark.createDataFrame(asked, "req_id long, lat double, lng double")).count() == 0


def test_rectangles(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        x, y = r.random() - 0.5, r.random() - 0.5
        rows.append((i, x, y, x + r.random() * 0.2, y + r.random() * 0.2))
    rows.append((99, 1.0, 0.0, 0.0, 1.0))  # not a rectangle
    boxes = spark.createDataFrame(rows, "id long, min_lat double, min_lng double, max_lat double, max_lng double")
    got = [(x.id1, x.id2) for x in spatial.mbr_pairs(boxes, 0.07).collect()]
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(got) == len(want) and set(got) == want


def test_infix(spark, places):
    def want(kw):
        rows = [(min((r.name[i:] for i in range(len(r.name)) if r.name.startswith(kw, i)), default=r.name), r.id) for r in places.collect() if kw in r.name]
        return [i for _, i in sorted(rows)[:10]]

    for kw in ("ring", "r", "%", "_", ".", "", "absent"):
        assert [r.id for r in infix.infix_search(places, kw).collect()] == want(kw)
    assert infix.autocomplete(places, "gear").first().suggestions == ["old gear"] * 10
    assert service.search(places, "ring", 0.5, 0.5).count() == 10 and service.search(places, "absent").count() == 0


def test_suffix_arrays(spark):
    strings = ["banana", "ana", "", "é", "ana"]
    df = spark.createDataFrame(list(enumerate(strings)), "id long, s string")
    want = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s)))
    want.sort(key=lambda x: (x[0].encode(), x[1], x[2]))
    rows = sorted(infix.suffix_array(df).collect(), key=lambda r: r["rank"])
    assert [(r.suffix, r.id, r.pos) for r in rows] == want and [r["rank"] for r in rows] == list(range(len(want)))
    lcp = {r["rank"]: r.lcp for r in infix.lcp_array(df).collect()}
    for k in range(1, len(want)):
        a, b = want[k - 1][0], want[k][0]
        assert lcp[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


def test_rank_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted((r.x, r["rank"]) for r in with_rank(df, "x").collect()) == [(k, k) for k in range(1000)]


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\n\nthree three\n" + "x" * 5000 + "\nlast")
    assert [(r.id, r.s) for r in files.read_strings(spark, str(tmp_path / "lines.txt")).orderBy("id").collect()] == [(0, "one"), (1, ""), (2, "three three"), (3, "x" * 5000), (4, "last")]
    (tmp_path / "q.tsv").write_text("abc\t0.5\nd e\t1\n")
    assert [(r.query_id, r.query, r.threshold) for r in files.read_queries(spark, str(tmp_path / "q.tsv")).orderBy("query_id").collect()] == [(0, "abc", 0.5), (1, "d e", 1.0)]
    (tmp_path / "bad.tsv").write_text("abc 0.5\n")
    with pytest.raises(PySparkException):
        files.read_queries(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "places.json").write_text(json.dumps({"addr": "a", "name": "n", "pcode": 5, "latlng": [1.5, 2.5]}) + "\n")
    assert files.read_places(spark, str(tmp_path / "places.json")).first() == (0, "a", "n", 5, 1.5, 2.5)
    (tmp_path / "bad.json").write_text("{\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_places(spark, str(tmp_path / "bad.json")).collect()
    bodies = spark.createDataFrame([(0, "0\n1.5 -2 red ring"), (1, "1\nblue"), (2, "0\n1 2 "), (3, "1\n")], "req_id long, body string")
    rows = files.parse_requests(bodies).orderBy("req_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1.5, -2.0, "red ring"), (1, None, None, "blue"), (0, 1.0, 2.0, ""), (1, None, None, "")]


def test_lines(spark):
    data = spark.createDataFrame([(0, "ab"), (1, "cd")], "id long, s string")
    q = spark.createDataFrame([(7, "ab", 0.5)], "query_id long, query string, threshold double")
    hits = spark.createDataFrame([(7, 0, 1.0)], "query_id long, id long, sim double")
    assert [r.line for r in files.search_lines(q, hits, data).orderBy("query_id", "line_no").collect()] == ["+ 0.50 ab", "  1.000000 ab"]
    pairs = spark.createDataFrame([(0, 1, 2)], "id1 long, id2 long, dist int")
    assert files.join_lines(pairs).first().line == "+ 0 1 2" and files.join_lines(pairs, data, data).first().line == "+ 0 1 2 ab cd"
    found = spark.createDataFrame([(1, 2, 3, 4, 0)], "doc_id long, entity_id long, pos int, len int, dist int")
    assert files.extract_lines(found).first().line == "1 2 3 4 0"


def test_stream_equals_batch(spark, places, tmp_path):
    bodies = [(0, "0\n0.5 0.5 ring"), (1, "1\ngear"), (2, "1\nabsent")]
    spark.createDataFrame(bodies, "req_id long, body string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("req_id long, body string").json(str(tmp_path / "in"))
    serve(places, stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    got = {r.req_id: json.loads(r.response) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {0, 1}
    assert [x["addr"] for x in got[0]] == [r.addr for r in service.search(places, "ring", 0.5, 0.5).collect()]
    assert [x["addr"] for x in got[1]] == [r.addr for r in service.search(places, "gear").collect()]


def test_boxes_take_all_points(spark, sf_dir):
    from gramforge.plans import catalogue

    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = catalogue.queries()["mbr_point_dist"](spark, sf_dir).collect()
    assert sorted(r.id for r in rows) == sorted(r.vec_id for r in points.select("vec_id").collect())
    boxes = {}
    for r in points.select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")).collect():
        boxes.setdefault(r.label, []).append((r.x, r.y))
    box = {k: (*map(min, zip(*v)), *map(max, zip(*v))) for k, v in boxes.items()}
    want = {(a, b) for a in box for b in box if a < b and all(box[a][i] <= box[b][i + 2] and box[b][i] <= box[a][i + 2] for i in (0, 1))}
    assert {(r.id1, r.id2) for r in catalogue.queries()["mbr_intersect"](spark, sf_dir).collect()} == want


def test_service_with_keywords_that_few_places_have(spark, monkeypatch):
    from gramforge.plans import service

    rows = [(k, f"shop {k % 7}" + (" rare" if k == 77 else ""), "a", 1, float(k % 20), float(k // 20)) for k in range(400)]
    places = spark.createDataFrame(rows, "id long, name string, addr string, pcode int, lat double, lng double")
    asked = [(k, 0, float(k), 3.0, w) for k, w in enumerate(["rare", "none at all", "", "shop", "p 3", "6", "100%", "shop 1"])]
    asked += [(100 + k, 1, None, None, w) for k, w in enumerate(["rare", "nowhere", "", "op 2", "s", "p 33"])]
    requests = spark.createDataFrame(asked, "req_id long, qt int, lat double, lng double, keyword string")
    want = set()
    for req, qt, lat, lng, word in asked:
        hits = [r for r in rows if word in r[1]]
        if qt == 0:
            hits.sort(key=lambda r: ((r[4] - lat) ** 2 + (r[5] - lng) ** 2, r[0]))
        else:
            hits.sort(key=lambda r: (min([r[1][i:] for i in range(len(r[1])) if r[1].startswith(word, i)] if word else [r[1]]), r[0]))
        want |= {(req, n, r[0]) for n, r in enumerate(hits[:10], 1)}
    for rare in (2000, 0):
        monkeypatch.setattr(service, "RARE", rare)
        assert {(r.req_id, r["rank"], r.id) for r in service.answer(places, requests).collect()} == want
    text = service.answer(places, requests)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert service.answer(places.limit(0), requests).count() == 0 and service.answer(places, requests.limit(0)).count() == 0


def test_boxes_of_all_sizes(spark):
    import random

    r = random.Random(4)
    boxes = []
    for k in range(300):
        size = 10 ** r.uniform(-3, 3)
        x, y = r.uniform(-1000, 1000), r.uniform(-1000, 1000)
        boxes.append((k, x, y, x + size * r.random(), y + size * r.random()))
    boxes += [(1000, -5000.0, -5000.0, 5000.0, 5000.0), (1001, 1.0, 1.0, 1.0, 1.0), (1002, 1.0, 1.0, 1.0, 1.0), (1003, 2.0, 0.0, 1.0, 5.0)]
    df = spark.createDataFrame(boxes, "id long, min_lat double, min_lng double, max_lat double, max_lng double")
    valid = [b for b in boxes if b[1] <= b[3] and b[2] <= b[4]]
    want = sorted((a[0], b[0]) for a in valid for b in valid if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    for cell in (0.1, 50.0):
        assert sorted(map(tuple, spatial.mbr_pairs(df, cell).collect())) == want
