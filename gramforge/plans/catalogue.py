"""The queries by name, each over its whole tables, and the SQL that gives the same rows.

A query without SQL is one that SQL engines are too slow for on whole tables; tests
hold it against brute force. Searches ask for every row whose id is divisible by
50 and give every row that matches; those over columns with copies search the distinct values and name all rows of what is found. Joins of a column with copies give pairs of distinct values; ``*_membership`` has every
row's representative.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.order import shared_dir
from ..operators import extraction, grams, index, infix, parts, similarity, spatial
from ..sources import files
from . import service

EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strings(spark: SparkSession, sf_dir: str, name: str, key: str, value: str) -> DataFrame:
    return _table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), F.col(value).alias("s"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, "documents", "doc_id", "text")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, "part", "p_partkey", "p_name")


def _asked(df: DataFrame, threshold: float | None = None) -> DataFrame:
    rows = df.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("s").alias("query"))
    return rows if threshold is None else rows.withColumn("threshold", F.lit(threshold))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components of each embedding as a point, with its label."""
    at = lambda k: F.col("embedding")[k].cast("double")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("lat"), at(1).alias("lng"), "label")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the name, brand and size of the part of the same number."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("addr"), F.col("p_size").alias("pcode"))
    return _points(spark, sf_dir).drop("label").join(parts, "id")


def _nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct last words of the part names as entities, numbered by their smallest part."""
    words = _names(spark, sf_dir).select("id", F.element_at(F.split("s", " "), -1).alias("entity"))
    return words.groupBy("entity").agg(F.min("id").alias("entity_id")).select("entity_id", "entity")


def jaccard_search(spark, d):
    docs = _documents(spark, d)
    return similarity.jaccard_search(_asked(docs, 0.8), docs, 8)


def jaccard_search_brute(spark, d):
    names = _names(spark, d)
    return S.every_row(similarity.jaccard_search(_asked(names, 0.6), S.representatives(names).select("id", "s"), 2, "brute"), S.membership(names))


def ed_search(spark, d):
    names = _strings(spark, d, "customer", "c_custkey", "c_name")
    asked = names.filter(F.col("id") % EVERY == 0)
    found = similarity.ed_search(S.representatives(asked).select(F.col("id").alias("query_id"), F.col("s").alias("query")), S.representatives(names).select("id", "s"), 3, 1)
    return S.every_row(S.every_row(found, S.membership(asked), "query_id"), S.membership(names))


def ed_search_brute(spark, d):
    names = _names(spark, d)
    return S.every_row(similarity.ed_search(_asked(names), S.representatives(names).select("id", "s"), 2, 3, "brute"), S.membership(names))


def index_search(spark, d):
    """Both kinds of search, each asked of one stored index of every row."""
    path = f"{shared_dir(spark)}/gramforge-{uuid.uuid4().hex}"
    names = _names(spark, d)
    index.build(names, 2, path, 0.6, 3)
    known = index.GramIndex.load(spark, path)
    by_sim = known.jaccard_search(_asked(names, 0.6)).select("query_id", "id", F.lit("jaccard").alias("metric"), F.col("sim").alias("score"))
    by_dist = known.ed_search(_asked(names), 3).select("query_id", "id", F.lit("ed").alias("metric"), F.col("dist").cast("double").alias("score"))
    return by_sim.unionByName(by_dist)


def t_occurrence(spark, d):
    names = _names(spark, d)
    return S.every_row(similarity.t_occurrence(_asked(names, 0.6), S.representatives(names).select("id", "s"), 2), S.membership(names))


def jaccard_join(spark, d):
    """Pairs of distinct texts by their smallest ids, and that id with each copy of the text: no link of a document is left out, copies are not expanded into all pairs."""
    docs = _documents(spark, d)
    return parts.near_pairs_and_copies(docs, S.membership(docs), 8, 0.8)


def jaccard_join_count(spark, d):
    reps = S.representatives(_names(spark, d)).select("id", "s")
    return similarity.jaccard_pairs(reps, reps, 2, 0.5, self_join=True, strategy="count")


def jaccard_membership(spark, d):
    return S.membership(_documents(spark, d))


def name_membership(spark, d):
    return S.membership(_names(spark, d))


def type_membership(spark, d):
    return S.membership(_strings(spark, d, "part", "p_partkey", "p_type"))


def url_membership(spark, d):
    return S.membership(_strings(spark, d, "pages", "page_id", "url"))


def ed_join(spark, d):
    urls = S.representatives(_strings(spark, d, "pages", "page_id", "url")).select("id", "s")
    return similarity.ed_pairs(urls, urls, 3, 2, self_join=True)


def ed_join_two(spark, d):
    reps = S.representatives(_names(spark, d)).select("id", "s")
    types = S.representatives(_strings(spark, d, "part", "p_partkey", "p_type")).select("id", "s")
    return similarity.ed_pairs(reps, types, 2, 7)


def ed_join_short(spark, d):
    nations = _strings(spark, d, "nation", "n_nationkey", "n_name")
    return similarity.ed_pairs(nations, nations, 3, 2, self_join=True)


def gram_df(spark, d):
    return grams.gram_counts(_documents(spark, d), 3)


def gram_order(spark, d):
    table = grams.gram_table(_names(spark, d), 3)
    return grams.ranked(table, grams.frequencies(table)).select("id", "gram", "c", "n", "df", "before")


def prefix_index(spark, d):
    return grams.prefixes(gram_order(spark, d), S.prefix_length(F.col("n"), F.lit(0.6))).select("gram", "id", "before")


def qgrams(spark, d):
    return _strings(spark, d, "benchmark", "item_id", "text").select("id", F.posexplode(S.qgrams(F.col("s"), 3)).alias("pos", "gram"))


def string_functions(spark, d):
    part = _table(spark, d, "part")
    a, b = F.col("p_name"), F.col("p_type")
    overlap = S.multiset_overlap(S.qgrams(a, 2), S.qgrams(b, 2))
    return part.select(
        "p_partkey", overlap.alias("overlap"), S.jaccard(overlap, S.gram_count(a, 2), S.gram_count(b, 2)).alias("sim"), F.levenshtein(a, b).alias("dist"), F.levenshtein(a, b, 6).alias("dist_6"),
        S.histogram_bound(a, b).alias("bound"), F.reverse(a).alias("reversed"), F.size(S.tokens(a)).alias("n_tokens"), F.contains(a, F.lit("in")).alias("has_in"),
    )


def byte_distance(spark, d):
    item, text = _table(spark, d, "benchmark"), F.col("text")
    return item.select("item_id", F.length(S.as_bytes(text)).alias("n_bytes"), F.levenshtein(S.as_bytes(text), S.as_bytes(F.reverse(text))).alias("dist"))


def entity_segments(spark, d):
    return similarity.segments(_strings(spark, d, "benchmark", "item_id", "text"), 2)


def entity_extract_ed(spark, d):
    return extraction.extract_ed(_table(spark, d, "documents"), _table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("entity")), 2)


def _name_docs(spark, d):
    return _names(spark, d).select(F.col("id").alias("doc_id"), F.col("s").alias("text"))


def entity_extract_ed_names(spark, d):
    return extraction.extract_ed(_name_docs(spark, d), _nouns(spark, d), 1)


def entity_extract_jaccard(spark, d):
    """Whole documents by 8-grams from 0.8 on, as jaccard_search has them."""
    return extraction.extract_jaccard(_table(spark, d, "documents"), _table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("entity")), 8, 0.8)


def entity_extract_jaccard_names(spark, d):
    return extraction.extract_jaccard(_name_docs(spark, d), _nouns(spark, d), 2, 0.6)


def range_query(spark, d):
    return spatial.in_rectangle(_points(spark, d), -0.1, -0.1, 0.1, 0.1).select("id", "lat", "lng")


def knn(spark, d):
    return spatial.nearest(_points(spark, d), 0.05, -0.05).select("id", "lat", "lng", "dist2")


def knn_keyword(spark, d):
    return spatial.keyword_nearest(_places(spark, d), 0.05, -0.05, "in").select("id", "name", "dist2")


def knn_batch(spark, d):
    points = _points(spark, d)
    asked = points.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("req_id"), "lat", "lng")
    return spatial.nearest_batch(points, asked).select("req_id", "id", "dist2", F.col("rank").cast("long").alias("rank"))


def mbr_build(spark, d):
    return spatial.mbr(_points(spark, d), "label")


def mbr_point_dist(spark, d):
    """Every point against the box of the next label, the first one's after the last."""
    points = _points(spark, d)
    n = points.select((F.max("label") + 1).alias("n")).first()["n"]  # labels count from 0
    boxes = spatial.mbr(points, "label").withColumn("label", F.pmod(F.col("label") - 1, F.lit(n)))
    return points.join(boxes, "label").select("id", spatial.mbr_dist2(*map(F.col, ("lat", "lng", "min_lat", "min_lng", "max_lat", "max_lng"))).alias("dist2"))


def mbr_intersect(spark, d):
    return spatial.mbr_pairs(spatial.mbr(_points(spark, d), "label").withColumnRenamed("label", "id"), 0.1)


def infix_search(spark, d):
    names = _names(spark, d).select("id", F.col("s").alias("name"))
    return infix.infix_search(names, "in").select("id", "name", "suffix")


def autocomplete(spark, d):
    rows = _strings(spark, d, "customer", "c_custkey", "c_name").select("id", F.col("s").alias("name"))
    return infix.autocomplete(rows, "0001").select(F.explode("suggestions").alias("suggestion"))


def suffix_array(spark, d):
    return infix.suffix_array(S.representatives(_names(spark, d)).select("id", "s"))


def lcp_array(spark, d):
    return infix.lcp_array(S.representatives(_names(spark, d)).select("id", "s"))


def json_scan(spark, d):
    rows = _table(spark, d, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


def _requests(spark, d):
    points = _points(spark, d).filter(F.col("id") % EVERY == 0)
    near = F.col("id") % (2 * EVERY) == 0
    return points.select(F.col("id").alias("req_id"), F.when(near, 0).otherwise(1).alias("qt"), F.when(near, F.col("lat")).alias("lat"), F.when(near, F.col("lng")).alias("lng"), F.when(near, F.lit("e")).otherwise(F.lit("ri")).alias("keyword"))


def place_service(spark, d):
    return service.answer(_places(spark, d), _requests(spark, d)).select("req_id", F.col("rank").cast("long").alias("rank"), "id", "name")


def json_reply(spark, d):
    return files.json_response(service.answer(_places(spark, d), _requests(spark, d)), "req_id")


def _written(spark: SparkSession, rows: DataFrame) -> str:
    """rows (key, value) as lines of text files in order of key, in the shared folder."""
    path = f"{shared_dir(spark)}/gramforge-{uuid.uuid4().hex}"
    rows.orderBy("key").select("value").write.text(path)
    return path


def text_scan(spark, d):
    return files.read_strings(spark, _written(spark, _names(spark, d).toDF("key", "value")))


def pair_scan(spark, d):
    """The two inputs of a join: how many equal lines they have at equal places."""
    names, types = (_strings(spark, d, "part", "p_partkey", c).toDF("key", "value") for c in ("p_name", "p_type"))
    a, b = files.read_pair(spark, _written(spark, names), _written(spark, types))
    return a.join(b.select("id", F.col("s").alias("t")), "id").select("id", "s", "t")


def query_scan(spark, d):
    rows = _names(spark, d).select(F.col("id").alias("key"), F.concat("s", F.lit("\t"), F.format_string("0.%02d", F.col("id") % 100)).alias("value"))
    return files.read_queries(spark, _written(spark, rows))


def place_scan(spark, d):
    place = F.struct("addr", "name", "pcode", F.array("lat", "lng").alias("latlng"))
    return files.read_places(spark, _written(spark, _places(spark, d).select(F.col("id").alias("key"), F.to_json(place).alias("value"))))


def request_scan(spark, d):
    near = F.concat(F.lit("0\n"), F.col("lat").cast("string"), F.lit(" "), F.col("lng").cast("string"), F.lit(" "), F.col("name"))
    bodies = _places(spark, d).select(F.col("id").alias("req_id"), F.when(F.col("id") % 2 == 0, near).otherwise(F.concat(F.lit("1\n"), F.col("name"))).alias("body"))
    return files.parse_requests(bodies)


def search_lines(spark, d):
    names = _names(spark, d)
    asked, data = _asked(names, 0.6), S.representatives(names).select("id", "s")
    return files.search_lines(asked, S.every_row(similarity.jaccard_search(asked, data, 2), S.membership(names)), names)


def join_lines(spark, d):
    reps = S.representatives(_names(spark, d)).select("id", "s")
    return files.join_lines(similarity.ed_pairs(reps, reps, 2, 3, self_join=True), reps, reps)


def extract_lines(spark, d):
    return files.extract_lines(extraction.extract(_name_docs(spark, d), _nouns(spark, d), "ed", threshold=1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        jaccard_search, jaccard_search_brute, ed_search, ed_search_brute, index_search, t_occurrence, jaccard_join, jaccard_join_count, jaccard_membership, name_membership, type_membership, url_membership, ed_join, ed_join_two, ed_join_short,
        gram_df, gram_order, prefix_index, qgrams, string_functions, byte_distance, entity_segments, entity_extract_ed, entity_extract_ed_names, entity_extract_jaccard, entity_extract_jaccard_names,
        range_query, knn, knn_keyword, knn_batch, mbr_build, mbr_point_dist, mbr_intersect, infix_search, autocomplete, suffix_array, lcp_array, json_scan, place_service, json_reply,
        text_scan, pair_scan, query_scan, place_scan, request_scan, search_lines, join_lines, extract_lines,
    ]
    return {f.__name__: f for f in found}


def _grams_sql(name: str, source: str, q: int) -> str:
    """CTEs name (id, gram, c) and name_n (id, n) of source (id, s)."""
    return f"""{name}_i AS (SELECT id, s, unnest(range(1, length(s) - {q - 2})) AS i FROM ({source}) WHERE length(s) >= {q}),
{name} AS (SELECT id, substr(s, i, {q}) AS gram, count(*) AS c FROM {name}_i GROUP BY 1, 2), {name}_n AS (SELECT id, sum(c) AS n FROM {name} GROUP BY 1)"""


def _reps_sql(table: str, key: str, value: str) -> str:
    return f"SELECT min(CAST({key} AS BIGINT)) AS id, {value} AS s FROM {table} WHERE {value} IS NOT NULL GROUP BY {value}"


def _membership_sql(table: str, key: str, value: str) -> str:
    return f"SELECT CAST({key} AS BIGINT) AS id, CAST(min({key}) OVER (PARTITION BY {value}) AS BIGINT) AS rep FROM {table} WHERE {value} IS NOT NULL"


def _jaccard_sql(left: str, right: str, q: int, theta: float, names=("query_id", "id"), more: str = "") -> str:
    return f"""WITH {_grams_sql('a', left, q)}, {_grams_sql('b', right, q)},
o AS (SELECT a.id AS x, b.id AS y, sum(least(a.c, b.c)) AS o FROM a JOIN b ON a.gram = b.gram {more} GROUP BY 1, 2)
SELECT x AS {names[0]}, y AS {names[1]}, CAST(o AS DOUBLE) / CAST(p.n + r.n - o AS DOUBLE) AS sim FROM o JOIN a_n p ON p.id = x JOIN b_n r ON r.id = y WHERE CAST(o AS DOUBLE) / CAST(p.n + r.n - o AS DOUBLE) >= {theta}"""


def _ed_sql(left: str, right: str, tau: int, names=("query_id", "id"), more: str = "") -> str:
    return f"SELECT a.id AS {names[0]}, b.id AS {names[1]}, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist FROM ({left}) a JOIN ({right}) b ON levenshtein(a.s, b.s) <= {tau} {more}"


_P = "SELECT p_partkey AS id, p_name AS s FROM part"
_PQ = f"{_P} WHERE p_partkey % {EVERY} = 0"
_PR = _reps_sql("part", "p_partkey", "p_name")
_POINTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lng, label FROM embeddings"
_PLACES = f"SELECT e.id, lat, lng, p_name AS name FROM ({_POINTS}) e JOIN part ON p_partkey = e.id"
_NOUNS = "SELECT min(p_partkey) AS entity_id, string_split(p_name, ' ')[-1] AS entity FROM part GROUP BY 2"
_BOX = "min(lat) AS min_lat, min(lng) AS min_lng, max(lat) AS max_lat, max(lng) AS max_lng"
_ORDER = f"""WITH {_grams_sql('a', _P, 3)}, f AS (SELECT gram, sum(c) AS df FROM a GROUP BY 1)
SELECT a.id, a.gram, a.c, CAST(n AS INTEGER) AS n, CAST(df AS BIGINT) AS df, CAST(coalesce(sum(a.c) OVER (PARTITION BY a.id ORDER BY df, a.gram ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM a JOIN f ON a.gram = f.gram JOIN a_n ON a_n.id = a.id"""
_SUFFIXES = f"SELECT row_number() OVER (ORDER BY substr(s, i), id, i) - 1 AS rank, id, CAST(i - 1 AS INTEGER) AS pos, substr(s, i) AS suffix FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM ({_PR}))"
_WINDOWS = "SELECT p_partkey AS doc_id, p_name AS text, entity_id, entity, i, l FROM part, n, unnest(range(1, length(p_name) + 1)) t(i), unnest(range(1, length(p_name) + 1)) u(l) WHERE i + l - 1 <= length(p_name)"


def _lcp_sql() -> str:
    return f"""WITH x AS ({_SUFFIXES}), y AS (SELECT *, lag(suffix) OVER (ORDER BY rank) AS prev FROM x)
SELECT rank, id, pos, CAST(coalesce((SELECT max(k) FROM unnest(range(0, 40)) t(k) WHERE k <= length(suffix) AND k <= length(prev) AND substr(suffix, 1, k) = substr(prev, 1, k)), 0) AS INTEGER) AS lcp FROM y"""


def _bound_sql() -> str:
    letters = " + ".join(f"abs((length(p_name) - length(replace(p_name, chr({k}), ''))) - (length(p_type) - length(replace(p_type, chr({k}), ''))))" for k in range(32, 127))
    return f"CAST(ceil(({letters}) / 2.0) AS INTEGER)"


def oracle_sql() -> dict[str, str]:
    docs = "SELECT doc_id AS id, text AS s FROM documents WHERE text IS NOT NULL"
    customers = "SELECT c_custkey AS id, c_name AS s FROM customer"
    nations = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS s FROM nation"
    near = "(lat - 0.05) * (lat - 0.05) + (lng + 0.05) * (lng + 0.05)"
    requests = f"SELECT id AS req_id, id % {2 * EVERY} = 0 AS near, lat AS lat0, lng AS lng0, CASE WHEN id % {2 * EVERY} = 0 THEN 'e' ELSE 'ri' END AS kw FROM ({_POINTS}) WHERE id % {EVERY} = 0"
    overlap = f"""WITH {_grams_sql('a', _P, 2)}, {_grams_sql('b', 'SELECT p_partkey AS id, p_type AS s FROM part', 2)}, o AS (SELECT a.id, sum(least(a.c, b.c)) AS o FROM a JOIN b ON a.id = b.id AND a.gram = b.gram GROUP BY 1),
v AS (SELECT part.*, CAST(coalesce(o, 0) AS INTEGER) AS overlap, levenshtein(p_name, p_type) AS l FROM part LEFT JOIN o ON o.id = p_partkey)"""
    return {
        "jaccard_search": _jaccard_sql(f"{docs} AND doc_id % {EVERY} = 0", docs, 8, 0.8),
        "jaccard_search_brute": _jaccard_sql(_PQ, _P, 2, 0.6),
        "ed_search": _ed_sql(f"{customers} WHERE c_custkey % {EVERY} = 0", customers, 1),
        "ed_search_brute": _ed_sql(_PQ, _P, 3),
        "index_search": f"SELECT query_id, id, 'jaccard' AS metric, sim AS score FROM ({_jaccard_sql(_PQ, _P, 2, 0.6)}) UNION ALL SELECT query_id, id, 'ed', CAST(dist AS DOUBLE) FROM ({_ed_sql(_PQ, _P, 3)})",
        "t_occurrence": f"""WITH {_grams_sql('a', _PQ, 2)}, {_grams_sql('b', _P, 2)}, g AS (SELECT min(n) AS least FROM b_n),
o AS (SELECT a.id AS query_id, b.id, sum(least(a.c, b.c)) AS cnt FROM a JOIN b ON a.gram = b.gram GROUP BY 1, 2)
SELECT query_id, o.id, CAST(cnt AS BIGINT) AS cnt FROM o JOIN a_n ON a_n.id = query_id, g WHERE cnt >= ceil(greatest(0.6::DOUBLE * n, (n + least) * 0.6::DOUBLE / 1.6::DOUBLE) - 1e-8::DOUBLE)""",
        "jaccard_join": _jaccard_sql(_reps_sql("documents", "doc_id", "text"), _reps_sql("documents", "doc_id", "text"), 8, 0.8, ("id1", "id2"), "AND a.id < b.id")
        + f" UNION ALL SELECT rep, id, 1.0::DOUBLE FROM ({_membership_sql('documents', 'doc_id', 'text')} AND length(text) >= 8) WHERE id <> rep",
        "jaccard_join_count": _jaccard_sql(_PR, _PR, 2, 0.5, ("id1", "id2"), "AND a.id < b.id"),
        "jaccard_membership": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL",
        "name_membership": _membership_sql("part", "p_partkey", "p_name"),
        "type_membership": _membership_sql("part", "p_partkey", "p_type"),
        "url_membership": _membership_sql("pages", "page_id", "url"),
        "ed_join": _ed_sql(_reps_sql("pages", "page_id", "url"), _reps_sql("pages", "page_id", "url"), 2, ("id1", "id2"), "AND a.id < b.id"),
        "ed_join_two": _ed_sql(_PR, _reps_sql("part", "p_partkey", "p_type"), 7, ("id1", "id2")),
        "ed_join_short": _ed_sql(nations, nations, 2, ("id1", "id2"), "AND a.id < b.id"),
        "gram_df": f"WITH {_grams_sql('a', docs, 3)} SELECT gram, CAST(sum(c) AS BIGINT) AS df FROM a GROUP BY 1",
        "gram_order": _ORDER,
        "prefix_index": f"SELECT gram, id, before FROM ({_ORDER}) WHERE before < n - ceil(0.6::DOUBLE * n - 1e-8::DOUBLE) + 1",
        "qgrams": "SELECT id, CAST(i - 1 AS INTEGER) AS pos, substr(s, i, 3) AS gram FROM (SELECT item_id AS id, text AS s, unnest(range(1, length(text) - 1)) AS i FROM benchmark WHERE length(text) >= 3)",
        "entity_segments": """SELECT id, CAST(k AS INTEGER) AS seg_no, CAST(k * (n // 3) + least(k, n % 3) AS INTEGER) AS seg_off, substr(s, k * (n // 3) + least(k, n % 3) + 1, n // 3 + (k < n % 3)::INT) AS seg
FROM (SELECT item_id AS id, text AS s, length(text) AS n, unnest([0, 1, 2]) AS k FROM benchmark)""",
        "entity_extract_ed_names": f"WITH n AS ({_NOUNS}), w AS ({_WINDOWS}) SELECT doc_id, entity_id, CAST(i - 1 AS INTEGER) AS pos, CAST(l AS INTEGER) AS len, CAST(levenshtein(substr(text, i, l), entity) AS INTEGER) AS dist FROM w WHERE levenshtein(substr(text, i, l), entity) <= 1",
        "range_query": f"SELECT id, lat, lng FROM ({_POINTS}) WHERE lat BETWEEN -0.1 AND 0.1 AND lng BETWEEN -0.1 AND 0.1",
        "knn": f"SELECT id, lat, lng, {near} AS dist2 FROM ({_POINTS}) ORDER BY dist2, id LIMIT 10",
        "knn_keyword": f"SELECT id, name, {near} AS dist2 FROM ({_PLACES}) WHERE contains(name, 'in') ORDER BY dist2, id LIMIT 10",
        "knn_batch": f"SELECT * FROM (SELECT q.id AS req_id, p.id, (p.lat - q.lat) * (p.lat - q.lat) + (p.lng - q.lng) * (p.lng - q.lng) AS dist2, row_number() OVER (PARTITION BY q.id ORDER BY dist2, p.id) AS rank FROM ({_POINTS}) q, ({_POINTS}) p WHERE q.id % {EVERY} = 0) WHERE rank <= 10",
        "mbr_build": f"SELECT label, {_BOX} FROM ({_POINTS}) GROUP BY label",
        "mbr_point_dist": f"WITH b AS (SELECT label, {_BOX} FROM ({_POINTS}) GROUP BY label), j AS (SELECT id, greatest(min_lat - lat, 0.0, lat - max_lat) AS dx, greatest(min_lng - lng, 0.0, lng - max_lng) AS dy FROM ({_POINTS}) p JOIN b ON b.label = (p.label + 1) % (SELECT count(*) FROM b)) SELECT id, dx * dx + dy * dy AS dist2 FROM j",
        "mbr_intersect": f"WITH b AS (SELECT label AS id, {_BOX} FROM ({_POINTS}) GROUP BY label) SELECT a.id AS id1, b.id AS id2 FROM b a JOIN b ON a.id < b.id AND a.min_lat <= b.max_lat AND b.min_lat <= a.max_lat AND a.min_lng <= b.max_lng AND b.min_lng <= a.max_lng",
        "infix_search": "SELECT id, name, min(suffix) AS suffix FROM (SELECT p_partkey AS id, p_name AS name, substr(p_name, i) AS suffix FROM part, unnest(range(1, length(p_name) + 1)) t(i)) WHERE starts_with(suffix, 'in') GROUP BY 1, 2 ORDER BY 3, 1 LIMIT 10",
        "autocomplete": "SELECT name AS suggestion FROM (SELECT c_custkey AS id, c_name AS name, min(suffix) AS suffix FROM (SELECT c_custkey, c_name, substr(c_name, i) AS suffix FROM customer, unnest(range(1, length(c_name) + 1)) t(i)) WHERE starts_with(suffix, '0001') GROUP BY 1, 2 ORDER BY 3, 1 LIMIT 10)",
        "suffix_array": _SUFFIXES,
        "lcp_array": _lcp_sql(),
        "json_scan": "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2",
        "place_service": f"""WITH r AS ({requests}), p AS ({_PLACES}),
m AS (SELECT req_id, near, p.id, name, CASE WHEN near THEN (lat - lat0) * (lat - lat0) + (lng - lng0) * (lng - lng0) END AS d, CASE WHEN NOT near THEN (SELECT min(substr(name, i)) FROM unnest(range(1, length(name) + 1)) t(i) WHERE starts_with(substr(name, i), kw)) END AS x FROM r JOIN p ON contains(name, kw))
SELECT * FROM (SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY d, x, id) AS rank, id, name FROM m) WHERE rank <= 10""",
        "byte_distance": "SELECT item_id, CAST(strlen(text) AS INTEGER) AS n_bytes, CAST(levenshtein(text, reverse(text)) AS INTEGER) AS dist FROM benchmark",
        "entity_extract_jaccard_names": f"""WITH n AS ({_NOUNS}), x AS (SELECT DISTINCT p_name AS text FROM part),
w AS (SELECT text, i, l, substr(text, i, l) AS s FROM x, unnest(range(1, length(text) + 1)) t(i), unnest(range(2, length(text) + 1)) u(l) WHERE i + l - 1 <= length(text)),
a AS (SELECT s, substr(s, k, 2) AS g, count(*) AS c FROM (SELECT DISTINCT s FROM w), unnest(range(1, length(s))) t(k) GROUP BY 1, 2), b AS (SELECT entity_id, length(entity) - 1 AS m, substr(entity, k, 2) AS g, count(*) AS c FROM n, unnest(range(1, length(entity))) t(k) GROUP BY 1, 2, 3),
o AS (SELECT s, entity_id, m, sum(least(a.c, b.c)) AS o FROM a JOIN b USING (g) GROUP BY 1, 2, 3), f AS (SELECT s, entity_id, CAST(o AS DOUBLE) / CAST(length(s) - 1 + m - o AS DOUBLE) AS sim FROM o)
SELECT p_partkey AS doc_id, entity_id, CAST(i - 1 AS INTEGER) AS pos, CAST(l AS INTEGER) AS len, sim FROM f JOIN w USING (s) JOIN part ON p_name = text WHERE sim >= 0.6""",
        "text_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_name AS s FROM part",
        "pair_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_name AS s, p_type AS t FROM part",
        "query_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS query_id, p_name AS query, CAST('0.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS threshold FROM part",
        "place_scan": f"SELECT row_number() OVER (ORDER BY e.id) - 1 AS id, p_brand AS addr, p_name AS name, p_size AS pcode, lat, lng FROM ({_POINTS}) e JOIN part ON p_partkey = e.id",
        "request_scan": f"SELECT id AS req_id, CAST(id % 2 AS INTEGER) AS qt, CASE WHEN id % 2 = 0 THEN lat END AS lat, CASE WHEN id % 2 = 0 THEN lng END AS lng, name AS keyword FROM ({_PLACES})",
        "search_lines": f"""SELECT p_partkey AS query_id, -1 AS line_no, printf('+ %.2f %s', 0.6::DOUBLE, p_name) AS line FROM part WHERE p_partkey % {EVERY} = 0
UNION ALL SELECT query_id, j.id, printf('  %.6f %s', sim, s) FROM ({_jaccard_sql(_PQ, _P, 2, 0.6)}) j JOIN ({_P}) r ON r.id = j.id""",
        "join_lines": f"SELECT a.id AS id1, b.id AS id2, '+ ' || a.id || ' ' || b.id || ' ' || levenshtein(a.s, b.s) || ' ' || a.s || ' ' || b.s AS line FROM ({_PR}) a JOIN ({_PR}) b ON a.id < b.id AND levenshtein(a.s, b.s) <= 3",
        "extract_lines": f"WITH n AS ({_NOUNS}), w AS ({_WINDOWS}) SELECT doc_id, entity_id, doc_id || ' ' || entity_id || ' ' || (i - 1) || ' ' || l || ' ' || levenshtein(substr(text, i, l), entity) AS line FROM w WHERE levenshtein(substr(text, i, l), entity) <= 1",
        "string_functions": f"""{overlap} SELECT p_partkey, overlap, CAST(overlap AS DOUBLE) / CAST(length(p_name) + length(p_type) - 2 - overlap AS DOUBLE) AS sim, CAST(l AS INTEGER) AS dist, CAST(CASE WHEN l <= 6 THEN l ELSE -1 END AS INTEGER) AS dist_6,
{_bound_sql()} AS bound, reverse(p_name) AS reversed, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_tokens, contains(p_name, 'in') AS has_in FROM v""",
    }
