"""URL filters: a temporal list join.

A list is kept as dated entries (list, kind, value, action, at): an entry that is
added counts from at on until the next entry of the same list, kind and value.
Entries become validity intervals; a capture meets, by an as-of equi-join on
(kind, value) with its fetch time inside the interval, the entries active when
it was fetched. Intervals of one key do not overlap, so a capture meets
each key of a list once at most. A key that many captures have (a large host, a common
word) is spread over tasks; keys that no list has drop out before that join.

A capture's keys are its host and the host's parent domains (kind "domain"), host
and path up to each slash (kind "path"), and the words of its URL (kind "word").

Defined cases: a null, empty or unparsable URL has no keys and is allowed; a
capture without fetch time meets no entry; entries with equal keys and times: a
"remove" wins; entries with a null in any column are ignored; repeated captures
are judged each for itself; an allow list overrides block lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, met

ALLOW = "allow"


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, value, since, until (null: still active); since is inclusive, until exclusive."""
    known = entries.select("list", "kind", F.lower("value").alias("value"), "action", "at").dropna()
    known = known.groupBy("list", "kind", "value", "at").agg(F.max(F.col("action") == "remove").alias("gone"))
    runs = known.withColumn("until", F.lead("at").over(Window.partitionBy("list", "kind", "value").orderBy("at")))
    return runs.filter("NOT gone").select("list", "kind", "value", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; an empty string if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]*[^/?#@:.])\.?(?::[0-9]*)?(?:[/?#]|$)", 1)


def keys(captures: DataFrame) -> DataFrame:
    """A row for each capture and key: the columns of captures, kind, value."""
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    df = captures.withColumn("_host", host(F.col("url"))).withColumn("_labels", F.split("_host", r"\."))
    df = df.withColumn("_steps", F.split(path, "/")).withColumn("_words", F.array_distinct(F.filter(F.split(url, "[^a-z0-9]+"), lambda w: w != "")))
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    domains = F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")
    paths = F.expr("transform(filter(sequence(1, size(_steps)), i -> i > 1), i -> concat(_host, array_join(slice(_steps, 1, i - 1), '/'), '/'))")
    all_keys = F.when(F.col("_host") == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.concat(named("domain", domains), named("path", F.array_distinct(paths)), named("word", F.col("_words"))))
    return df.withColumn("_k", F.explode(all_keys)).select(*captures.columns, "_k.kind", "_k.value")


def judge(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_block, n_allow (active entries met) and blocked, for captures with page_id, url and fetched.

    Equal captures have equal verdicts: they are judged once and counted.
    """
    base = captures.select("page_id", "url", "fetched").groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("_copies"))
    asked = keys(base.select("page_id", "url", "fetched"))
    lists = spans.groupBy("kind", "value").agg(F.collect_list(F.struct("list", "since", "until")).alias("entries"))  # a key's own history
    counts = asked.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    hits = met(asked, cut(lists.join(counts, ["kind", "value"])), ["kind", "value"])
    active = F.filter("entries", lambda e: (F.col("fetched") >= e["since"]) & (e["until"].isNull() | (F.col("fetched") < e["until"])))
    hits = hits.withColumn("_e", active)
    of = lambda allow: F.sum(F.size(F.filter("_e", lambda e: (e["list"] == ALLOW) == F.lit(allow))))
    found = hits.groupBy("page_id", "url", "fetched").agg(of(False).alias("n_block"), of(True).alias("n_allow"))
    m = found.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("fetched").alias("_at"), "n_block", "n_allow")
    joined = base.join(m, F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & F.col("fetched").eqNullSafe(F.col("_at")), "left")
    out = joined.select("page_id", "url", "fetched", F.coalesce("n_block", F.lit(0)).cast("long").alias("n_block"), F.coalesce("n_allow", F.lit(0)).cast("long").alias("n_allow"), "_copies")
    out = out.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))
    return out.withColumn("_c", F.explode(F.expr("sequence(1L, _copies)"))).drop("_c", "_copies")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures; the table has no fetch time, so page k counts as fetched k hours, modulo a year, into 2023."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched", F.expr("timestamp'2023-01-01 00:00:00' + make_dt_interval(0, cast(pmod(page_id, 8760) as int))"))


def derived_lists(captures: DataFrame) -> DataFrame:
    """Dated entries (list, kind, value, action, at) for the test tables, which have no lists: about a fifth of all keys of the captures' URLs.

    The digits of md5("kind value") decide. Digit 1: 0 and 1 spam, 2 allow; of other keys none is listed.
    Digits 2 and 3: day of 2023 of the first "add". Digit 4 below 8: "remove" after 1 to 256 days
    (digits 5 and 6); then digit 7 below 8: "add" again 30 days later. A list thus
    grows with the table, and holds hot hosts and common words as well as single pages.
    """
    known = keys(captures.select("url")).groupBy("kind", "value").agg(F.md5(F.concat_ws(" ", "kind", "value")).alias("c"))
    number = lambda at, n: F.conv(F.substring("c", at, n), 16, 10).cast("int")
    named = F.when(number(1, 1) < 2, "spam").when(number(1, 1) == 2, ALLOW)
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2023-01-01 00:00:00").cast("timestamp"))
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("at"))
    add, gone = number(2, 2), number(2, 2) + 1 + number(5, 2)
    history = F.when(number(4, 1) >= 8, F.array(entry("add", add))).when(number(7, 1) >= 8, F.array(entry("add", add), entry("remove", gone)))
    history = history.otherwise(F.array(entry("add", add), entry("remove", gone), entry("add", gone + 30)))
    return known.select(named.alias("list"), "kind", "value", F.explode(history).alias("e")).filter("list IS NOT NULL").select("list", "kind", "value", "e.action", "e.at")


_D = "TIMESTAMP '2023-01-01 00:00:00' + to_days"
_N = lambda at, n: f"CAST('0x' || substr(c, {at}, {n}) AS INTEGER)"
URL_SQL = rf"""
WITH p AS (SELECT page_id, url, lower(url) AS u, TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST(page_id % 8760 AS INTEGER)) AS fetched FROM pages),
h AS (SELECT *, regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM p),
v AS (SELECT DISTINCT 'domain' AS kind, substr('.' || host, i + 1) AS value FROM h, unnest(range(1, length(host) + 1)) t(i) WHERE substr('.' || host, i, 1) = '.'
  UNION SELECT DISTINCT 'path', host || substr(path, 1, i) FROM h, unnest(range(1, length(path) + 1)) t(i) WHERE substr(path, i, 1) = '/'
  UNION SELECT DISTINCT 'word', w FROM h, unnest(regexp_split_to_array(u, '[^a-z0-9]+')) t(w) WHERE w <> ''),
c AS (SELECT *, CASE WHEN {_N(1, 1)} < 2 THEN 'spam' WHEN {_N(1, 1)} = 2 THEN 'allow' END AS list, {_N(2, 2)} AS a, {_N(2, 2)} + 1 + {_N(5, 2)} AS b, {_N(4, 1)} < 8 AS x, {_N(7, 1)} < 8 AS y FROM (SELECT *, md5(kind || ' ' || value) AS c FROM v)),
e AS (SELECT list, kind, value, 'add' AS action, {_D}(a) AS since FROM c WHERE list IS NOT NULL UNION ALL SELECT list, kind, value, 'remove', {_D}(b) FROM c WHERE list IS NOT NULL AND x UNION ALL SELECT list, kind, value, 'add', {_D}(b + 30) FROM c WHERE list IS NOT NULL AND x AND y),
g AS (SELECT list, kind, lower(value) AS value, since, max((action = 'remove')::INT) AS gone FROM e GROUP BY ALL),
s AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, value ORDER BY since) AS until FROM g),
m AS (SELECT h.page_id, h.url, h.fetched, s.list, s.kind, s.value FROM h JOIN s ON gone = 0 AND fetched >= since AND (until IS NULL OR fetched < until) AND CASE kind
  WHEN 'domain' THEN host = value OR ends_with(host, '.' || value)
  WHEN 'path' THEN starts_with(host || path, value) AND ends_with(value, '/')
  ELSE list_contains(regexp_split_to_array(u, '[^a-z0-9]+'), value) END),
k AS (SELECT page_id, sum((list <> 'allow')::INT) AS b, sum((list = 'allow')::INT) AS a FROM m GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, CAST(coalesce(b, 0) AS BIGINT) AS n_block, CAST(coalesce(a, 0) AS BIGINT) AS n_allow, coalesce(b, 0) > 0 AND coalesce(a, 0) = 0 AS blocked
FROM p LEFT JOIN k ON p.page_id = k.page_id
"""
