"""Readers and writers of the text formats: lines, tab-separated queries, JSON places, requests and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import with_rank

PLACE = "addr STRING, name STRING, pcode INT, latlng ARRAY<DOUBLE>"


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(id, s): the lines of text files in order, numbered from 0; no limit on a line's length."""
    rows = spark.read.text(path).select(F.col("value").alias("s"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    return with_rank(rows, "file_path", "file_block_start", "_at", name="id").select(F.col("id").cast("long").alias("id"), "s")


def read_pair(spark: SparkSession, path1: str, path2: str) -> tuple[DataFrame, DataFrame]:
    """The two inputs of a join."""
    return read_strings(spark, path1), read_strings(spark, path2)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, threshold) from lines of query, tab, threshold; a malformed line fails."""
    lines = read_strings(spark, path)
    parts = F.split("s", "\t")
    bad = F.raise_error(F.concat(F.lit("malformed query line: "), F.col("s")))
    value = F.when(F.size(parts) == 2, F.element_at(parts, 2).try_cast("double"))
    return lines.select(F.col("id").alias("query_id"), F.element_at(parts, 1).alias("query"), F.coalesce(value, bad.cast("double")).alias("threshold"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(id, addr, name, pcode, lat, lng) from JSON lines; a malformed line fails."""
    rows = spark.read.schema(PLACE).option("mode", "FAILFAST").json(path)
    rows = rows.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    rows = with_rank(rows, "file_path", "file_block_start", "_at", name="id")
    return rows.select(F.col("id").cast("long").alias("id"), "addr", "name", "pcode", F.col("latlng")[0].alias("lat"), F.col("latlng")[1].alias("lng"))


def parse_requests(bodies: DataFrame) -> DataFrame:
    """(req_id, qt, lat, lng, keyword) of (req_id, body): "0", line end, "lat lng keyword"; or "1", line end, keyword."""
    first, rest = F.substring_index("body", "\n", 1), F.expr("substr(body, instr(body, '\n') + 1)")
    line = F.regexp_replace(rest, r"\r?\n?$", "")
    part = lambda k: F.regexp_extract(line, r"^\s*(\S+)\s+(\S+)(?:\s(.*))?$", k)
    near = F.trim(first) == "0"
    return bodies.select(
        "req_id", F.trim(first).try_cast("int").alias("qt"), F.when(near, part(1).try_cast("double")).alias("lat"), F.when(near, part(2).try_cast("double")).alias("lng"),
        F.when(near, part(3)).otherwise(line).alias("keyword"),
    )


def json_response(rows: DataFrame, *keys: str, order: str = "rank") -> DataFrame:
    """A JSON array of {lat, lng, addr, name, pcode} for each group, in the given order; groups are replies of a few rows."""
    item = F.struct("lat", "lng", "addr", "name", "pcode")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(ordered, lambda x: x["i"])).alias("response"))


def search_lines(queries: DataFrame, found: DataFrame, data: DataFrame) -> DataFrame:
    """(query_id, line_no, line): "+ threshold query", then "  sim string" for each hit by ascending id."""
    head = queries.select("query_id", F.lit(-1).cast("long").alias("line_no"), F.format_string("+ %.2f %s", F.col("threshold"), F.col("query")).alias("line"))
    hits = found.join(data, "id").select("query_id", F.col("id").alias("line_no"), F.format_string("  %.6f %s", F.col("sim"), F.col("s")).alias("line"))
    return head.unionByName(hits)


def join_lines(pairs: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(id1, id2, line): "+ id1 id2 score", with both strings if they are given."""
    score = "sim" if "sim" in pairs.columns else "dist"
    rows, parts = pairs, [F.lit("+"), F.col("id1").cast("string"), F.col("id2").cast("string"), F.col(score).cast("string")]
    if left is not None and right is not None:
        rows = rows.join(left.select(F.col("id").alias("id1"), F.col("s").alias("_a")), "id1").join(right.select(F.col("id").alias("id2"), F.col("s").alias("_b")), "id2")
        parts += [F.col("_a"), F.col("_b")]
    return rows.select("id1", "id2", F.concat_ws(" ", *parts).alias("line"))


def extract_lines(found: DataFrame) -> DataFrame:
    """(doc_id, entity_id, line): "doc_id entity_id pos len score"."""
    score = "sim" if "sim" in found.columns else "dist"
    return found.select("doc_id", "entity_id", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("doc_id", "entity_id", "pos", "len", score))).alias("line"))
