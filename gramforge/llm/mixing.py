"""Mixing sources to target weights: a low-discrepancy source schedule.

Slot k of the mix gets the golden-ratio point frac((k + 1) * phi). Mapped through
the sources' cumulative targets it names the slot's source, so every prefix of
the mix is close to the targets. Slots are ranked within their source; the r-th
slot of a source takes the r-th block of that source, where a source is a stream
of its documents in hashed order, cut into blocks of equally many words and
repeated up to three times.

No group is collected: offsets within a source are two-level prefix sums over
(source, hash bucket), ranks of slots two-level over (source, run of slots), and
the range lookup of a point is an equi-join on a grid cell. One row with the
total goes to the driver. Only built-in functions run.

Defined cases: a null text has size 0; a document of size 0 takes 0; sources sort
by code point with the null source last; repeated rows are documents of their own
(rows with equal ids and sizes are interchangeable); without any words all
targets are 0; other columns are carried by ``offsets`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, restored, word_array, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
PHI = 0.6180339887498949
BUCKETS = 1 << 14
CELLS = 4096
RUN = 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text")))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 50).cast("int"))


def source_targets(sums: DataFrame) -> DataFrame:
    """sid, source, weight, source_size, target and the bounds lo, hi of its share of [0, 1), from sums (source, size).

    Targets share all words by weight but stop at three times the source's size;
    in order of cap over weight the capped sources come first, and the first that
    isn't capped gives the level of all later ones.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    rise = every.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    upto = every.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = sums.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", MAX_REPEATS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(rise), F.lit(0.0))
    s = s.withColumn("_left", F.sum("source_size").over(every) - before("cap")).withColumn("_weights", F.sum("weight").over(every) - before("weight"))
    s = s.withColumn("_level", F.when(F.col("_left") * F.col("weight") < F.col("cap") * F.col("_weights"), F.struct("ratio", "sid", (F.col("_left") / F.col("_weights")).alias("v"))))
    s = s.withColumn("_level", F.min("_level").over(every))
    s = s.withColumn("target", F.when(F.struct("ratio", "sid") < F.struct("_level.ratio", "_level.sid"), F.col("cap")).otherwise(F.col("_level.v") * F.col("weight")))
    s = s.withColumn("target", F.coalesce("target", "cap")).withColumn("_sum", F.sum("target").over(every))
    s = s.withColumn("hi", F.when(F.col("_sum") > 0, F.sum("target").over(upto) / F.col("_sum")).otherwise(0.0))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("sid")), F.lit(0.0)))
    return s.select("sid", "source", "weight", "source_size", "target", "lo", "hi")


def offsets(docs: DataFrame, targets: DataFrame, seed: int = 7, sums: DataFrame | None = None) -> DataFrame:
    """docs (with size) and sid, source_size, target, start: a document's place in its source's stream of words."""
    keyed = _keyed(docs, seed)
    sums = keyed.groupBy("source", "_b").agg(F.sum("size").alias("size")) if sums is None else sums
    ahead = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select("source", "_b", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_base"))
    places = places.join(targets, places["source"].eqNullSafe(targets["source"])).select(places["source"].alias("_s"), F.col("_b").alias("_c"), "_base", "sid", "source_size", "target")
    ties = [c for c in ("doc_id", "size", "_k1", "_k2") if c in docs.columns]
    inside = Window.partitionBy("source", "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = own["source"].eqNullSafe(F.col("_s")) & (own["_b"] == F.col("_c"))
    return own.join(places, on).select(*docs.columns, "sid", "source_size", "target", (F.col("_base") + F.col("_own")).alias("start"))


def block_words(total: int) -> int:
    """Words in a block: 1/2**17 of the mix, between 1 and 2048."""
    return max(1, min(2048, total >> 17))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """slot, sid, rank: the source of each slot of the mix and the slot's rank within that source."""
    spark = targets.sparkSession
    point = F.expr(f"(id + 1) * {PHI}D")
    points = spark.range(0, slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    last = F.greatest(F.floor(F.col("lo") * CELLS), F.ceil(F.col("hi") * CELLS) - 1)
    spans = targets.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), last.cast("int")))).select("cell", "sid", "lo", "hi")
    named = points.join(spans, "cell").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    ahead = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy("sid", "run").count().select("sid", "run", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    return ranked.join(bases, ["sid", "run"]).select("slot", "sid", (F.col("base") + F.col("r")).alias("rank"))


def mix(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The mix itself: slot, sid, start (which names the document within its source), pass, first, words.

    Of a document that starts at start in its source's stream, the slot's block
    holds the words first to first + words - 1 in that pass over the source.
    """
    docs = placed.filter("size > 0").select("sid", "start", "size", "source_size").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    docs = docs.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    need = slots.groupBy("sid").agg(F.max("rank").alias("top"))
    docs = docs.join(need, "sid").withColumn("b0", F.expr(f"at div {block}")).withColumn("b1", F.least(F.expr(f"(at + size - 1) div {block}"), F.col("top"))).filter("b0 <= b1")
    pieces = docs.withColumn("rank", F.explode(F.sequence("b0", "b1")))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block)
    pieces = pieces.select("sid", "rank", "start", "pass", (lo - F.col("at")).alias("first"), (hi - lo).alias("words"))
    return slots.join(pieces, ["sid", "rank"]).select("slot", "sid", "start", "pass", "first", "words")


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs (with doc_id, source, size) and source_size, target, taken: the words that the mix takes from each document; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    docs = carried(docs, "doc_id", "source", "size", *(c for c in ("_k1", "_k2") if c in docs.columns))
    sums = cut(_keyed(docs, seed).groupBy("source", "_b").agg(F.sum("size").alias("size")))
    targets = cut(source_targets(sums))
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    placed, own = offsets(docs, targets, seed, sums), [F.col(f"_doc.`{c}`").alias(c) for c in names]
    if not total:
        return placed.select(*own, "source_size", "target", F.lit(0).cast("long").alias("taken"))
    block = block_words(total)
    slots = cut(schedule(targets, -(-total // block)))
    words = mix(placed.select("sid", "start", "size", "source_size"), slots, block).groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    words = words.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken")
    on = (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return placed.join(words, on, "left").select(*own, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, a row for each pass that takes words of one, with the columns of docs.

    A pass takes a document whole, but for one document at the end of each
    source's last pass, whose text is cut to the words taken. The schedule runs on
    narrow rows; texts are shuffled once, by a 128-bit key, to meet what is taken of them.
    Rows of equal doc_id, source and text are counted together, with the other columns of one of them.
    """
    wide = carried(docs, "doc_id", "source", "text")
    parts = (F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), F.col("text"))
    wide = wide.withColumns({"_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit("second"), *parts)})
    narrow = cut(sized(wide).select("doc_id", "source", "size", "_k1", "_k2"))
    uses = taken(narrow, seed).filter("taken > 0")
    # only the last document of a source's last pass is cut, so a key has one rest at most
    uses = uses.groupBy("_k1", "_k2").agg(F.max("size").alias("size"), F.sum(F.expr("taken div size")).alias("whole"), F.sum(F.expr("taken % size")).alias("rest"))
    uses = uses.select(F.col("_k1").alias("_u1"), F.col("_k2").alias("_u2"), "size", "whole", "rest")
    one = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("doc_id"))
    once = wide.select("_k1", "_k2", "doc_id", "text", "_doc").withColumn("_one", one).filter("_one = 1")
    rows = once.join(uses, (F.col("_k1") == F.col("_u1")) & (F.col("_k2") == F.col("_u2")))
    rows = rows.withColumn("_left", F.explode(F.expr("concat(array_repeat(size, cast(whole as int)), filter(array(rest), x -> x > 0))")))
    text = F.when(F.col("_left") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(word_array(F.col("text")), 1, F.col("_left").cast("int")), " "))
    return restored(rows.withColumn("text", text), docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))
