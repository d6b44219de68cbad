"""Removal of strings that repeat anywhere in the corpus: suffix arrays by shards.

A unit says what strings are made of: BYTES (of 400 or more) or WORDS (50 or more of
them, whatever white space parts them). Any two equal strings of ``least`` symbols hold the same
least hash of their anchors, which are substrings of a fixed length. So each text is cut into
runs of window starts with the same least hash (pieces), the corpus counts pieces by hash,
and only pieces whose hash occurs again are looked at closer. Equal pieces are counted as one.
The distinct pieces of a hash meet in one task, and ``suffixes.repeated`` finds on the
Burrows-Wheeler transform of the pieces of many hashes which windows occur twice.

Where one hash holds more than LIMIT symbols of distinct pieces (a passage in thousands
of contexts), these are dealt to blocks of that size, each with a transform of its own. Of equal windows
a block passes on one, so what it passes on is free of repeats; it goes through the same search
again, by other hashes of longer anchors. The last anchors are the windows themselves, of which
one hash has but one piece. So every repeat is found by the transform or as an equal piece, at any size.

Texts are stored once, distinct by a 128-bit key and bucketed by it, so that later look-ups by key move no text.

Defined cases: a null text is empty; shorter texts stay whole; matches never cross documents;
a text that occurs twice is removed whole; repeated rows count as occurrences of each other,
equal doc_ids or not; equality of whole texts stands on 128 bits of hashes, that of pieces on
128 bits (of anchor and piece), and that of words on 64 bits each; a null doc_id is carried
along; an empty table gives no rows; other columns are ignored by ``report`` and carried by ``remove``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, met, restored, shared_dir, stored, word_count
from .suffixes import repeated

#: Symbols of the distinct pieces of one hash, and of many together, that a task sorts at once; twice that at most.
LIMIT = 1 << 19
_SEGMENT = 1 << 20
_FEW = 1 << 15  # symbols worked on at once, so that they stay in a core's cache
_EMPTY = hashlib.sha256(b"").hexdigest()
_SEEDS = (0, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F)


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def _bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df as files in the shared folder, bucketed by keys like a shuffle of this session; the table's name goes at once."""
    spark = df.sparkSession
    name = f"gramforge_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table only the name; the files stay
    return out


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base = [base, pow(base, -1, 1 << 64)]
        self.made = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            self.made = [np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, np.uint64))) for b in self.base]
        return [x[:n] for x in self.made]


_POWERS = _Powers(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h ^= np.uint64(seed)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.upto(len(data))
    return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)), down


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each size symbols of data."""
    sums, down = _sums(data)
    return _mixed((sums[size:] - sums[:-size]) * down[: len(data) - size + 1], seed)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of a text, and the bytes behind them."""
    space = np.concatenate([[True], (data == 32) | (data >= 9) & (data <= 13), [True]]).astype(np.int8)
    edge = np.diff(space)
    return np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


def word_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    start, end = word_bounds(data)
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), 1 << 17):
        a, b = start[at : at + (1 << 17)], end[at : at + (1 << 17)]
        sums, down = _sums(data[a[0] : b[-1]])
        a, b = a - start[at], b - start[at]
        out[at : at + len(a)] = _mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return out


@dataclass(frozen=True)
class Unit:
    """Symbols of a text's bytes, how many make a string that must not repeat, and the lengths of its anchors by level."""

    kind: int
    least: int
    anchors: tuple[int, ...]
    symbols: Callable[[np.ndarray], np.ndarray]
    dtype: type

    def of(self, text: str) -> np.ndarray:
        return self.symbols(np.frombuffer(text.encode(), np.uint8))

    @property
    def shortest(self) -> int:
        """Bytes of the shortest text that can hold such a string."""
        return self.least if self.dtype is np.uint8 else 2 * self.least - 1


def _same(data: np.ndarray) -> np.ndarray:
    return data


def byte_unit(least: int, anchors: tuple[int, ...]) -> Unit:
    return Unit(0, least, (*anchors, least), _same, np.uint8)


def word_unit(least: int, anchors: tuple[int, ...]) -> Unit:
    return Unit(1, least, (*anchors, least), word_codes, np.uint64)


BYTES = byte_unit(400, (128, 256, 384))
WORDS = word_unit(50, (12, 28, 46))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each width entries, from block-wise running values."""
    fill = ~np.uint64(0) if best is np.minimum else np.uint64(0)
    blocks = np.append(x, np.full(-len(x) % width, fill)).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


_PIECES = "v long, p long, h1 long, h2 long, start long, windows long, again boolean"


def runs(parts: list[np.ndarray], unit: Unit, level: int = 0) -> tuple[np.ndarray, ...]:
    """The pieces of sequences of symbols: part, start, windows, v (least hash of an anchor), p (hash of the piece), again (v occurs twice in the part).

    The sequences are worked on as one; windows across their borders don't count.
    """
    least, anchor = unit.least, unit.anchors[level]
    width = least - anchor + 1
    size = np.array([len(x) for x in parts], np.int64)
    data = np.concatenate(parts)
    if len(data) < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    first = np.cumsum(size) - size
    end = first + np.maximum(size - least + 1, 0)
    part_of = lambda at: np.searchsorted(first, at, "right") - 1
    h = gram_hashes(data, anchor, _SEEDS[level % len(_SEEDS)])
    low = _sliding(h, width, np.minimum)
    some = end > first
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, end[some], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = np.append(True, low[1:] != low[:-1])
    new[first[some]] = True
    start = np.flatnonzero(new & inside)
    part, v = part_of(start), low[start]
    windows = np.minimum(np.append(start[1:], len(data)), end[part]) - start
    # an anchor is the least of some window
    low[~inside] = 0
    rim = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([rim, low, rim]), width, np.maximum) == h)
    own = lambda value, k: value + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    values, times = np.unique(own(h[at], part_of(at)), return_counts=True)
    again = times[np.searchsorted(values, own(v, part))] > 1
    view, w = memoryview(data.view(np.uint8)), data.itemsize
    p = [xxhash.xxh3_64_intdigest(view[w * a : w * b]) for a, b in zip(start.tolist(), (start + windows + least - 1).tolist())]
    return part, start - first[part], windows, v.view(np.int64), np.array(p, np.uint64).view(np.int64), again


def _find_pieces(unit: Unit, level: int):
    """Pieces of whole texts; of the windows from start on where these are given (as arrays)."""

    def found(df: pd.DataFrame, parts: list[np.ndarray], owner: list[int], begin: list[int]) -> pd.DataFrame:
        part, start, windows, v, p, again = runs(parts, unit, level)
        at = np.array(owner)[part]
        return pd.DataFrame({"v": v, "p": p, "h1": df["h1"].to_numpy()[at], "h2": df["h2"].to_numpy()[at], "start": start + np.array(begin)[part], "windows": windows, "again": again})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            parts, owner, begin, held = [], [], [], 0
            for k, text in enumerate(df["text"]):
                data = unit.of(text)
                spots = zip(df["start"].iloc[k].tolist(), df["windows"].iloc[k].tolist()) if level else [(0, len(data) - unit.least + 1)]
                for first, windows in spots:
                    for at in range(first, first + windows, _SEGMENT):
                        parts.append(data[at : min(at + _SEGMENT, first + windows) + unit.least - 1])
                        owner.append(k)
                        begin.append(at)
                        held += len(parts[-1])
                        if held >= _FEW:
                            yield found(df, parts, owner, begin)
                            parts, owner, begin, held = [], [], [], 0
            if parts:
                yield found(df, parts, owner, begin)

    return run


def _cut_pieces(unit: Unit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["h1", "h2", "v", "single", "block", "blocks", "start", "piece"]
        for df in batches:
            rows = []
            for h1, h2, text, spots in zip(df["h1"].tolist(), df["h2"].tolist(), df["text"], df["s"]):
                data = unit.of(text)
                for s in spots:
                    rows.append((h1, h2, s["v"], s["single"], s["block"], s["blocks"], s["start"], data[s["start"] : s["start"] + s["windows"] + unit.least - 1].tobytes()))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def _flips(mask: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _solve(rows: list[tuple], unit: Unit) -> pd.DataFrame:
    """What repeats in single pieces, as spans of symbols, and what hot groups pass on, as starts and numbers of windows."""
    masks = repeated([np.frombuffer(r[6], unit.dtype) for r in rows], unit.least)
    out = []
    for (h1, h2, _, single, blocks, start, _), (twice, first) in zip(rows, masks):
        if single:
            out += [(h1, h2, start + a, start + b - 1 + unit.least, False) for a, b in _flips(twice)]
        if blocks > 1:
            out += [(h1, h2, start + a, b - a, True) for a, b in _flips(first)]
    return pd.DataFrame(out, columns=["h1", "h2", "a", "b", "rest"])


def _match_pieces(unit: Unit, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held, last = 0, None
        for df in batches:
            for h1, h2, v, single, block, blocks, start, piece in zip(*(df[c].tolist() for c in ("h1", "h2", "v", "single", "block", "blocks", "start", "piece"))):
                if (v, block) != last:
                    if held >= limit:
                        yield _solve(rows, unit)
                        rows, held = [], 0
                    last = v, block
                rows.append((h1, h2, v, single, blocks, start, bytes(piece)))
                held += len(piece) // np.dtype(unit.dtype).itemsize
        if rows:
            yield _solve(rows, unit)

    return run


def _level(rows: DataFrame, texts: DataFrame, unit: Unit, level: int, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans (h1, h2, a, b) of what repeats among the pieces of rows, and the windows that need another level."""
    last = level == len(unit.anchors) - 1
    known = stored(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("_a")).filter("n > 1 OR _a").select("v", "n"))
    chosen = stored(met(rows, known, ["v"]).drop("n"))
    place = F.struct("h1", "h2", "start", "windows")
    distinct = stored(chosen.groupBy("v", "p").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("at")))
    size = F.sum(F.col("at.windows") + (unit.least - 1))
    # a group whose pieces all have copies is settled by them
    groups = distinct.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("_c"), size.alias("_size")).filter("_c = 1")
    groups = stored(groups.select("v", "n", (F.lit(1) if last else F.ceil(F.col("_size") / limit)).cast("long").alias("blocks")))
    todo = met(distinct, groups, ["v"]).select("at.*", "v", (F.col("c") == 1).alias("single"), F.expr("pmod(p, blocks)").alias("block"), "blocks")
    per = todo.groupBy("h1", "h2").agg(F.collect_list(F.struct("v", "single", "block", "blocks", "start", "windows")).alias("s"))
    there = texts.select("h1", "h2", "text").join(per, ["h1", "h2"]).select("h1", "h2", "text", "s")
    dealt = there.mapInPandas(_cut_pieces(unit), "h1 long, h2 long, v long, single boolean, block long, blocks long, start long, piece binary")
    dealt = dealt.repartition("v", "block").sortWithinPartitions("v", "block")
    found = dealt.mapInPandas(_match_pieces(unit, limit), "h1 long, h2 long, a long, b long, rest boolean")
    hot = not groups.filter("blocks > 1").isEmpty()
    if hot:
        found = stored(found)
    copies = met(chosen, distinct.filter("c > 1").select("v", "p", F.col("c").alias("n")), ["v", "p"])
    spans = [copies.select("h1", "h2", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (unit.least - 1)).alias("b")), found.filter("NOT rest").select("h1", "h2", "a", "b")]
    return spans, found.filter("rest") if hot else None


def spans(texts: DataFrame, unit: Unit = BYTES, limit: int = LIMIT) -> DataFrame:
    """(h1, h2, a, b): symbols a to b of a text are covered by repeated strings; spans may overlap. texts: distinct h1, h2, text."""
    found, rest = [], None
    for level in range(len(unit.anchors)):
        if level:
            per = rest.groupBy("h1", "h2").agg(F.collect_list(F.struct("a", "b")).alias("s"))
            there = texts.select("h1", "h2", "text").join(per, ["h1", "h2"]).select("h1", "h2", "text", F.col("s.a").alias("start"), F.col("s.b").alias("windows"))
        else:
            there = texts.filter(F.octet_length("text") >= unit.shortest).select("h1", "h2", "text")
        more, rest = _level(stored(there.mapInPandas(_find_pieces(unit, level), _PIECES)), texts, unit, level, limit)
        found += more
        if rest is None or rest.isEmpty():
            break
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans cover."""
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > far[:-1])
    return a[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]


def _without(data: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    at, kept = 0, []
    for lo, hi in zip(a.tolist(), b.tolist()):
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spoken(kind: np.ndarray, a: np.ndarray, b: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    own = kind == which
    return merged(a[own], b[own]) if own.any() else _NONE


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for h1, h2, text, kind, a, b in zip(df["h1"], df["h2"], df["text"], df["kind"], df["a"], df["b"]):
            data = text.encode()
            lo, hi = _spoken(kind, a, b, BYTES.kind)
            first, behind = _spoken(kind, a, b, WORDS.kind)
            rows.append((h1, h2, int((hi - lo).sum()), len(lo), hashlib.sha256(_without(data, lo, hi)).hexdigest(), int((behind - first).sum())))
        yield pd.DataFrame(rows, columns=["h1", "h2", "n_removed", "n_spans", "kept_sha256", "passage_words"])


def _keep_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for h1, h2, text, kind, a, b in zip(df["h1"], df["h2"], df["text"], df["kind"], df["a"], df["b"]):
            data = text.encode()
            found = [_spoken(kind, a, b, BYTES.kind)]
            first, behind = _spoken(kind, a, b, WORDS.kind)
            if len(first):
                start, end = word_bounds(np.frombuffer(data, np.uint8))
                found.append((start[first], end[behind - 1]))
            lo, hi = (np.concatenate(x) for x in zip(*found))
            rest = _without(data, *merged(lo, hi)).decode(errors="ignore")
            rows.append((h1, h2, rest if rest.split() else ""))
        yield pd.DataFrame(rows, columns=["h1", "h2", "kept_text"])


def _found(docs: DataFrame, units: tuple[Unit, ...], **how) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (h1, h2, text, n rows), and of those that occur once and hold repeats their spans as arrays."""
    shortest = min(u.shortest for u in units)
    texts = docs.select("text").filter(F.octet_length("text") >= shortest).select(*text_keys(F.col("text")), "text")
    texts = _bucketed(texts.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "h1", "h2")
    found = None
    for u in units:
        more = spans(texts, u, **how).select("h1", "h2", F.struct(F.lit(u.kind).alias("kind"), "a", "b").alias("s"))
        found = more if found is None else found.unionByName(more)
    found = found.groupBy("h1", "h2").agg(F.collect_list("s").alias("s"))
    return texts, texts.filter("n = 1").select("h1", "h2", "text").join(found, ["h1", "h2"]).select("h1", "h2", "text", "s.kind", "s.a", "s.b")


def report(docs: DataFrame, unit: Unit = BYTES, words: Unit = WORDS, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, by unit; passage_words: how many of its words stand in strings of words that repeat."""
    texts, parts = _found(docs, (unit, words), **how)
    long, many = F.octet_length("text") >= unit.least, word_count(F.col("text"))
    size = F.octet_length("text").cast("long")
    whole = texts.filter("n > 1").select(
        "h1", "h2", F.when(long, size).otherwise(0).alias("n_removed"), long.cast("long").alias("n_spans"), F.when(long, F.lit(_EMPTY)).otherwise(F.sha2("text", 256)).alias("kept_sha256"),
        F.when(many >= words.least, many).otherwise(0).alias("passage_words"), "n",
    )
    found = parts.mapInPandas(_digest, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, passage_words long").withColumn("n", F.lit(1).cast("long"))
    found = stored(whole.unionByName(found))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    out = met(rows, found, ["h1", "h2"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), F.coalesce("passage_words", none).alias("passage_words"))


def remove(docs: DataFrame, units: tuple[Unit, ...] = (BYTES, WORDS), **how) -> DataFrame:
    """docs with what repeats by one of units taken out of text, without the documents of which but white space is left; n_chars follows if there.

    What a cut leaves of a character goes too.
    """
    texts, parts = _found(docs, units, **how)
    gone = F.lit(False)
    for u in units:
        gone = gone | ((F.octet_length("text") if u.kind == BYTES.kind else word_count(F.col("text"))) >= u.least)
    whole = texts.filter("n > 1").filter(gone).select("h1", "h2", F.lit("").alias("kept_text"), "n")
    found = whole.unionByName(parts.mapInPandas(_keep_rest, "h1 long, h2 long, kept_text string").withColumn("n", F.lit(1).cast("long")))
    found = stored(found.withColumnsRenamed({"h1": "_a", "h2": "_b", "kept_text": "_kept", "n": "n"}))
    h1, h2 = text_keys(F.col("text"))
    keyed = carried(docs, "text").withColumn("_a", h1).withColumn("_b", h2)
    out = met(keyed, found, ["_a", "_b"], "left").filter("_kept IS NULL OR _kept <> ''")
    out = out.withColumn("text", F.coalesce("_kept", "text"))
    return restored(out, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))
