"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the distinct n-grams of its lower-case characters, hashed into
2**BUCKET_BITS buckets. On a sample of at most FIT_ROWS labelled rows, each bucket
gets its log-count ratio r = log((p / |p|) / (q / |q|)), p and q being smoothed document
counts in the two classes; a logistic regression is trained on the features scaled
by r. Of the buckets, the FEATURES with the clearest ratios are kept, so the model is bounded and
goes to the executors whole. One task counts the sample's texts as they stream by; then each text is
reduced to the kept buckets where it is, and one task fits on these. Every text is scored whole.

Defined cases: null and empty texts have the blank as only character and get the score that
the intercept gives; without labels of both classes every score is the smoothed share of the toxic rows;
several label rows of a document count as toxic if one does, and of several texts of one doc_id
that with the least hash is learned; labels with nulls are ignored; a null doc_id counts as held out; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import stored

ORDERS = (4, 6, 8)
BUCKET_BITS = 22
#: Labelled rows that the classifier is fitted on at most, those with the smallest hashes of doc_id.
FIT_ROWS = 6000
FEATURES = 20_000
SMOOTHING = 0.5
RIDGE = 100.0
#: Weight of a toxic row in training; they are the few.
TOXIC_WEIGHT = 16.0
FOLDS = 5
_SPACES = {k: " " for k in (*range(9, 14), 32)}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included."""
    text = f" {(text or '').lower().translate(_SPACES)} "
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h, out = np.zeros(len(code), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if n > len(code):
            break
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            out.append(((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, texts) -> np.ndarray:
        table = np.zeros(1 << BUCKET_BITS, np.float32)
        table[self.bucket] = self.weight
        hit = np.zeros(1 << BUCKET_BITS, bool)
        hit[self.bucket] = True
        sums = np.empty(len(texts))
        for k, text in enumerate(texts):
            b = buckets(text)
            sums[k] = table[np.unique(b[hit[b]])].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -30, 30)))


@dataclass
class Counts:
    """Texts of each class, and those of them with each bucket."""

    toxic: int
    clean: int
    p: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls) -> Counts:
        return cls(0, 0, *(np.zeros(1 << BUCKET_BITS, np.int32) for _ in range(2)))

    def add(self, text: str | None, toxic: bool) -> None:
        (self.p if toxic else self.q)[np.unique(buckets(text))] += 1
        self.toxic, self.clean = self.toxic + toxic, self.clean + (not toxic)

    def ratios(self) -> np.ndarray:
        return np.log((self.p + SMOOTHING) / (self.toxic + 2 * SMOOTHING)) - np.log((self.q + SMOOTHING) / (self.clean + 2 * SMOOTHING))

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets with the clearest ratios in order, and their ratios; none without both classes."""
        if not self.toxic or not self.clean:
            return np.zeros(0, np.int64), np.zeros(0)
        df, r = self.p + self.q, self.ratios()
        worth = np.where(df >= min(4, self.toxic), np.abs(r) * np.sqrt(df), 0)
        keep = np.sort(np.argsort(-worth, kind="stable")[: min(FEATURES, int((worth > 0).sum()))])
        return keep, r[keep]


def kept(texts, keep: np.ndarray) -> list[np.ndarray]:
    """For each text the places in keep of its buckets."""
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    rows = (place[np.unique(buckets(t))] for t in texts)
    return [x[x >= 0] for x in rows]


def solve(rows: list[np.ndarray], toxic: np.ndarray, keep: np.ndarray, scale: np.ndarray) -> Model:
    """The logistic regression of so many texts on the kept buckets, scaled."""
    y = np.asarray(toxic, np.float64)
    n, pos = len(y), float(y.sum())
    b = float(np.log((pos + 0.5) / (n - pos + 1.5)))
    if not len(keep):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), b)
    col = np.concatenate(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in rows])
    value, w = scale[col], np.zeros(len(keep))
    share = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    # full-batch Adam on the ridge-penalised log loss
    m1, m2 = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, 301):
        z = np.bincount(row, value * w[col], n) + b
        miss = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, miss[row] * value, len(keep)) + RIDGE * w, miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        step = 0.02 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(keep, (w * scale).astype(np.float32), float(b))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """The classifier of so many texts, in memory."""
    counts = Counts.empty()
    for text, label in zip(texts, toxic):
        counts.add(text, bool(label))
    keep, scale = counts.chosen()
    return solve(kept(texts, keep), toxic, keep, scale)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most rows labelled rows that aren't held out; docs needs doc_id and text, labels doc_id and toxic.

    The sample's ids are bounded, hence broadcast, and its texts are stored; one row with the model comes back.
    """
    known = labels.select(F.col("doc_id").alias("_id"), "toxic").dropna().filter(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one")
    chosen = stored(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one).select("doc_id", "one.text", (F.col("toxic") > 0).alias("toxic")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts.empty()
        for df in batches:
            for text, toxic in zip(df["text"], df["toxic"].tolist()):
                counts.add(text, toxic)
        keep, scale = counts.chosen()
        yield pd.DataFrame({"b": [keep.astype("<i8").tobytes()], "w": [scale.astype("<f8").tobytes()]})

    got = chosen.select("text", "toxic").coalesce(1).mapInPandas(counted, "b binary, w binary").first()
    if got is None:
        return fit([], np.zeros(0))
    keep, scale = np.frombuffer(bytes(got["b"]), "<i8"), np.frombuffer(bytes(got["w"]), "<f8")

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "toxic": df["toxic"], "x": [x.tolist() for x in kept(df["text"], keep)]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits: list[np.ndarray] = []
        toxic: list[bool] = []
        for df in batches:
            hits += [np.asarray(x, np.int64) for x in df["x"]]
            toxic += df["toxic"].tolist()
        m = solve(hits, np.array(toxic, np.float64), keep, scale)
        yield pd.DataFrame({"b": [m.bucket.astype("<i8").tobytes()], "w": [m.weight.astype("<f4").tobytes()], "c": [m.intercept]})

    features = chosen.mapInPandas(reduced, "doc_id long, toxic boolean, x array<int>").repartition(1).sortWithinPartitions("doc_id")
    got = features.mapInPandas(fitted, "b binary, w binary, c double").first()
    if got is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(bytes(got["b"]), "<i8"), np.frombuffer(bytes(got["w"]), "<f4"), got["c"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
