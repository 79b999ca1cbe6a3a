"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained in numpy from documents that are labelled toxic and
from a sample of all documents, whose labels, if they have any, aren't looked at. With the class prior p its risk is
p R(toxic, +) + max(0, R(unlabelled, -) - p R(toxic, -)): the second term, which stands for clean text, is kept
from going below zero, where a flexible model would only fit noise. Scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read, release, ship, stored
from .textbytes import Words, mix, pieces

#: Documents that the model is fitted to, at most: labelled toxic ones, and ones of any kind taken as unlabelled; and
#: their features in all, each counted once a document, which bounds what the driver holds however long the texts are.
MAX_TOXIC, MAX_UNLABELLED, MAX_FEATURES = 1500, 4500, 1 << 23
BITS = 18
#: Word beginnings, in bytes, that are features beside whole words.
STARTS = (3, 4, 5, 6, 7)
#: Steps of the fit, their size, the weights' decay, and the documents that a feature must be in.
STEPS, RATE, DECAY, MIN_ROWS = 200, 0.05, 2e-4, 5
#: Weight of the step back where the clean risk has gone below zero.
BACK = 0.5
#: Words that are added to each text's own when its rates are taken, so that a few words decide little.
SMOOTH = 30
_SALT = 0x5851F42D4C957F2D


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and row of every word and word beginning of a piece, in row order, and the words in each row.

    A word that only repeats the one before it isn't counted.
    """
    w = Words(data, offsets)
    row = w.rows()
    new = np.ones(len(row), bool)
    new[1:] = (w.hash[1:] != w.hash[:-1]) | (row[1:] != row[:-1])
    start, end, row = w.start[new], w.end[new], row[new]
    feature, owner = [(w.hash[new] >> np.uint64(64 - BITS)).astype(np.int32)], [row]
    for n in STARTS:
        long = np.flatnonzero(end - start > n)
        h = mix(w.between(start[long], start[long] + n) ^ np.uint64((_SALT * n) % 2**64))
        feature.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(row[long])
    return np.concatenate(feature), np.concatenate(owner), np.bincount(row, minlength=len(offsets) - 1)


def logits(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The model's value for each text; a text without words has that of an average one."""
    out = np.full(len(texts), bias)
    for lo, hi, data, offsets in pieces(texts):
        feature, owner, words = features(data, offsets)
        total = np.bincount(owner, weights[feature], hi - lo)
        out[lo:hi] += 100 * total / (words + SMOOTH)
    return out


def vectors(texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Features (int32) and their counts for each 100 words (float32) of each text, as bytes."""
    for lo, hi, data, offsets in pieces(texts):
        feature, owner, words = features(data, offsets)
        key, count = np.unique(owner.astype(np.int64) << BITS | feature, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << BITS)
        for i in range(hi - lo):
            a, z = cut[i], cut[i + 1]
            yield (key[a:z] & ((1 << BITS) - 1)).astype(np.int32).tobytes(), (100 * count[a:z] / (words[i] + SMOOTH)).astype(np.float32).tobytes()


class Rows:
    """Sparse rows: feature and value of each entry by row, and the same by feature."""

    def __init__(self, found: list[tuple[bytes, bytes]], used: np.ndarray | None = None) -> None:
        """With used, an ascending list of features, only those, numbered by their places in it."""
        self.n = len(found)
        feature = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(a, np.int32) for a, _ in found)])
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(a) // 4 for a, _ in found])
        value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(b, np.float32) for _, b in found)])
        if used is not None:
            at = np.searchsorted(used, feature).astype(np.int32)
            kept = used[np.minimum(at, len(used) - 1)] == feature if len(used) else np.zeros(len(at), bool)
            feature, value, row = at[kept], value[kept], row[kept]
            del at, kept
        self.feature, self.value = feature, value
        self.filled, self.first = np.unique(row, return_index=True)
        order = np.argsort(feature, kind="stable").astype(np.int32)
        self.by_row, self.by_value = row[order], value[order]
        self.present, self.begin = np.unique(feature[order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.feature] * self.value, self.first)
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        if len(self.present):
            out[self.present] = np.add.reduceat(g[self.by_row] * self.by_value, self.begin)
        return out


def risk(toxic: Rows, unlabelled: Rows, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive part, clean part before it is held at zero, gradient of either); w's last is the bias.

    With the logistic loss the positive part is p R(toxic, +) and the clean part R(unlabelled, -) - p R(toxic, -).
    """
    zp, zu = toxic.times(w) + w[-1], unlabelled.times(w) + w[-1]
    sp, su = (1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (zp, zu))
    size = len(w) - 1

    def gradient(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        return np.append(toxic.back(gp, size) + unlabelled.back(gu, size), gp.sum() + gu.sum())

    positive = prior * np.logaddexp(0, -zp).mean()
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive, clean, gradient(prior * (sp - 1) / toxic.n, np.zeros(unlabelled.n)), gradient(-prior * sp / toxic.n, su / unlabelled.n)


def fit(toxic: list[tuple[bytes, bytes]], unlabelled: list[tuple[bytes, bytes]], prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam over all rows.

    Where the clean part has gone below zero the step goes back from the noise that it has been fitted to.
    """
    seen = np.zeros(1 << BITS, np.int64)
    for a, _ in [*toxic, *unlabelled]:
        seen[np.frombuffer(a, np.int32)] += 1  # a feature stands once in a row
    used = np.flatnonzero(seen >= MIN_ROWS).astype(np.int32)
    p = Rows(toxic, used)
    del toxic
    u = Rows(unlabelled, used)
    del unlabelled  # the driver's memory is small
    w = np.zeros(len(used) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, clean, of_positive, of_clean = risk(p, u, prior, w)
        g = of_positive + of_clean if clean >= 0 else of_positive - BACK * of_clean
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * min(1.0, 2 * (1 - step / steps) + 0.02) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(1 << BITS)
    out[used] = w[:-1]
    return out, float(w[-1])


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """(id, toxic, text): the documents labelled toxic, and documents of any kind, that come first by a hash of doc_id.

    A document that several rows give is taken once, with the lowest of their texts.
    """
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id IS NOT NULL AND toxic = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    every = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = [(r["doc_id"], 1) for r in known.orderBy(order, "doc_id").limit(max_toxic).collect()]
    chosen += [(r["doc_id"], 0) for r in every.distinct().orderBy(order, "doc_id").limit(max_unlabelled).collect()]
    ids = docs.sparkSession.createDataFrame(chosen, "__id bigint, __toxic int")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("text").cast("string").alias("text"))
    both = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id"))  # at most max_toxic + max_unlabelled rows
    return both.groupBy(F.col("__id").alias("id"), F.col("__toxic").alias("toxic")).agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, float] | None:
    """The model, or None where no document that has a text is labelled toxic.

    It is fitted to at most max_toxic toxic documents and max_unlabelled ones of any kind, in the order of a hash of
    doc_id, as many of either as have half of max_features features. prior is by default the toxic share of all labels.
    Labels without doc_id or toxic are left out; a document with several labels is toxic if one says so.
    """
    spark = docs.sparkSession
    ship(spark)
    if prior is None:
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    prior = min(max(float(prior), 1e-4), 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(vectors(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f for f, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["id", "toxic", "features", "value"])

    rows = sample(docs, labels, max_toxic, max_unlabelled).mapInArrow(run, "id bigint, toxic int, features binary, value binary")
    held = stored(rows.withColumn("n", F.octet_length("features") / 4), "vectors")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = held.select("id", "toxic", F.sum("n").over(before).alias("sum")).where(F.col("sum") <= max_features // 2).select(F.col("id").alias("__id"), F.col("toxic").alias("__toxic"))
    both = held.join(F.broadcast(fits), (F.col("id") == F.col("__id")) & (F.col("toxic") == F.col("__toxic")), "left_semi")
    table = both.select("id", "toxic", "features", "value").toArrow()
    release(held)
    sides: list[list] = [[], []]
    for i in pc.sort_indices(table.select(["toxic", "id"]), [("toxic", "ascending"), ("id", "ascending")]).to_pylist():
        sides[table["toxic"][i].as_py()].append((table["features"][i].as_py(), table["value"][i].as_py()))
    del table
    pa.default_memory_pool().release_unused()
    if not sides[1] or not sides[0]:
        return None
    return fit(sides.pop(), sides.pop(), prior)


def _scorer(model: tuple[np.ndarray, float]):
    weights, bias = model[0].astype(np.float32), model[1]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        z = logits(texts, weights, bias)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return score


def scored(docs: DataFrame, labels: DataFrame, name: str = "toxicity", **how) -> DataFrame:
    """docs with a further column: the model's probability that the document is toxic, null for a null text.

    Without a model (no toxic labels, or empty tables) it is null everywhere.
    """
    name = fresh(name, docs.columns)
    model = train(docs, labels, **how)
    text = F.col("text").cast("string")
    value = F.lit(None).cast("double") if model is None else F.when(text.isNotNull(), _scorer(model)(text))
    return docs.withColumn(name, value)


def toxic_ids(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id and toxicity of the documents that are rather toxic than not. Repeated rows come as often as they stand in docs."""
    return scored(docs.select("doc_id", "text"), labels, **how).where("toxicity > 0.5").select("doc_id", "toxicity")


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the documents that are rather toxic than not, all columns as they were; a null text stays."""
    with_score = scored(docs, labels, **how)
    score = F.coalesce(F.col(f"`{with_score.columns[-1]}`"), F.lit(0.0))
    return with_score.where(score <= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_ids(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
