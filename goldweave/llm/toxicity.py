"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms, each of which falls into one of a fixed number of buckets. The machine adds a weight
for each bucket and the product of latent vectors for each pair, so that pairs such as an insult with the mention of a group
count beyond their terms. No term is left out; a bucket that no fitted text has counts nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_once, kinds
from .sampling import bucket, lowest, texts_of

#: Labelled rows that the machine is fitted on at most, of each label.
SAMPLE = 4000
#: Buckets that terms are hashed into, each with a weight and as many factors.
BUCKETS, FACTORS = 1 << 18, 4
#: A weight stays 0 until the slopes at its bucket add up to so much; and what a factor's step is held back by at first.
#: Else the words that only a few texts have, which are most, would fit these texts by heart.
SPARSE, HELD = 10.0, 100.0
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[int]:
    """Hashes of the words of letters, in lower case."""
    return {zlib.crc32(w.encode()) for w in set(_WORD.findall((text or "").lower()))}


class Buckets:
    """The bucket of each term hash."""

    def __getitem__(self, term):
        return term % BUCKETS


@dataclass
class Machine:
    at: Buckets
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        """Likelihood of label 1, from 0 to 1."""
        rows = sorted({self.at[t] for t in terms(text)})
        raw = self.bias
        if rows:
            v = self.factors[rows]
            raw += float(self.weight[rows].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(rows: list[tuple[int, list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 3e-3, seed: int = 3) -> Machine:
    """A machine of (label, term hashes) rows, on the logistic loss, row by row in a fixed random order: weights by FTRL-proximal, factors by AdaGrad."""
    labels = np.array([y for y, _ in rows])
    at, weight, factors = Buckets(), np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    if len(rows) == 0 or labels.min() == labels.max():
        rate_ = (labels.sum() + 0.5) / (len(rows) + 1)
        return Machine(at, float(np.log(rate_ / (1 - rate_))), weight, factors)
    n = np.bincount(labels, minlength=2)
    found = [np.unique(at[np.asarray(hashes, np.int64)]) for _, hashes in rows]
    known, places = np.unique(np.concatenate(found), return_inverse=True)
    x = np.split(places, np.cumsum([len(f) for f in found])[:-1])
    random = np.random.default_rng(seed)
    z, v, bias = np.zeros(len(known)), random.normal(0, 0.01, (len(known), FACTORS)), 0.0
    gw, gv, gb = np.ones(len(known)), np.full((len(known), FACTORS), HELD), 1e-6
    weights = lambda k: -np.sign(z[k]) * np.maximum(np.abs(z[k]) - SPARSE, 0) * rate / np.sqrt(gw[k])
    share = len(rows) / 2 / np.maximum(n, 1)
    share = share / share.max()
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            k = x[i]
            wk, vk = weights(k), v[k]
            total = vk.sum(0)
            raw = bias + wk.sum() + 0.5 * (total**2 - (vk**2).sum(0)).sum()
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]) * share[labels[i]]
            gb += slope * slope
            bias -= rate * slope / np.sqrt(gb)
            if len(k):
                before = np.sqrt(gw[k])
                gw[k] += slope * slope
                z[k] += slope - (np.sqrt(gw[k]) - before) / rate * wk
                g = slope * (total - vk) / np.sqrt(len(k)) + decay * vk
                gv[k] += g * g
                v[k] -= rate * 0.1 * g / np.sqrt(gv[k])
    weight[known], factors[known] = weights(np.arange(len(known))), v
    return Machine(at, float(bias), weight, factors)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled texts of each label (0 or 1), equal texts once; labels has doc_id and toxic. An id with both labels counts as toxic. The fit runs on an executor."""
    labels = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sum", F.md5(F.col("text").cast("binary")))
    once = docs.select("doc_id", "sum").join(labels, "doc_id").groupBy("y", "sum").agg(F.min("doc_id").alias("doc_id"))
    chosen = lowest(once.where("y = 1"), sample).unionByName(lowest(once.where("y = 0"), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("sum"), pa.array(found, pa.list_(pa.int64()))], ["y", "sum", "terms"])

    def learn(found: pa.Table) -> Machine:
        rows = sorted(zip(found["sum"].to_pylist(), found["y"].to_pylist(), found["terms"], strict=True), key=lambda r: r[:2])
        return fit([(y, r.values.to_numpy()) for _, y, r in rows])

    texts = texts_of(docs, chosen, "doc_id", "sum").select("y", "sum", "text")
    return fit_once(texts.mapInArrow(run, "y int, sum string, terms array<long>"), learn)


def score_texts(docs: DataFrame, model: Machine) -> DataFrame:
    """The columns of docs with a score from 0 to 1, which replaces a column of this name; a null text counts as empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([known.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, "score"])

    docs = docs.withColumn("text", F.col("text").cast("string")).drop("score")
    keep = docs.columns
    return docs.mapInArrow(run, f"{kinds(docs, *keep)}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Learns labels of rows whose crc32 of doc_id is not 0 modulo 5. Null texts count as empty; a null doc_id is not held
    out; null labels are left out; repeated rows each give a row and are learned from once; whole texts count, however long;
    without labels the score is 0.5; further columns are ignored; an empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    learn = labels.selectExpr("cast(doc_id as long) doc_id", "toxic").where(bucket(F.col("doc_id"), 5) != 0)
    model = train(docs, learn, sample)
    scored = score_texts(docs.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
