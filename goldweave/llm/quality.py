"""Quality by positive-unlabelled learning.

Trusted good texts and unlabelled web texts give a linear model over shape n-grams and measures of style, by the
non-negative unbiased risk under a class prior that is estimated from the two as well. The same risk, over slope and shift
alone, scales its output to a likelihood. Texts that are labelled bad are learned from only as any web text is: without
their label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_once, kinds
from .sampling import bucket, lowest, texts_of

#: Rows of each kind (trusted, unlabelled) that the model is fitted on at most.
SAMPLE = 3000
#: Share of the trusted texts that must lie over a threshold for it to tell of the prior.
TOLD = 0.5
SHAPES = 2048
STYLES = 12


def _classes() -> np.ndarray:
    """A class for each byte: digits alike, capitals alike, small letters alike, bytes of other scripts alike; the rest each its own."""
    out = np.arange(256)
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        out[first : last + 1] = first
    return out.astype(np.uint32)


_CLASS = _classes()


def styles(text: str) -> list[float]:
    """Measures of style that don't grow with the length."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    distinct = len(set(words))
    room = min(n, 40 + n**0.8)  # long texts repeat words by nature
    return [
        1.0,
        sum(map(eq, words, words[1:])) / n,
        distinct / room,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in words) / n,
        min(chars / n, 40) / 40,
        sum(map(str.isdigit, text)) / chars,
        text.count("|") * 5 / chars,
        min(np.log1p(n) / 10, 1.5),
        min(len(lines) * 10 / n, 3.0),
    ]


def featurise(text: str | None) -> np.ndarray:
    """Styles and normalised counts of shape trigrams."""
    text = text or ""
    out = np.zeros(STYLES + SHAPES, np.float32)
    out[:STYLES] = styles(text)
    shape = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    if len(shape) > 2:
        gram = (shape[:-2] * np.uint32(65536) + shape[1:-1] * np.uint32(256) + shape[2:]) * np.uint32(2654435761) >> np.uint32(21)
        counts = np.sqrt(np.bincount(gram, minlength=SHAPES))
        out[STYLES:] = counts / np.linalg.norm(counts)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(trusted: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 200, rate: float = 0.04, decay: float = 2e-3) -> Model:
    """Minimise prior * R(trusted, +) + max(0, R(unlabelled, -) - prior * R(trusted, -)) with the logistic loss, by Adam.

    Where the difference is below 0 the step goes the other way on it, as non-negative risk estimation asks.
    """
    n = len(trusted) + len(unlabelled)
    mean = (trusted.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    mean[0] = 0
    mean = mean.astype(np.float32)
    p, u = trusted - mean, unlabelled - mean
    spread = np.sqrt((np.square(p).sum(0, dtype=np.float64) + np.square(u).sum(0, dtype=np.float64)) / n)
    scale = (1 / np.maximum(spread, 0.02)).astype(np.float32)
    scale[0] = 1
    p *= scale
    u *= scale
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    soft = lambda z: np.logaddexp(np.float32(0), z)
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        gain = -prior * (_sigmoid(-zp) @ p) / len(p)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_negative = _sigmoid(zu) @ u / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
        g = (gain + (g_negative if negative >= 0 else -g_negative)).astype(np.float32) + np.float32(decay) * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w, 1.0, 0.0)


def estimate_prior(trusted: np.ndarray, unlabelled: np.ndarray, rounds: int = 4) -> float:
    """The share of good texts among unlabelled ones, from what a classifier gives to texts that it has not seen.

    Of the unlabelled texts at least prior times the share of the trusted lie over any threshold, so the threshold at which
    the ratio of the two shares is least bounds the prior best. A classifier under the bound separates better than the one
    before, so the bound is taken again a few times. Thresholds over most of the trusted texts are left out, as few texts tell there.
    """
    prior = 0.9
    for _ in range(rounds):
        ratios = []
        for k in (0, 1):
            p, u = trusted[1 - k :: 2], unlabelled[1 - k :: 2]
            if not len(trusted[k::2]) or not len(unlabelled[k::2]) or not len(p) or not len(u):
                continue
            model = fit(trusted[k::2], unlabelled[k::2], prior)
            p, u = np.sort(model.margins(p)), np.sort(model.margins(u))
            at = np.quantile(p, np.linspace(0, 1 - TOLD, 40))
            share_p, share_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
            ratios.append(float(np.min((share_u + 0.5 / len(u)) / share_p)))
        prior = float(np.clip(np.mean(ratios) if ratios else 0.5, 0.05, 0.95))
    return prior


def rescale(model: Model, trusted: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Slope and shift of the logistic output by the same risk, which is convex in them: mean of the loss of unlabelled texts as bad, less prior times the trusted texts' mean margin."""
    zp, zu = model.margins(trusted).astype(np.float64), model.margins(unlabelled).astype(np.float64)
    middle, a, b = zp.mean(), 1.0, 0.0
    for _ in range(100):  # Newton steps, held near the model's own output
        s = _sigmoid(a * zu + b)
        g = np.array([(s * zu).mean() - prior * middle + 0.02 * (a - 1), s.mean() - prior + 0.002 * b])
        r = s * (1 - s)
        h = np.array([[(r * zu * zu).mean() + 0.02, (r * zu).mean()], [(r * zu).mean(), r.mean() + 0.002]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(abs(step).max(), 1e-12))
        a, b = float(np.clip(a - step[0], 0.2, 10)), float(np.clip(b - step[1], -20, 20))
        if abs(step).max() < 1e-7:
            break
    return Model(model.mean, model.scale, model.weight, a, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` trusted texts (quality 1) and as many of all texts, their labels unseen. An id with both labels is not trusted. The fit runs on an executor.

    Without a trusted or without any text, every score is 0.5.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    trusted = lowest(known.where("y = 1").select("doc_id"), sample, 2).withColumn("trusted", F.lit(1))
    pool = lowest(docs.select("doc_id"), sample, 3).withColumn("pooled", F.lit(1))
    chosen = trusted.join(pool, "doc_id", "full").select("doc_id", F.coalesce("trusted", F.lit(0)).alias("trusted"), F.coalesce("pooled", F.lit(0)).alias("pooled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [featurise(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "trusted", "pooled")), pa.array(found, pa.binary())], ["doc_id", "trusted", "pooled", "x"])

    def learn(found: pa.Table) -> Model:
        order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
        width = STYLES + SHAPES
        good, web = ([found["x"][int(i)].as_buffer() for i in order if found[c][int(i)].as_py()] for c in ("trusted", "pooled"))
        if not good or not web:
            return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width, np.float32), 1.0, 0.0)
        p, u = (np.frombuffer(b"".join(x), np.float32).reshape(-1, width) for x in (good, web))
        prior = estimate_prior(p, u)
        return rescale(fit(p, u, prior), p, u, prior)

    texts = texts_of(docs, chosen, "doc_id").select("doc_id", "trusted", "pooled", "text")
    return fit_once(texts.mapInArrow(run, "doc_id long, trusted int, pooled int, x binary"), learn)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with a score from 0 to 1, which replaces a column of this name; a null text counts as empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([featurise(t) for t in batch.column("text").to_pylist()]).reshape(-1, STYLES + SHAPES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(known.value.scores(x).astype(float), pa.float64())], [*keep, "score"])

    docs = docs.withColumn("text", F.col("text").cast("string")).drop("score")
    keep = docs.columns
    return docs.mapInArrow(run, f"{kinds(docs, *keep)}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Learns labels of rows whose crc32 of doc_id is not 0 modulo 5. Null texts count as empty; a null doc_id is not held
    out; null labels are left out; repeated rows each give a row and are learned from once; whole texts count, however long;
    without trusted rows every score is 0.5; further columns are ignored; an empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    learn = labels.selectExpr("cast(doc_id as long) doc_id", "quality").where(bucket(F.col("doc_id"), 5) != 0)
    model = train(docs.where(bucket(F.col("doc_id"), 5) != 0), learn, sample)
    scored = score_texts(docs.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
