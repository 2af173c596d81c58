"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; a linear classifier over hashed byte n-grams predicts each bit. A text gets the
language whose codeword has the least loss, in which each bit counts by how well it was learned for that language. The
share of the best language in exp(-loss) is the score; texts whose two best languages are close are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_once, kinds
from .sampling import bucket, lowest_each, texts_of

#: Labelled rows that the classifiers are fitted on at most, dealt evenly to the languages, and what each gets at least.
SAMPLE, LEAST = 4000, 50
BUCKETS, ORDERS = 4096, (1, 2, 3)
#: Rows that the fit holds at once.
CHUNK = 4000
#: A text is ambiguous if its best language has less than this lead over the second in the score.
LEAD = 0.1


def featurise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (of length 1) of a text's byte n-grams in lower case."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    gram = np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        gram = gram[: len(data) - order + 1] * np.uint32(256) + data[order - 1 :]
        if order in ORDERS and len(gram):
            counts += np.bincount(((gram + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weight = np.sqrt(counts[at]).astype(np.float32)
    return at.astype(np.int32), weight / np.linalg.norm(weight)


def codewords(n: int) -> np.ndarray:
    """n codewords: every split of the languages in two where these are few, else far-apart random ones."""
    if n <= 7:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if c in s else -1 for s in splits] for c in range(n)]).reshape(n, -1)
    random, best, far = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = random.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min((code[a] != code[b]).sum() for a, b in combinations(range(n), 2))
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # languages x bits, how far a bit is trusted for a language
    linear: np.ndarray  # buckets x bits
    bias: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (self.weight * np.log1p(np.exp(-self.code * margins))).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        lead = share[order[0]] - (share[order[1]] if len(order) > 1 else 0)
        return self.languages[order[0]], float(share[order[0]]), bool(lead < LEAD)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        at, value = featurise(text)
        return self.decode(value @ self.linear[at] + self.bias)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], steps: int = 150) -> Model:
    """A model of (language, buckets, weights) rows: logistic regression for each bit, by Adam over all rows, CHUNK of them at once."""
    languages = sorted({r[0] for r in rows})
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 0)), np.ones((len(languages), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    code = codewords(len(languages)).astype(np.float32)
    number = {c: i for i, c in enumerate(languages)}
    mine = np.array([number[r[0]] for r in rows])
    y = code[mine]
    per = np.bincount(mine, minlength=len(languages))
    share = (1 / per[mine] / len(languages)).astype(np.float32)[:, None]  # each language counts alike
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    x = np.zeros((min(len(rows), CHUNK), BUCKETS), np.float32)

    def chunks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            if len(rows) > CHUNK or not x.any():
                x[:] = 0
                for i, (_, places, value) in enumerate(part):
                    x[i, places] = value
            yield slice(at, at + len(part)), x[: len(part)]

    for step in range(1, steps + 1):
        gw, gb = 1e-6 * w, np.zeros_like(b)
        for part, some in chunks():
            slope = -y[part] * share[part] / (1 + np.exp(np.clip(y[part] * (some @ w + b), -30, 30)))
            gw += some.T @ slope
            gb += slope.sum(0)
        for k, (p, g) in enumerate(((w, gw), (b, gb))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    right = np.concatenate([(np.sign(some @ w + b) == y[part]).astype(np.float64) for part, some in chunks()])
    trust = np.array([right[mine == c].mean(0) for c in range(len(languages))]) + 1e-6
    return Model(languages, code, trust / trust.sum(1, keepdims=True) * code.shape[1], w, b)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of docs (doc_id, text, lang) with a language and a text, every language with its share or 50 rows.

    Rows that agree in doc_id and language count once, with one of their texts. The fit runs on an executor.
    """
    usable = docs.where("lang is not null and length(text) > 0 and doc_id is not null")
    languages = usable.select("lang").distinct().count()
    chosen = lowest_each(usable.select("doc_id", "lang"), "lang", max(LEAST, sample // max(languages, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [featurise(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), batch.column("lang"), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "at", "weight"])

    def learn(found: pa.Table) -> Model:
        rows = sorted(zip(found["doc_id"].to_pylist(), found["lang"].to_pylist(), found["at"], found["weight"], strict=True), key=lambda r: r[:2])
        return fit([(r[1], r[2].values.to_numpy(), r[3].values.to_numpy()) for r in rows])

    texts = texts_of(usable, chosen, "doc_id", "lang").select("doc_id", "lang", "text")
    return fit_once(texts.mapInArrow(run, "doc_id long, lang string, at array<int>, weight array<float>"), learn)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with lang_pred, score and ambiguous, which replace columns of these names; `und`, 0 and ambiguous for a null text or one without a letter."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *added])

    added = ["lang_pred", "score", "ambiguous"]
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(*added)
    keep = docs.columns
    return docs.mapInArrow(run, f"{kinds(docs, *keep)}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row of docs (doc_id, text, lang).

    Learns from text and lang of rows whose crc32 of doc_id is not 2 modulo 4. A null doc_id counts as not held out and
    is not learned from. Repeated rows each give a row and are learned from once. Whole texts count, however long; a null or
    empty text is `und`. With no labelled row, every language is `und`; further columns are ignored; an empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    model = train(docs.where(bucket(F.col("doc_id"), 4) != 2), sample)
    held = docs.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(held, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
