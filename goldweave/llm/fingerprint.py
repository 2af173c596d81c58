"""Homomorphic fingerprints of documents.

A text is a multiset of paragraphs. Each paragraph is hashed to a wide vector, and the fingerprint is the sum of these
vectors with each lane modulo a power of two: it doesn't depend on the order, and paragraphs are put in or taken out by
adding or subtracting their vectors. The vector has two parts: dense lanes of 64 bits, filled from a cryptographic hash of
the whole paragraph, hold equality; sketch lanes of 32 bits, to which each window of the paragraph's characters adds 1 or
takes 1 away, hold likeness, as the cosine of two texts' sketches estimates the share of windows that they have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE, SKETCH, WINDOW = 8, 256, 8
#: Rows of one batch of a Parquet scan, whose texts lie side by side on the executor's heap.
SCAN_ROWS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def dense_vector(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the dense lanes of paragraphs, modulo 2**64."""
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * DENSE).digest() for p in paragraphs)
    return np.frombuffer(digests, "<u8").reshape(-1, DENSE).sum(0, dtype=np.uint64)


def sketch_vector(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the sketch lanes of paragraphs, modulo 2**32. A window that starts before its paragraph is filled up with blanks."""
    blank = "\0" * (WINDOW - 1)
    codes = np.frombuffer((blank + ("\n" + blank).join(paragraphs)).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < WINDOW:
        return np.zeros(SKETCH, np.uint32)
    n = len(codes) - WINDOW + 1
    mixed = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    for i in range(WINDOW):
        mixed = mixed * _MULTIPLIER + wide[i : i + n]
    last = codes[WINDOW - 1 :]
    mixed = mixed[(last != 10) & (last != 0)]  # windows that end in a paragraph
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    lane = (mixed >> np.uint64(55)).astype(np.int64)  # 9 bits: the lane and the sign
    counts = np.bincount(lane, minlength=2 * SKETCH)
    return (counts[:SKETCH] - counts[SKETCH:]).astype(np.uint32)


class Fingerprint:
    """The sum of paragraph vectors; texts with equal multisets of paragraphs have equal fingerprints."""

    __slots__ = ("dense", "sketch")

    def __init__(self, dense: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.dense = np.zeros(DENSE, np.uint64) if dense is None else dense
        self.sketch = np.zeros(SKETCH, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, paragraphs: Iterable[str]) -> Fingerprint:
        paragraphs = list(paragraphs)
        return cls(dense_vector(paragraphs), sketch_vector(paragraphs)) if paragraphs else cls()

    @classmethod
    def of_text(cls, text: str | None) -> Fingerprint:
        """Paragraphs are the lines of a text; empty and null texts have none."""
        return cls.of(text.split("\n")) if text else cls()

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and str(self) == str(other)

    __hash__ = None

    def insert(self, *paragraphs: str) -> Fingerprint:
        return self + Fingerprint.of(paragraphs)

    def delete(self, *paragraphs: str) -> Fingerprint:
        return self - Fingerprint.of(paragraphs)

    def __str__(self) -> str:
        return base64.b64encode(self.dense.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        data = base64.b64decode(text)
        return cls(np.frombuffer(data, "<u8", DENSE), np.frombuffer(data, "<u4", SKETCH, 8 * DENSE))

    def near(self, other: Fingerprint) -> float:
        """Likeness from 0 to 1: 1 for equal fingerprints, else the cosine of the sketches where that is above 0."""
        if (self.dense == other.dense).all() and (self.sketch == other.sketch).all():
            return 1.0
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(max(a @ b / size, 0.0), 1.0)) if size else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _heads(ids: DataFrame, partitions: int) -> list[int]:
    """Places at which the order is cut: the least place of each range but the first, at most as many as partitions."""
    found = ids.repartitionByRange(partitions, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("first")).collect()  # a row for each range
    return sorted(r["first"] for r in found)


def _dealt(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, text, part and guest: each row in the part of its place, in order, and each part's first rows as guests at the end of the part before; those of the first part come behind the last."""
    heads = _heads(docs.select("place"), partitions)
    starts = np.array(heads, np.int64)

    @F.pandas_udf("array<int>")
    def parts(place: pd.Series) -> pd.Series:
        """A row's part, and the part that it is a guest of, if any. Places alone go through Python."""
        at = np.maximum(np.searchsorted(starts, place.to_numpy(), "right") - 1, 0)
        head = starts[at] == place.to_numpy() if len(starts) else np.zeros(len(at), bool)
        return pd.Series([[a, (a - 1) % len(starts)] if h else [a] for a, h in zip(at.tolist(), head.tolist(), strict=True)])

    placed = docs.select("*", F.posexplode(parts("place")).alias("guest", "part"))
    return placed.repartitionById(max(len(heads), 1), "part").sortWithinPartitions("part", "guest", "place", "text").drop("place")


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The next document is the next in ascending order of doc_id (null ids come first), of the text among equal ids; the
    first follows the last, and a single row follows itself. Null texts count as empty, further columns are ignored, an
    empty table gives no rows. The texts are moved once: the order is cut into ranges, and the first rows of each range go
    to the range before as well. The session's Parquet scans have at most SCAN_ROWS rows a batch from then on.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(SCAN_ROWS, int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))))
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text", f"coalesce(cast(doc_id as long), {-(1 << 63)}) place")
    dealt = _dealt(docs, partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the row that waits for the next: part, doc_id, text, fingerprint
        rows: list[tuple] = []

        def close(row: tuple, text: str, mark: Fingerprint) -> None:
            changed = edited(row[2], text)
            other = Fingerprint.of_text(changed)
            rows.append((row[1], len(row[2]), hashlib.sha256(changed.encode()).hexdigest(), str(row[3]), str(other), row[3].near(other), row[3].near(mark)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc, text, at, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                if before and before[0] != at:
                    raise AssertionError("a part ended without its follower")
                if guest and before is None:
                    continue  # further rows with a follower's id
                mark = Fingerprint.of_text(text)
                if before:
                    close(before, text, mark)
                before = None if guest else (at, doc, text, mark)
            yield out()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
