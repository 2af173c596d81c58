"""Near-duplicate detection by a multi-index Hamming join over b-bit MinHash signatures.

A text's signature has 80 symbols of 16 bits. It is cut into 16 chunks of 5 symbols, in each of which one error is
allowed: a key is a chunk without one of its symbols, so 80 keys. By the pigeonhole principle, every pair of signatures
that differ in at most 31 symbols shares a key (at a similarity of 0.75, 20 are expected, and a pair without a key has a
chance of 1e-7). Links are confirmed on the full shingle sets.

Texts with equal sets are one class from the start. Then, in two rounds, classes that share a key are compared. First each
with the least class of its key, its hub: that settles large groups with rows in proportion to their members. Then, among
all classes with a hub in common - any two that share a key have one -, all pairs that are in different components still
and close by a second signature, of 2048 symbols. No link between components can be left over after that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .bpe import Bounded
from .common import stage

WORDS = 5
SYMBOLS, CHUNK = 80, 5
#: Symbols in which signatures may differ for the pair to be confirmed: 20 are expected at 0.75, with a deviation of 3.9.
FAR = 40
#: Symbols of 8 bits of the second signature, and in how many of them a pair may differ to be confirmed: at a similarity of
#: 0.75, 510 are expected, with a deviation of 19.6; the chance that a pair at the threshold differs in more is 1e-7.
FINE, FINE_FAR = 2048, 618
#: Members of a hub that are compared at once: twice as many, in two blocks. Blocks grow with the hub, so that a member has no
#: more than SPREAD copies, up to the widest: two of these are about 37 MB.
BLOCK, WIDEST = 512, 8192
SPREAD = 64
#: Pairs that are handed on at once.
PAIRS = 100_000
#: Keys that a hub's rows are dealt over in joins, so that no task gets all rows of a hub.
SALTS = 16
#: Classes whose keys one task makes.
KEYED = 10_000
#: Pairs that are confirmed in one task, on average.
CELL_PAIRS = 400
_RANDOM = np.random.default_rng(11)
_A = _RANDOM.integers(0, 1 << 63, SYMBOLS + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, SYMBOLS + FINE, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sets of 5-word shingles as sorted 64-bit hashes."""

    def __init__(self):
        self.hash = Bounded(xxhash.xxh64_intdigest, 100_000)

    def shingles(self, text: str | None) -> np.ndarray:
        """Words are runs of bytes other than space and \\t to \\r, with A-Z in lower case; fewer than five make one shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = out * _STEP + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return np.unique(out)


def _least(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(a))
    for at in range(0, len(shingles), step):
        values = shingles[at : at + step, None] * a
        values += b
        np.minimum(least, values.min(0), out=least)
    return least >> np.uint64(16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """80 symbols of 16 bits: low bits of the least value of each hash function."""
    return (_least(shingles, _A[:SYMBOLS], _B[:SYMBOLS]) & np.uint64(0xFFFF)).astype(np.uint16)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """2048 symbols of 8 bits, of other hash functions."""
    return (_least(shingles, _A[SYMBOLS:], _B[SYMBOLS:]) & np.uint64(0xFF)).astype(np.uint8)


def keys(signatures: np.ndarray) -> np.ndarray:
    """The 80 keys of each signature: every chunk without one of its symbols, with its place mixed in."""
    x = signatures.astype(np.uint64).reshape(len(signatures), SYMBOLS // CHUNK, CHUNK)
    out = np.empty((len(signatures), SYMBOLS // CHUNK, CHUNK), np.uint64)
    place = np.arange(SYMBOLS // CHUNK, dtype=np.uint64) * np.uint64(CHUNK)
    for left_out in range(CHUNK):
        packed = np.zeros(x.shape[:2], np.uint64)
        for i in range(CHUNK):
            if i != left_out:
                packed = packed << np.uint64(16) | x[:, :, i]
        out[:, :, left_out] = (packed ^ ((place + np.uint64(left_out + 1)) * _STEP)) * _MIX
    return (out ^ (out >> np.uint64(31))).reshape(len(signatures), SYMBOLS)


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (of the set) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingler.shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "class", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, signature binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """key and node for each of a class's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys(signatures).view(np.int64).ravel()), pa.array(node)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most FAR symbols."""
    sides = pairs.join(classes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(classes.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            near = pa.array((x != y).sum(1) <= FAR)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    return sides.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """Pairs (a, b) of doc_ids whose shingle sets have denominator * intersection >= numerator * union.

    Pairs are dealt over a grid of cells by both ends, so that a document with many partners is sent to a few cells only; one
    with more pairs than a row of the grid is to hold has them dealt finer, by the other end.
    """
    total = pairs.count()
    side = max(1, int(np.ceil(np.sqrt(total / CELL_PAIRS))))
    busy = lambda end: F.broadcast(stage(pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / CELL_PAIRS).cast("long").alias(f"parts_{end}")).where(F.col(f"parts_{end}") > side), "busy"))  # noqa: E731 at most as many as sides
    part = lambda end, other: F.pmod(F.xxhash64(end), F.greatest(F.coalesce(f"parts_{other}", F.lit(side)), F.lit(side)))
    dealt = pairs.join(busy("a"), "a", "left").join(busy("b"), "b", "left").select("a", "b", F.xxhash64(part("a", "b"), part("b", "a")).alias("cell"))
    members = dealt.select(F.col("cell").alias("home"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["node", "set"])

    needed = members.select(F.col("node").alias("doc_id")).distinct()
    sets = stage(docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").mapInArrow(run, "node long, set binary"), "sets")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {n: np.frombuffer(s, np.uint64) for n, s in zip(left["node"], left["set"], strict=True)}
        out = []
        for a, b in zip(right["a"], right["b"], strict=True):
            x, y = found[a], found[b]
            if denominator * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    return members.join(sets, "node").groupBy("home").cogroup(dealt.groupBy("cell")).applyInPandas(check, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """cell for rows (hub, node, ..., n): a hub's members go to one cell where they are few, else each to the cells of its block with every other.

    A hub of n members makes n * max(1, min(n / BLOCK, SPREAD), n / WIDEST) rows, rounded up.
    """
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(WIDEST), F.ceil(F.col("n") / SPREAD)))
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.xxhash64("hub", F.least(own, o), F.greatest(own, o)))
    return rows.withColumn("block", own).withColumn("cell", F.explode(cells))


def _fine(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and second signature of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [fine_signature(shingler.shingles(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["node", "fine"])

    return docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(run, "node long, fine binary")


def _across(rows: DataFrame) -> DataFrame:
    """Distinct pairs of nodes of one cell that are in different components and whose signatures, first and second, are close."""

    def pairs(cell: list[tuple]) -> Iterator[tuple[int, int]]:
        node, block, component, first, fine = zip(*cell, strict=True)
        x = np.frombuffer(b"".join(first), np.uint16).reshape(-1, SYMBOLS)
        s = np.frombuffer(b"".join(fine), np.uint8).reshape(-1, FINE)
        node, block, component = (np.array(c) for c in (node, block, component))
        whole = len(set(block.tolist())) == 1
        for i in range(len(node) - 1):
            j = np.flatnonzero((component[i + 1 :] != component[i]) & (whole | (block[i + 1 :] != block[i]))) + i + 1
            j = j[(x[j] != x[i]).sum(1) <= FAR]
            for k in node[j[(s[j] != s[i]).sum(1) <= FINE_FAR]].tolist() if len(j) else ():
                yield (int(node[i]), k) if node[i] < k else (k, int(node[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            at, held = None, []  # the rows of a cell come together
            for batch in batches:
                for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if cell != at and held:
                        yield from pairs(held)
                        held = []
                    at = cell
                    held.append(tuple(row))
            if held:
                yield from pairs(held)

        for some in batched(found(), PAIRS):
            yield _pairs(some)

    dealt = rows.select("cell", "node", "block", "component", "signature", "fine").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: Sequence[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Null and empty texts and texts of white space have no shingles and are linked with nothing: component_id is their
    doc_id. Rows with a null doc_id are linked with nothing: component_id is null, kept is true. Repeated rows are copies
    of one document, each kept or not as it is; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sketches = stage(_sketch(docs), "sketches")
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = stage(real.groupBy("class").agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature"), F.count(F.lit(1)).alias("copies")), "classes")
    keyed = _keyed(classes.repartition(classes.count() // KEYED + 1, "node"))  # else few tasks would make all keys, and sum them up in memory
    shared = stage(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    members = stage(keyed.join(shared, "key").select("hub", "node").distinct(), "members")  # hubs with all classes that share a key with them
    stars = stage(_apart(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), classes), "stars")
    links = stage(confirm(stars, docs), "links")
    component = connected_components(links, stage)
    labelled = stage(members.join(component, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component")), "labelled")
    mixed = labelled.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("hub", "n")
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = stage(labelled.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(mixed, ["hub", "salt"]).drop("salt"), "open")
    fine = _fine(docs, open_.select("node").distinct()).join(classes.select("node", "signature"), "node")
    rest = stage(_across(_blocks(open_.join(stage(fine, "fine"), "node"))).join(stars, ["a", "b"], "left_anti"), "rest")
    more = confirm(rest, docs)
    component = connected_components(links.unionByName(more), stage)
    found = classes.join(component, "node", "left").select("class", F.coalesce("component", "node").alias("component"), "node", "copies").where("copies > 1 or component <> node")
    salts = 32  # copies of a class are dealt over so many keys
    found = found.select("class", "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    ends = sketches.select("doc_id", "n_shingles", "class").withColumn("salt", F.abs(F.hash("doc_id")) % salts)
    ends = ends.join(found, ["class", "salt"], "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return ends.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))
