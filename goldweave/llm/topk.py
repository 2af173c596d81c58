"""Exact top-k search by Hamming distance over binary codes, by incremental multi-index hashing.

A code is cut into m segments of about log2(rows) bits, and every distinct code is indexed by each of them. Queries grow
their radius: at radius r a query looks up, segment by segment, the values that differ from its own in exactly r bits. Once
segments 0..j have been searched at radius r, every code within m * r + j of the query has been verified; a query ends when
its kth distance is that near, and skips the segments behind it.

The index is dealt into cells: a segment with the high bits of its value. A cell holds a bounded number of codes, sorted by
the low bits, and a cell with more of them is split. Only queries move: one row for each cell whose high bits are within
the radius, and in the cell the low bits are looked up by masks, or by a count of differing bits where there are more masks
than codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

RESULT = "query_id long, rank int, vec_id long, distance int"
#: Codes of a cell, on average and at most.
CELL = 1 << 13
#: Lookups and candidates that are held at once in a cell.
HELD = 1 << 21
#: Queries of one code that one task expands.
COPIES = 10_000
#: No distance is as far.
FAR = 1 << 30


@dataclass(frozen=True)
class Layout:
    """How the codes of one width are cut: segments from bound to bound, and how many of a segment's bits name its cell."""

    bounds: tuple[int, ...]
    high: tuple[int, ...]

    @classmethod
    def of(cls, width: int, codes: int) -> Layout:
        bits = min(max(ceil(log2(max(codes, 2))), 8), 30)
        m = ceil(width / bits)
        bounds = tuple(width * i // m for i in range(m + 1))
        return cls(bounds, tuple(min(max(0, ceil(log2(max(codes, 1) / CELL))), b - a) for a, b in zip(bounds, bounds[1:], strict=False)))

    @property
    def segments(self) -> int:
        return len(self.high)

    def low(self, segment: int) -> int:
        return self.bounds[segment + 1] - self.bounds[segment] - self.high[segment]

    def values(self, bits: np.ndarray, segment: int) -> np.ndarray:
        """Values of a segment, of rows of bits."""
        part = bits[:, self.bounds[segment] : self.bounds[segment + 1]]
        return part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64))

    def masks(self) -> np.ndarray:
        """For each segment the words that cover it."""
        ends = np.zeros((self.segments, self.bounds[-1]), np.uint8)
        for i in range(self.segments):
            ends[i, self.bounds[i] : self.bounds[i + 1]] = 1
        return _words(_packed(ends))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes, filled up to whole words of 8."""
    out = np.packbits(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8)))


def _words(packed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(packed).view(np.uint64)


def _unpacked(codes: list[bytes], width: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(rows, axis=1, count=width).astype(np.int64)


@lru_cache(maxsize=256)
def _flips(bits: int, n: int) -> np.ndarray:
    """All masks with n of some bits."""
    return np.array([sum(1 << i for i in chosen) for chosen in combinations(range(bits), n)], np.int64)


def sign_codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, width and code: the signs of a vector's coordinates as bits.

    A coordinate above 0 gives 1 (not-a-number as well), a null one 0. Rows without an id or with a null or empty vector are
    left out. A repeated id counts once, with its greatest code (the longest, of these the greatest bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            codes = np.empty(len(size), object)
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                x = values[at[rows][:, None] + np.arange(width)]
                codes[rows] = [r.tobytes() for r in _packed((x > 0) | np.isnan(x))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array(codes, pa.binary())], ["vec_id", "width", "code"])

    known = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    signs = known.mapInArrow(run, "vec_id long, width int, code binary")
    best = signs.groupBy("vec_id").agg(F.max(F.struct("width", "code")).alias("best"))
    return best.select("vec_id", "best.width", "best.code")


def _index(layouts: dict[int, Layout], codes: DataFrame) -> DataFrame:
    """width, segment, high and low (bits of its value), least and code: a row for each segment of each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                layout, rows = layouts[width], batch.filter(pa.array(widths == width))
                bits = _unpacked(rows.column("code").to_pylist(), width)
                for i in range(layout.segments):
                    value, low = layout.values(bits, i), layout.low(i)
                    arrays = [rows.column("width"), pa.array(np.full(len(value), i, np.int32)), pa.array((value >> low).astype(np.int32)), pa.array((value & ((1 << low) - 1)).astype(np.int32)), rows.column("least"), rows.column("code")]
                    yield pa.RecordBatch.from_arrays(arrays, ["width", "segment", "high", "low", "least", "code"])

    return codes.select("width", "least", "code").mapInArrow(run, "width int, segment int, high int, low int, least long, code binary")


def _probes(layouts: dict[int, Layout], first: int, last: int, queries: DataFrame) -> DataFrame:
    """A row for each cell that a query (width, least, code, far) visits at the radii first to last; away: how many high bits differ.

    Segment i is visited at radius r only if a code as near as the kth may be left, that is if m * r + i <= far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                layout, rows = layouts[width], batch.filter(pa.array(widths == width))
                bits, far = _unpacked(rows.column("code").to_pylist(), width), rows.column("far").to_numpy()
                for i in range(layout.segments):
                    near = np.flatnonzero(layout.segments * first + i <= far)
                    if not len(near):
                        continue
                    value, low, some = layout.values(bits[near], i), layout.low(i), rows.take(pa.array(near))
                    for away in range(min(last, layout.high[i]) + 1):
                        if last - away < 0 or first - away > low:
                            continue
                        flips = _flips(layout.high[i], away)
                        step = max(1, 100_000 // len(flips))
                        for at in range(0, len(near), step):
                            part, own = some.slice(at, step), value[at : at + step]
                            n = len(own) * len(flips)
                            again = pa.array(np.repeat(np.arange(len(own)), len(flips)))
                            cells = ((own >> low)[:, None] ^ flips).ravel().astype(np.int32)
                            arrays = [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, i, np.int32)), pa.array(cells), pa.array((own & ((1 << low) - 1)).astype(np.int32)).take(again), pa.array(np.full(n, away, np.int32))]
                            yield pa.RecordBatch.from_arrays([*arrays, *(part.column(c).take(again) for c in ("far", "least", "code"))], ["width", "segment", "high", "low", "away", "far", "least", "code"])

    return queries.select("width", "least", "code", "far").mapInArrow(run, "width int, segment int, high int, low int, away int, far int, least long, code binary")


class _Cell:
    """The codes of a cell, sorted by their low bits."""

    def __init__(self, layout: Layout, segment: int, low: np.ndarray, least: np.ndarray, codes: list[bytes], k: int):
        order = np.argsort(low, kind="stable")
        self.bits, self.segment, self.k = layout.low(segment), segment, k
        self.low, self.least, self.words = low[order], least[order], _words(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)[order])
        self.masks = layout.masks()

    def _candidates(self, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a probe and a code whose low bits differ in exactly n places."""
        if comb(self.bits, n) > len(self.low):
            probe, code = np.nonzero(np.bitwise_count(low[:, None] ^ self.low) == n)
            return probe, code
        values = (low[:, None] ^ _flips(self.bits, n)).ravel()
        start = np.searchsorted(self.low, values)
        counts = np.searchsorted(self.low, values, "right") - start
        hit = np.flatnonzero(counts)
        start, counts = start[hit], counts[hit]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(hit // (len(values) // len(low)), counts), np.repeat(start, counts) + inside

    def search(self, low: np.ndarray, away: np.ndarray, far: np.ndarray, words: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Probe, distance and least of what the probes find here, the k nearest of each. A code counts where it is found first: no segment before is as near, none behind is nearer."""
        found = []
        for radius in range(first, last + 1):
            for a in np.unique(away).tolist():
                n = radius - a
                if not 0 <= n <= self.bits:
                    continue
                rows = np.flatnonzero((away == a) & (len(self.masks) * radius + self.segment <= far))
                step = max(1, HELD // max(min(comb(self.bits, n), len(self.low)), len(self.low) // 2))
                for at in range(0, len(rows), step):
                    mine = rows[at : at + step]
                    probe, code = self._candidates(low[mine], n)
                    probe = mine[probe]
                    apart = words[probe] ^ self.words[code]
                    total = np.bitwise_count(apart).sum(1, dtype=np.int32)
                    good = np.flatnonzero(total <= far[probe])
                    probe, code, apart, total = probe[good], code[good], apart[good], total[good]
                    for i, mask in enumerate(self.masks):
                        if i != self.segment:
                            d = np.bitwise_count(apart & mask).sum(1, dtype=np.int32)
                            good = np.flatnonzero(d > radius if i < self.segment else d >= radius)
                            probe, code, apart, total = probe[good], code[good], apart[good], total[good]
                    found.append(self._nearest(probe, total, self.least[code]))
        return self._nearest(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else (np.zeros(0, int),) * 3

    def _nearest(self, probe: np.ndarray, total: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((least, total, probe))
        probe, total, least = probe[order], total[order], least[order]
        begin = np.flatnonzero(np.concatenate([[True], probe[1:] != probe[:-1]])) if len(probe) else np.zeros(0, int)
        rank = np.arange(len(probe)) - np.repeat(begin, np.diff(np.append(begin, len(probe))))
        good = rank < self.k
        return probe[good], total[good], least[good]


def _visit(layouts: dict[int, Layout], index: DataFrame, probes: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """query (its code's least id), width, distance and least of the codes that probes find in their cells. A cell's codes come first, then its probes, batch by batch."""
    cell = ["width", "segment", "high", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, here = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in cell], 1).astype(np.int64)
            away = batch.column("away").to_numpy()
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1) | ((away[1:] < 0) != (away[:-1] < 0))) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(away)], strict=True):
                if a == b:
                    continue
                if (mine := tuple(key[a].tolist())) != at:
                    at, parts, here = mine, [], None
                low, least, codes = (batch.column(c).slice(a, b - a) for c in ("low", "least", "code"))
                if away[a] < 0:
                    parts.append((low.to_numpy().astype(np.int64), least.to_numpy(), codes.to_pylist()))
                    continue
                if here is None and parts:
                    here = _Cell(layouts[mine[0]], mine[1], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [c for p in parts for c in p[2]], k)
                if here is None:
                    continue  # a cell without codes
                rows = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(b - a, -1)
                probe, distance, near = here.search(low.to_numpy().astype(np.int64), away[a:b], batch.column("far").slice(a, b - a).to_numpy(), _words(rows), first, last)
                out.append((least.to_numpy()[probe], np.full(len(probe), mine[0], np.int32), distance.astype(np.int32), near))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "width", "distance", "least"])

    codes = index.withColumns({"away": F.lit(-1), "far": F.lit(0)})
    names = [*cell, "away", "low", "far", "least", "code"]
    both = codes.select(*names).unionByName(probes.select(*names))
    return both.repartition(*cell).sortWithinPartitions(*cell, "away").mapInArrow(run, "query long, width int, distance int, least long")


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance: the k rows nearest to each query among those of its width, ties by vec_id, itself included.

    codes has vec_id, width and code, each id once; queries has query_id, width and code, and its codes are among these.
    Equal codes are searched and verified once. With fewer than k rows of a width a query gets them all; with none, nothing.
    """
    spark = codes.sparkSession
    code = ["width", "code"]
    order = Window.partitionBy(*code).orderBy("vec_id")
    kept = codes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)  # before the shuffle already, so that no code is hot
    known = stage(kept.groupBy(*code).agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "codes")
    sizes = dict(known.groupBy("width").count().collect())  # a row for each width
    if not sizes:
        return spark.createDataFrame([], RESULT)
    layouts = {w: Layout.of(w, n) for w, n in sizes.items()}
    index = stage(_index(layouts, known), "index")
    cell = ["width", "segment", "high"]
    hot = stage(index.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (4 * CELL)).cast("int").alias("salts")).where("salts > 1"), "hot")
    hot = F.broadcast(hot)  # at most a row for each 4 * CELL rows of the index
    one = F.coalesce("salts", F.lit(1))
    index = index.join(hot, cell, "left").withColumn("salt", F.pmod(F.xxhash64("least"), one).cast("int"))
    asked = stage(queries.select("query_id", *code).join(known.select(*code, "least").hint("merge"), code).select("query_id", "least", *code), "asked")
    open_ = asked.select("least", *code).distinct()
    goal, reach = (F.create_map(*[F.lit(v) for w, n in sizes.items() for v in (w, f(w, n))]) for f in (lambda _, n: min(k, n), lambda w, _: layouts[w].segments))
    left, best, done = open_.withColumn("far", F.lit(FAR)), None, []
    first, last = 0, 1
    while best is None or not best.where("not ended").isEmpty():
        probes = _probes(layouts, first, last, left).join(hot, cell, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1)))
        found = _visit(layouts, index, probes, first, last, k)
        if best is not None:
            found = found.unionByName(best.where("not ended").select("query", "width", "distance", "least"))
        nearest = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "least"))).where(F.col("rank") <= k)
        whole = Window.partitionBy("query")
        far = F.when(F.count(F.lit(1)).over(whole) >= goal[F.col("width")], F.max("distance").over(whole)).otherwise(F.lit(FAR))  # of the kth code, which is no nearer than the kth row
        best = stage(nearest.withColumn("far", far).withColumn("ended", F.col("far") < reach[F.col("width")] * (last + 1)).drop("rank"), "nearest")
        done.append(best.where("ended"))
        # each query has found itself at least
        still = best.where("not ended").groupBy(F.col("query").alias("least")).agg(F.min("far").alias("far"))
        left = open_.join(still.hint("merge"), "least")
        first = last = last + 1
    done = reduce(DataFrame.unionByName, done)
    rows = done.join(known.select("least", "ids").hint("merge"), "least").select("query", "distance", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query").orderBy("distance", "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    lists = ranked.groupBy(F.col("query").alias("least")).agg(F.collect_list(F.struct("rank", "vec_id", "distance")).alias("near"))  # k each
    many = asked.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("salts")).where("salts > 1")
    many = F.broadcast(stage(many, "many"))  # at most a row for each COPIES queries
    lists = lists.join(many, "least", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    each = asked.join(many, "least", "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), one).cast("int")).select("query_id", "least", "salt")
    return each.join(lists.hint("merge"), ["least", "salt"]).select("query_id", F.inline("near")).select("query_id", "rank", "vec_id", "distance")


def search_embeddings(embeddings: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """Search the sign codes of embeddings (vec_id, embedding); queries are the rows whose id is divisible by `every`, against all rows of their width.

    Null ids and null or empty vectors are left out, an id that repeats counts once with its greatest code, further columns
    are ignored, an empty table gives no rows.
    """
    codes = stage(sign_codes(embeddings), "signs")
    queries = codes.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(codes, queries, k)
