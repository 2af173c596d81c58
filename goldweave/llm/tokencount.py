"""Token counts without ids: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import stage

#: Pre-tokens that are broadcast, and the longest of them in characters: with them the broadcast's size is bounded.
HEAD, HEAD_CHARS = 100_000, 64
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 200_000


def pre_tokens(model: bpe.PieceModel, text: str) -> Counter:
    """Frequencies of the units of a text. Keys: a unit's text after its leading space, or a newline and the unit if it has none."""
    counts: Counter = Counter()
    if not text:
        return counts
    if text[0] == " " or "  " in text or bpe.SPACE in text or not model.line_is_hard:
        counts.update([u[1:] if u[0] == bpe.SPACE else "\n" + u for u in model.units(text)])
        return counts
    first, *lines = text.split("\n")
    counts.update(first.split(" "))
    for line in lines:
        start, *words = line.split(" ")
        if start:
            counts["\n" + start] += 1
        counts.update(words)
    if lines:
        counts["\n\n"] += len(lines)
    return counts


def pieces(model: bpe.PieceModel, key: str) -> int:
    return len(model.unit_ids(key[1:] if key[:1] == "\n" else bpe.SPACE + key))


def pre_token_table(docs: DataFrame, model_path: str) -> DataFrame:
    """unit, freq and n_pieces: each distinct pre-token of a corpus once. Counts are added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = bpe.load(model_path), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["unit", "freq"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pre_tokens(model, text or ""))
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(model_path)
        for batch in batches:
            n = [pieces(model, u) for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["unit", "freq", "n_pieces"])

    found = docs.selectExpr("cast(text as string) text").mapInArrow(count, "unit string, freq long").groupBy("unit").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(size, "unit string, freq long, n_pieces long")


def head_of(units: DataFrame, most: int = HEAD) -> tuple[int, dict[str, int]]:
    """The frequency from which pre-tokens are in the head, and the head's piece counts: at most `most` short pre-tokens."""
    steps = units.where(F.length("unit") <= HEAD_CHARS).groupBy(F.floor(F.log2("freq") * 8).cast("int").alias("step")).count().collect()  # a few hundred rows at most
    total, lowest = 0, None
    for step, n in sorted(((r[0], r[1]) for r in steps), reverse=True):
        if total + n > most:
            break
        total, lowest = total + n, step
    if lowest is None:
        return 1 << 62, {}
    rows = units.where((F.length("unit") <= HEAD_CHARS) & (F.floor(F.log2("freq") * 8) >= lowest)).select("unit", "n_pieces").collect()
    return lowest, {r[0]: r[1] for r in rows}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Frequent pre-tokens are looked up in a broadcast of bounded size while a document's frequencies are made; the others
    go through a join, in which none can be hot. Null texts count as empty (0 bytes and tokens). Repeated rows each give
    a row, a null doc_id stays null, extra columns are left out, an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    units = stage(pre_token_table(docs, model_path), "pretokens")
    known = spark.sparkContext.broadcast(head_of(units, head)[1])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = bpe.load(model_path), known.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                sure, rest = 0, []
                for unit, n in pre_tokens(model, text or "").items():
                    if (size := head.get(unit)) is None:
                        rest.append((doc, mark, 0, 0, 0, unit, n))
                    else:
                        sure += n * size
                # the document's own row rides on one of its rare pre-tokens; without any, on a key of its own that no pre-token has
                own = rest.pop()[5:] if rest else (f"\n\n{doc} {mark}", 0)
                rows.append((doc, mark, 1, len((text or "").encode()), sure, *own))
                rows += rest
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "mark", "own", "n_bytes", "sure", "unit", "n"])

    rows = docs.withColumn("mark", F.xxhash64("text")).mapInArrow(weigh, "doc_id long, mark long, own long, n_bytes long, sure long, unit string, n long")
    tokens = F.sum(F.col("sure") + F.col("n") * F.coalesce("n_pieces", F.lit(0)))
    summed = rows.join(units.select("unit", "n_pieces"), "unit", "left").groupBy("doc_id", "mark").agg(F.sum("own").alias("copies"), F.sum("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    one = summed.selectExpr("doc_id", "n_bytes div copies n_bytes", "n_tokens div copies n_tokens", "copies")
    return one.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} over_limit", "explode(sequence(1L, copies)) copy").drop("copy")
