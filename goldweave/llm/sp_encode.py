"""Encode and decode whole texts with a sentencepiece model of the merge type."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMO = 300_000


class Codec:
    """Encodes texts unit by unit; each distinct unit is encoded, and its ids decoded, once a process while the memo holds it."""

    def __init__(self, model: bpe.PieceModel):
        self.model = model
        self.numbers = [f",{i}" for i in range(len(model.pieces))]
        self.raw = bpe.Bounded(self._unit, MEMO)
        self.word = bpe.Bounded(lambda word: self._unit(bpe.SPACE + word), MEMO)

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, each behind a comma, or a semicolon at the start if they decode to something else than the unit."""
        ids = self.model.unit_ids(unit)
        out = "".join(map(self.numbers.__getitem__, ids)).encode()
        return out if self.model.surface(ids) == unit.replace(bpe.SPACE, " ") else b";" + out[1:]

    def values(self, text: str) -> list[bytes]:
        """Ids of each unit, in order."""
        if not text:
            return []
        if text[0] == " " or "  " in text or bpe.SPACE in text or not self.model.line_is_hard:
            return [self.raw[u] for u in self.model.units(text)]
        word, raw = self.word.__getitem__, self.raw
        first, *lines = text.split("\n")
        out = list(map(word, first.split(" ")))
        for line in lines:
            out.append(raw["\n"])
            start, *words = line.split(" ")
            if start:
                out.append(raw[start])
            out += map(word, words)
        return out

    def encode(self, text: str) -> list[int]:
        ids = b"".join(self.values(text)).replace(b";", b",")
        return [int(i) for i in ids[1:].split(b",")] if ids else []

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the text that they decode to."""
        ids, decoded = b"".join(self.values(text)), text.replace(bpe.SPACE, " ")
        if b";" in ids:
            ids = ids.replace(b";", b",")
            decoded = self.model.decode([int(i) for i in ids[1:].split(b",")])
        return ids.count(b","), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of ints) of each row. Null texts count as empty; empty texts have no ids; repeated rows each give a row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(bpe.load(model_path))
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text that ids decode to; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(model_path)
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text; without a shuffle, one row for each row.

    Null texts count as empty: no ids, and the digests of nothing. Null ids, repeated rows and extra columns do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(bpe.load(model_path))
        for batch in batches:
            found = [codec.digests(t or "") for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGESTS)
