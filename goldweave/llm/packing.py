"""Pack token pieces into sequences of a fixed size.

The lengths of all pieces form a histogram of at most `size` counts. Patterns of a few lengths that fill a sequence well
are enumerated over it, their repeat counts are fitted to it by non-negative least squares and rounded down, and what is
left is packed best-fit, longest first. The plan is a bounded list of intervals of ranks, so that each piece finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bounded
from .common import stage

SIZE = 2048
MEMO = 500_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# How the tokenizer must prepare and cut texts for words to be cut here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# Letters of which each has one small form, and a word's parts as the tokenizer cuts it if it has no others.
_LATIN = "a-zß-öø-ÿ"
_SIMPLE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it is printable, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _check(path: str) -> None:
    """An error if a file's tokenizer prepares or cuts texts in another way than words are cut here; it is read once a process."""
    with open(path, "rb") as f:
        told = json.load(f)
    if told["normalizer"] != _NORMALIZER or told["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [_CUT, _BYTES]} or not all(t["content"].startswith("<|") for t in told["added_tokens"]):
        raise ValueError("the tokenizer prepares or cuts texts in another way than this cutter")


class WordIds:
    """Ids of texts by a tokenizer whose normaliser and pre-tokenizer never look across white space; words are encoded once while the memo holds them.

    Words of plain and western letters, digits and signs are cut here as the tokenizer would, and its model is asked once
    for each part; all other words, those with an apostrophe or the start of a special token among them, go through it whole.
    A tokenizer that prepares or cuts texts in another way is an error.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        _check(path)
        self.words, self.parts = Bounded(self._word, MEMO), Bounded(self._part, 300_000)
        self.letters, self.tokenize = _byte_letters(), self.tokenizer.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if not _SIMPLE.fullmatch(word) or "'" in word or "<|" in word:
            return self._whole(word)
        small = word.lower()
        return self.parts[small] if small.isalpha() else b"".join(map(self.parts.__getitem__, _PARTS.findall(small)))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        word = self.words.__getitem__
        # Python also splits at four separators of ASCII that the tokenizer takes for text
        return [self._whole(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else b"".join(map(word, t.split())) for t in texts]


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task that made it and its rank there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, ranks = WordIds(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data = ids + end
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    length = len(part) // 4
                    rows.append((doc, piece, piece * size, length, zlib.crc32(part), task, ranks[length]))
                    ranks[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def patterns_of(counts: dict[int, int], size: int = SIZE, slack: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to four present lengths, longest first, whose sum is at most the size and within the slack of it."""
    present = np.array(sorted(counts), np.int64)
    largest = lambda room: int(present[i - 1]) if (i := np.searchsorted(present, room, "right")) else 0
    popular = sorted(counts, key=lambda n: (-counts[n] * n, n))[:24]
    found: set[tuple[int, ...]] = set()

    def add(*parts: int) -> None:
        if all(parts) and size - slack <= sum(parts) <= size:
            found.add(tuple(sorted(parts, reverse=True)))

    for a in map(int, present):
        room = size - a
        add(a)
        i = np.searchsorted(present, room, "right")
        for b in map(int, present[max(0, i - 3) : i]):
            add(a, b)
        between = np.searchsorted(present, room)
        spread = {int(present[j]) for j in np.linspace(0, max(between - 1, 0), 10).astype(int)} if between else set()
        for b in sorted(spread | {p for p in popular if p < room}):
            c = largest(room - b)
            add(a, b, c)
            half = largest((room - b) // 2)
            if half:
                add(a, b, half, largest(room - b - half))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], size: int = SIZE, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - counts|^2, A[l, p] being how often pattern p has length l, by accelerated projected gradient."""
    target = np.zeros(size + 1)
    for length, n in counts.items():
        target[length] = n
    column = np.concatenate([np.full(len(p), i) for i, p in enumerate(patterns)])
    row = np.array([length for p in patterns for length in p])
    x = np.zeros(len(patterns))
    forward = lambda v: np.bincount(row, v[column], size + 1)
    back = lambda r: np.bincount(column, r[row], len(patterns))
    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


@dataclass
class Plan:
    """Slots by length: rank from which, sequence of that rank, place in the sequence."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def make_plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Places for all pieces of a histogram of lengths from 1 to size; the work depends on the number of lengths, not of pieces."""
    left, slots, sequences = dict(counts), defaultdict(list), 0
    rank: dict[int, int] = defaultdict(int)

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        slots[length].append((rank[length], sequence, offset))
        rank[length] += n
        left[length] -= n

    patterns = patterns_of(counts, size)
    if patterns:
        repeats = fit_repeats(patterns, counts, size)
        for i in sorted(range(len(patterns)), key=lambda i: (size - sum(patterns[i]), -repeats[i], patterns[i])):
            pattern = patterns[i]
            n = min([int(repeats[i]), *(left[length] // pattern.count(length) for length in set(pattern))])
            if n > 0:
                offset = 0
                for length in pattern:
                    put(length, n, sequences, offset)
                    offset += length
                sequences += n
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left in sequences: runs of them (first, number)
    rooms: list[int] = []
    for length in sorted(left, reverse=True):
        while left[length]:
            fitting = [r for r in rooms if r >= length]
            if fitting:
                best = min(fitting)
                first, n = room[best].pop()
                if not room[best]:
                    rooms.remove(best)
                taken = min(n, left[length])
                put(length, taken, first, size - best)
                moved = [(best - length, (first, taken)), (best, (first + taken, n - taken))]
            else:
                each = size // length
                n, rest = divmod(left[length], each)
                moved = []
                for number, inside in ((n, each), (1, rest)):
                    if number and inside:
                        for k in range(inside):
                            put(length, number, sequences, k * length)
                        moved.append((size - inside * length, (sequences, number)))
                        sequences += number
            for r, run in moved:
                if r and run[1]:
                    if not room[r]:
                        rooms.append(r)
                    room[r].append(run)
    return Plan({length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in slots.items()}, sequences)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A document's ids are followed by id 0; only documents of more than `size` ids are cut. Null texts count as empty: one
    piece of length 1. Rows with a null or repeated doc_id are packed as rows of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    pieces = stage(cut_pieces(docs, tokenizer_path, size), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(make_plan(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value.slots
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    first, run, at = slots[int(length[part[0]])]
                    i = np.searchsorted(first, rank[part], "right") - 1
                    sequence[part], offset[part] = run[i] + rank[part] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
