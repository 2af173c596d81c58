"""Exact merge-type sentencepiece encoding by backtracking.

A text is cut into units that no merge can cross. In a unit, an Aho-Corasick automaton finds the longest pieces; the encoder
holds each against the piece before by merging the two anew, takes the next shorter one where it doesn't fit, and steps back
where nothing does. A place at which nothing fitted stays marked in a bitfield: as the encoding of each prefix is unique,
such a place fails whatever comes before it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick

SPACE = "▁"
# The piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_NO = float("-inf")
_CHANGE = re.compile(r"(?<=[^\W\d_])(?=[\W\d_])|(?<=[\W\d_])(?=[^\W\d_])|(?=\n)(?<!^)|(?<=\n)(?!$)")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 1:
            yield number, data[at : at + 8]
            at += 8
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif wire == 5:
            yield number, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            raise ValueError(f"wire type {wire} in the model file")


class Bounded(dict):
    """A memo that calls make(key) for what it lacks. At its limit it becomes the old generation, from which what is asked for again comes back; results don't depend on it."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PieceModel:
    """A merge-type model with its encoder and decoder. The model must have the identity normaliser and keep white space."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, int]] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        model_type, normaliser = 1, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, score = piece.get(1, b"").decode(), piece.get(3, NORMAL), piece.get(2, 0.0)
                at = len(self.pieces)
                self.pieces.append((text, kind))
                if kind == BYTE:
                    self.byte_ids[int(text[1:-1], 16)] = at
                elif kind == UNKNOWN:
                    self.unknown = at
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                elif kind == NORMAL:
                    self.ids[text], self.score[text] = at, score
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normaliser = dict(_fields(value))
        if model_type != 2:
            raise ValueError("the model is not of the merge type")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("the model needs another normaliser than the identity with a leading space")
        inside = [p for p in self.ids if len(p) > 1]
        self.bigrams = {p[i : i + 2] for p in inside for i in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in self.bigrams):
            raise ValueError("pieces that cross a space are not supported")
        self.line_is_hard = not any("\n" in b for b in self.bigrams)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if self.line_is_hard else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.plain = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.fits = Bounded(self._fits, 300_000)
        self.part_ids = Bounded(self._part_ids, 100_000)

    def remerge(self, text: str) -> list[str]:
        """Merge from single characters: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, _NO) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > _NO:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], _NO)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], _NO)
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the second piece may follow the first ('' at the start)."""
        first, second = pair
        return self.remerge(first + second) == ([first, second] if first else [second])

    def greedy(self, unit: str) -> list[str] | None:
        """The longest match from each match's end on, if these pieces cover the unit and each may follow the one before: then they are the encoding."""
        fits, out, at, before = self.fits, [], 0, ""
        for last, size in self.automaton.iter_long(unit):
            if last + 1 - size != at or not fits[before, piece := unit[at : last + 1]]:
                return None
            out.append(piece)
            at, before = last + 1, piece
        return out if at == len(unit) else None

    def backtrack(self, unit: str) -> list[str]:
        """The pieces of a unit: from each place the longest piece that fits, with steps back where none does."""
        if (out := self.greedy(unit)) is not None:
            return out
        n, known, fits, reach, longest = len(unit), self.ids, self.fits, self.automaton.longest_prefix, self.longest
        failed = bytearray((n >> 3) + 1)
        chosen, at, before = [], 0, ""
        size = reach(unit[:longest])
        while at < n:
            size = size or 1  # a character without a piece stands for itself
            while size:
                end = at + size
                piece = unit[at:end]
                if (size == 1 or piece in known) and not failed[end >> 3] >> (end & 7) & 1 and fits[before, piece]:
                    break
                size -= 1
            if size:
                chosen.append(piece)
                at, before = end, piece
                size = reach(unit[at : at + longest])
            else:
                while not size:  # back to a piece that can be shorter
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = chosen.pop()
                    at, size = at - len(piece), len(piece) - 1
                before = chosen[-1] if chosen else ""
        return chosen

    def _part_ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.backtrack(part):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a unit, which is first cut where a letter meets another character and no piece has the two side by side."""
        if unit[1:].isalpha():
            return list(self.part_ids[unit])
        out: list[int] = []
        start = 0
        for found in _CHANGE.finditer(unit):
            i = found.start()
            if unit[i - 1 : i + 1] not in self.bigrams:
                out += self.part_ids[unit[start:i]]
                start = i
        return [*out, *self.part_ids[unit[start:]]]

    def units(self, text: str) -> list[str]:
        """Cut a text, with its leading space, into units that no merge crosses; the empty text has none."""
        return self.unit.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.unit_ids(unit)]

    def surface(self, ids) -> str:
        """Decode without regard to the leading space. Bytes that are no UTF-8 give one U+FFFD each."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:  # there are bytes or special pieces
            pass
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            text, kind = self.pieces[i]
            if kind == BYTE:
                held.append(int(text[1:-1], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(text.replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.surface(ids)
        first = next((self.pieces[i] for i in ids if self.pieces[i][1] != CONTROL), ("", NORMAL))
        return text[1:] if first[0].startswith(SPACE) else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file on this machine, read once a process."""
    with open(path, "rb") as f:
        return PieceModel(f.read())
