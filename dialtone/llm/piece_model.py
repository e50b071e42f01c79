"""Reading a SentencePiece model file: pieces, flags and the compiled character map."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: the file's piece types
SPACE = "▁"


def fields(data: bytes):
    """(number, value) of a protocol buffer message, in file order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        head = varint()
        kind = head & 7
        if kind == 0:
            yield head >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield head >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values point at replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:] and its replacement."""
        units, found = self.units, None
        node = 0
        node ^= _offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.replacements[start : self.replacements.index(0, start)]
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = 1  # the format's default, unigram
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    unknown_surface: str = " ⁇ "
    character_map: CharacterMap = field(default_factory=lambda: CharacterMap(b""))


def read_model(path: str) -> PieceModel:
    model = PieceModel()
    with open(path, "rb") as file:
        message = file.read()
    for number, value in fields(message):
        if number == 1:
            piece = dict(fields(value))
            model.pieces.append(piece.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.types.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
            model.model_type = trainer.get(3, 1)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unknown_surface = trainer[44].decode() if 44 in trainer else model.unknown_surface
        elif number == 3:
            normalizer = dict(fields(value))
            model.character_map = CharacterMap(normalizer.get(2, b""))
            model.dummy_prefix = bool(normalizer.get(3, 1))
            model.squeeze_spaces = bool(normalizer.get(4, 1))
            model.escape_spaces = bool(normalizer.get(5, 1))
    return model
