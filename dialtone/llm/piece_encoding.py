"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the longest prefixes of the model's compiled character map. Every normalised character
records the byte of the original text at which its source begins, so each piece of the encoding is projected to
the bytes it came from. Pieces are merged by score inside units of white space and what follows it: no piece of
such a model holds white space after another character, which is checked when the model is read.

Defined results: a null text is an empty one; an empty text has no pieces. A piece's span runs from the first to
past the last original byte of its characters; the added leading space and all but the last of the byte pieces
of a character have empty spans. A lone surrogate, which no UTF-8 text holds, counts as U+FFFD. Very long texts are
encoded whole. Rows that repeat an id are each encoded. An empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialtone.llm.piece_model import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, UNUSED, PieceModel, read_model

KEPT_UNITS, KEPT_LENGTH = 600_000, 48  # units whose pieces a worker remembers, and their longest


class Encoder(dict):
    """Encodes and decodes with one model. As a mapping it holds the ids (as bytes) of units met before."""

    def __init__(self, model: PieceModel):
        self.model = model
        if model.model_type != 2:
            raise ValueError("the model is not a byte-pair one")
        if not all(t in (NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE) for t in model.types) or UNUSED in model.types:
            raise ValueError("user-defined and unused pieces are not handled")
        if not model.escape_spaces or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, t in zip(model.pieces, model.types) if t == NORMAL):
            raise ValueError("a piece holds white space after other characters")
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == NORMAL}
        self.scores = {p: model.scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE}
        self.unknown = model.types.index(UNKNOWN)
        self.decimals = list(map(str, range(len(model.pieces))))
        byte_of = np.full(len(model.pieces), -1)
        for b, i in self.bytes.items():
            byte_of[i] = b
        self.is_byte, self.is_tail = byte_of >= 0, (byte_of & 0xC0) == 0x80
        self.is_tail &= self.is_byte
        self.lengths = np.array([1 if t == UNKNOWN else len(p) for p, t in zip(model.pieces, model.types)], np.int64)
        hidden = {CONTROL: "", UNKNOWN: model.unknown_surface}
        self.surfaces = [hidden.get(t, p.replace(SPACE, " ")) for p, t in zip(model.pieces, model.types)]
        for b, i in self.bytes.items():
            self.surfaces[i] = chr(0xDC00 + b)  # a stand-in until its run of bytes is whole

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the original byte it starts at."""
        model = self.model
        if not model.character_map and not model.squeeze_spaces:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
            lead = [0, 0] if model.dummy_prefix and text else [0]
            return (SPACE if len(lead) == 2 else "") + text.replace(" ", SPACE), np.concatenate([lead, np.cumsum(sizes)]).astype(np.int64)
        return self._mapped(text.encode("utf-8"))

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        model, at = self.model, 0
        steps: list[tuple[str, int]] = []  # replacement and the byte at which its source begins
        while at < len(data):
            found = model.character_map.longest(data, at) if model.character_map else None
            size, new = found or (_character(data, at), None)
            steps.append(((data[at : at + size] if new is None else new).decode("utf-8", "replace"), at))
            at += size
        begin = 0
        if model.squeeze_spaces:
            while begin < len(steps) and steps[begin][0] == " ":
                begin += 1
        out: list[str] = []
        places: list[int] = []
        if begin < len(steps) and model.dummy_prefix:
            out.append(SPACE)
            places.append(steps[begin][1])
        after_space = model.squeeze_spaces
        for new, place in steps[begin:]:
            if after_space:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", SPACE))
                places.extend([place] * len(new))
                after_space = model.squeeze_spaces and new.endswith(" ")
        whole, end = "".join(out), len(data)
        if model.squeeze_spaces:
            kept = len(whole.rstrip(SPACE))
            if kept < len(whole):
                whole, end = whole[:kept], places[kept]
        return whole, np.array(places[: len(whole)] + [end], np.int64)

    def __missing__(self, unit: str) -> bytes:
        """Ids of a unit: the best-scored pair of neighbours is merged, the leftmost of equals, until none is a piece."""
        if len(unit) > KEPT_LENGTH:
            return self._long_unit(unit)
        parts, score, low = list(unit), self.scores.get, -float("inf")
        pairs = [score(a + b, low) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != low:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], low)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], low)
        if len(self) >= KEPT_UNITS:
            self.clear()
        self[unit] = out = self._ids(parts)
        return out

    def _long_unit(self, unit: str) -> bytes:
        """The same with a heap and linked neighbours, for units of any length."""
        from heapq import heappop, heappush

        parts: list[str] = list(unit)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heappush(heap, (-score, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self._ids([p for p in parts if p])

    def _ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for part in parts:
            if (at := self.ids.get(part)) is not None:
                out.append(at)
            elif self.model.byte_fallback:
                out.extend(self.bytes[b] for b in part.encode("utf-8"))
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the original byte spans as rows of (begin, end)."""
        whole, places = self.normalised(text)
        ids = np.frombuffer(b"".join(map(self.__getitem__, UNITS.findall(whole))), np.intc)
        return ids, self.spans(ids, places)

    def spans(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        is_byte = self.is_byte[ids]
        if is_byte.any():  # the last byte of a character stands for it
            lengths[is_byte] = ~np.r_[self.is_tail[ids[1:]], False][is_byte]
        ends = np.cumsum(lengths)
        return np.stack([places[ends - lengths], places[ends]], axis=1)

    def decode(self, ids: Sequence[int]) -> str:
        text = "".join(map(self.surfaces.__getitem__, ids))
        if STAND_IN.search(text):
            text = STAND_IN.sub(_whole_bytes, text)
        if len(ids) and self.model.dummy_prefix and self.model.pieces[ids[0]].startswith(SPACE):
            text = text[1:]
        return text


UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
STAND_IN = re.compile("[\udc00-\udcff]+")


def _whole_bytes(run: re.Match) -> str:
    """UTF-8 text of a run of byte pieces; each byte that belongs to no character is one U+FFFD."""
    data, out, at = bytes(ord(c) - 0xDC00 for c in run[0]), [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _character(data: bytes, at: int) -> int:
    first = data[at]
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@lru_cache(2)
def encoder(model_path: str) -> Encoder:
    """One encoder for each worker process and model."""
    return Encoder(read_model(model_path))


def _clean(text: str | None) -> str:
    return (text or "").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def encode_texts(rows: DataFrame, model_path: str, text: str = "text", name: str = "encoding") -> DataFrame:
    """`rows` with a struct of ids, begins and ends (bytes of the original text) and the decoded text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(model_path)
        for part in texts:
            out = []
            for t in part:
                ids, spans = coder.encode(_clean(t))
                out.append((ids, spans[:, 0], spans[:, 1], coder.decode(ids.tolist())))
            yield pd.DataFrame(out, columns=["ids", "begins", "ends", "decoded"])

    kind = "ids array<int>, begins array<long>, ends array<long>, decoded string"
    return rows.withColumn(name, F.pandas_udf(run, kind)(F.col(text)))


def encoding_digests(rows: DataFrame, model_path: str, text: str = "text", name: str = "digest") -> DataFrame:
    """`rows` with a struct of n_tokens and the SHA-256 of the ids, of the decoded text and of the spans.

    The digests are taken where the encoding is made, so ids and spans of whole texts don't travel.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(model_path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in texts:
            out = []
            for t in part:
                ids, spans = coder.encode(_clean(t))
                listed = ids.tolist()
                decimal = ",".join(map(coder.decimals.__getitem__, listed))
                out.append((len(listed), sha(decimal.encode()), sha(coder.decode(listed).encode()), sha(spans.astype("<i8").tobytes())))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return rows.withColumn(name, F.pandas_udf(run, kind)(F.col(text)))
