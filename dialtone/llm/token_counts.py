"""Word-piece token counts by a linear longest-match automaton.

A word, led by a word mark, is cut greedily: the longest piece of the vocabulary that begins it, then the longest
continuing piece, and so on. The pieces form a trie with one root for word beginnings and one for continuations.
Each node has a failure link, to where matching goes on when no edge fits, and the number of pieces that are
then complete. A word's count is the sum of these numbers along its way, in time linear in its length; no piece
is ever built. A word that can't be cut is one unknown token.

Defined results: a null text is an empty one with 0 tokens. Rows that repeat an id are each counted. Very
long texts are counted whole, in time proportional to them. An empty table gives no rows. Other columns are carried
along.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialtone.llm.piece_model import NORMAL, SPACE, read_model

KEPT_WORDS, KEPT_LENGTH = 600_000, 48  # words whose counts a worker remembers, and their longest
BLANK = re.compile(r"[\x20\x09-\x0D]+")
UNKNOWN = 1 << 40  # added to a word's count of 1 if it is unknown, so one sum holds both


class Automaton(dict):
    """As a mapping it holds the counts of words met before."""

    def __init__(self, beginning: Iterable[str], continuing: Iterable[str]):
        """`beginning` pieces stand at the start of a word with its mark, `continuing` ones anywhere after."""
        self.edges: list[dict[str, int]] = [{}, {}]
        accepted = [False, False]
        for root, pieces in ((0, beginning), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        accepted.append(False)
                    node = self.edges[node][c]
                accepted[node] = accepted[node] or bool(piece)
        self.failure: list[int] = [-1] * len(self.edges)
        self.popped: list[int] = [0] * len(self.edges)
        waiting = deque((0, 1))
        while waiting:
            parent = waiting.popleft()
            for c, node in self.edges[parent].items():
                waiting.append(node)
                if accepted[node]:
                    self.failure[node], self.popped[node] = 1, 1
                    continue
                at, count = self.failure[parent], self.popped[parent]
                while at >= 0 and c not in self.edges[at]:
                    count += self.popped[at]
                    at = self.failure[at]
                if at >= 0:
                    self.failure[node], self.popped[node] = self.edges[at][c], count

    def __missing__(self, word: str) -> int:
        count = self.count(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = count
        return count

    def count(self, word: str, mark: str = SPACE) -> int:
        edges, failure, popped = self.edges, self.failure, self.popped
        node = total = 0
        for c in mark + word:
            while (to := edges[node].get(c)) is None:
                total += popped[node]
                node = failure[node]
                if node < 0:
                    return 1 + UNKNOWN
            node = to
        while node != 1:
            total += popped[node]
            node = failure[node]
            if node < 0:
                return 1 + UNKNOWN
        return total


@lru_cache(2)
def automaton(model_path: str) -> Automaton:
    """The automaton of a SentencePiece vocabulary: pieces that begin with the word mark, and the others."""
    model = read_model(model_path)
    pieces = [p for p, t in zip(model.pieces, model.types) if t == NORMAL and SPACE not in p[1:]]
    return Automaton([p for p in pieces if p[0] == SPACE], [p for p in pieces if p[0] != SPACE])


def count_tokens(rows: DataFrame, model_path: str, text: str = "text", name: str = "counts") -> DataFrame:
    """`rows` with a struct of n_words, n_tokens and n_unknown of each whole text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = automaton(model_path)
        for part in texts:
            out = []
            for t in part:
                words = [w for w in BLANK.split(t or "") if w]
                total = sum(map(counter.__getitem__, words))
                out.append((len(words), total % UNKNOWN, total // UNKNOWN))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])

    return rows.withColumn(name, F.pandas_udf(run, "n_words long, n_tokens long, n_unknown long")(F.col(text)))
