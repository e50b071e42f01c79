"""Runs of periodic words by grammar compression.

A run is a stretch of words whose smallest period q fits into it at least three times, of at least `LEAST` words,
that no neighbouring word extends. A document is any column of texts; its words are numbered per document.

    1. Re-Pair: pairs of symbols that occur again become nonterminals, in rounds. A round replaces the pairs that are
       more frequent than the pairs that overlap them, so pairs that compete are taken most frequent first. A pair
       that occurs once stays as it is for good, and its symbols drop out of the work.
    2. What is left of a document is put together by a balanced tree, whose nodes are nonterminals that occur once.
    3. For the boundary between the two parts of each nonterminal, the runs that cross it are computed once, in the
       first place where it is derived. A run of a period q has the same eight words q words apart, next to the
       boundary, on one side of it or the other; such places give the periods to look at, and hashes of prefixes
       the furthest extent inside the nonterminal.
    4. The runs are moved to every place where the nonterminal is derived: the places where it was put in. Those that
       end at its edge may go on outside; the nonterminal around it has them whole. Stretches of equal period that
       share as many words as the period are merged.

A run lies whole in the smallest nonterminal around it, so every run is found; hashes only propose, each stretch
is compared word by word, and a false one sets off another multiplier.

Documents are worked on in batches of about `BATCH_WORDS` words, or one longer document, by numpy; nothing is
shuffled. Memory is a few hundred bytes a word of a batch.

Defined results: a null or blank text has no words and no runs. Words are compared as they stand, capital letters
apart. Rows that repeat an id are documents of their own. An empty table gives no rows. A text of any length is one
document. Columns that are not named to be kept are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, TIMES, GRAM = 24, 3, 8
BATCH_WORDS = 300_000
CANDIDATES = 1 << 20  # periods looked at together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Grammar:
    """Rules as (first place, words of the left part, words in all), the places where each is derived, and the
    places where the symbols that are left begin."""

    def __init__(self, symbols: np.ndarray, documents: np.ndarray) -> None:
        n = len(symbols)
        symbol, start = symbols.astype(np.int64), np.arange(n)
        words = np.ones(n, np.int64)
        heads = np.ones(n, bool)
        # whether a symbol and the next one may be a pair that occurs again
        alive = np.r_[documents[1:] == documents[:-1], False] if n else np.empty(0, bool)
        free, draw = int(symbol.max(initial=-1)) + 1, np.random.default_rng(0)
        rules, places, used = [], [], 0
        while True:
            needed = alive.copy()
            needed[1:] |= alive[:-1]
            if not needed.any():
                break
            if not needed.all():
                symbol, start, words, alive = symbol[needed], start[needed], words[needed], alive[needed]
            at = np.arange(len(symbol))
            equal = np.r_[alive[:-1] & (symbol[1:] == symbol[:-1]), False]
            # of equal symbols in a row, pairs begin at even places
            first = np.maximum.accumulate(np.where(np.r_[True, ~equal[:-1]], at, 0))
            i = np.flatnonzero(alive & ~(equal & ((at - first) & 1 == 1)))
            if not len(i):
                break
            codes, pairs = pd.factorize(symbol[i] << 32 | symbol[i + 1])
            often = np.bincount(codes)[codes]
            alive[i[often == 1]] = False
            again = often > 1
            i, codes, often = i[again], codes[again], often[again]
            if not len(i):
                continue
            # a rank of its own for each pair, the more frequent one higher
            rank = np.zeros(len(symbol) + 1, np.int64)
            rank[i] = (often << 32) + draw.permutation(len(pairs))[codes] + 1
            best = (rank[i] > rank[i - 1]) & (rank[i] > rank[i + 1])
            i, codes = i[best], codes[best]
            twice = np.bincount(codes, minlength=len(pairs))[codes] > 1
            i, codes = i[twice], codes[twice]
            _, lead, rule = np.unique(codes, return_index=True, return_inverse=True)
            j = i[lead]
            rules.append(np.column_stack([start[j], words[j], words[j] + words[j + 1]]))
            places.append(np.column_stack([used + rule, start[i]]))
            heads[start[i + 1]] = False
            symbol[i], words[i], alive[i] = free + rule, words[i] + words[i + 1], alive[i + 1]
            free, used = free + len(lead), used + len(lead)
            kept = np.ones(len(symbol), bool)
            kept[i + 1] = False
            symbol, start, words, alive = symbol[kept], start[kept], words[kept], alive[kept]
        self.rules = np.concatenate(rules) if rules else np.empty((0, 3), np.int64)
        found = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        found = found[np.argsort(found[:, 0], kind="stable")]
        self.places = found[:, 1]
        self.place_ends = np.r_[0, np.cumsum(np.bincount(found[:, 0], minlength=used))].astype(np.int64)
        self.heads = np.flatnonzero(heads)


def nonterminals(grammar: Grammar, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, boundary, end) and rule (-1 for the tree's) of all nonterminals long enough for a run."""
    first, left, whole = grammar.rules.T
    ruled = np.column_stack([first, first + left, first + whole])
    # Of a document's symbols the j-th begins the right part of a node; the node spans as many symbols on either
    # side as the largest power of two in j.
    owner = np.searchsorted(starts, grammar.heads, side="right") - 1
    begins = np.searchsorted(grammar.heads, starts[:-1])
    j = np.arange(len(grammar.heads)) - begins[owner]
    inner = np.flatnonzero(j > 0)
    span = j[inner] & -j[inner]
    ends = np.searchsorted(grammar.heads, starts[1:])
    last = np.minimum(inner + span, ends[owner[inner]])
    heads = np.r_[grammar.heads, starts[-1]]
    treed = np.column_stack([heads[inner - span], heads[inner], heads[last]])
    nodes = np.concatenate([ruled, treed])
    rule = np.r_[np.arange(len(ruled)), np.full(len(treed), -1)]
    long = nodes[:, 2] - nodes[:, 0] >= LEAST
    return nodes[long], rule[long]


def expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [begin, end), with the number of the range that each is of."""
    sizes = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return of, np.arange(len(of)) - before[of] + begin[of]


class Prefixes:
    """Hashes of stretches of words: equal stretches have equal ones."""

    def __init__(self, symbols: np.ndarray, salt: int) -> None:
        with np.errstate(over="ignore"):
            base = int(mixed(np.array([salt]), 77)[0]) | 1
            inverse = pow(base, -1, 1 << 64)
            powers = np.r_[np.uint64(1), np.cumprod(np.full(len(symbols), base, np.uint64))]
            self._back = np.r_[np.uint64(1), np.cumprod(np.full(len(symbols), inverse, np.uint64))]
            self._sums = np.r_[np.uint64(0), np.cumsum(mixed(symbols, salt) * powers[:-1])]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sums[start + length] - self._sums[start]) * self._back[start]

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """Number of equal words from x and y on (step 1) or before them (step -1), up to `limit`."""
        found = np.zeros(len(x), np.int64)
        size = 1 << int(limit.max(initial=0)).bit_length() >> 1
        while size:
            fits = np.flatnonzero(found + size <= limit)
            a, b = (x[fits] + found[fits], y[fits] + found[fits]) if step > 0 else (x[fits] - found[fits] - size, y[fits] - found[fits] - size)
            same = self.of(a, size) == self.of(b, size)
            found[fits[same]] += size
            size >>= 1
        return found


def crossing_runs(nodes: np.ndarray, symbols: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray | None:
    """(node, start, end, period) of the runs inside each node that cross its boundary; None if a hash misled."""
    prefixes, n = Prefixes(symbols, salt), len(symbols)
    # Places of eight words that the document has twice, by what they are and in order.
    whole = np.arange(max(n - GRAM + 1, 0))
    whole = whole[np.searchsorted(starts, whole, side="right") == np.searchsorted(starts, whole + GRAM - 1, side="right")]
    codes, _ = pd.factorize(prefixes.of(whole, GRAM))
    again = np.bincount(codes)[codes] > 1 if len(codes) else np.empty(0, bool)
    gram = np.full(n + 1, -1)
    gram[whole[again]] = codes[again]
    listed = np.sort(codes[again] * (n + 1) + whole[again])

    found = []
    for shift in (0, GRAM):  # the eight words after the boundary, and those before it
        begin, boundary, end = nodes.T
        anchor = boundary - shift
        usable = np.flatnonzero((anchor >= begin) & (anchor + GRAM <= end))
        usable = usable[gram[anchor[usable]] >= 0]
        anchor, farthest = anchor[usable], (end - begin)[usable] // TIMES
        row = gram[anchor] * (n + 1)
        low = np.searchsorted(listed, row + np.maximum(begin[usable], anchor - farthest))
        high = np.searchsorted(listed, row + np.minimum(end[usable] - GRAM, anchor + farthest), side="right")
        cuts = np.searchsorted(np.cumsum(high - low), np.arange(CANDIDATES, int((high - low).sum()) + CANDIDATES, CANDIDATES), side="left") + 1
        for part in np.split(np.arange(len(usable)), np.unique(np.minimum(cuts, len(usable)))):
            of, at = expanded(low[part], high[part])
            of, place = part[of], listed[at] % (n + 1) if len(at) else at
            other = place != anchor[of]
            of, place = of[other], place[other]
            node, period = usable[of], np.abs(place - anchor[of])
            b, e = boundary[node], end[node]
            x = np.where(place > anchor[of], b, b - period)
            before = prefixes.common(x, x + period, x - begin[node], -1)
            after = prefixes.common(x, x + period, e - x - period, 1)
            s, t = x - before, x + period + after
            good = (t - s >= np.maximum(LEAST, TIMES * period)) & (s < b) & (t > b)
            found.append(np.column_stack([node, s, t, period])[good])
    runs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    # The smallest period of each stretch.
    runs = runs[np.lexsort(runs.T[::-1])]
    fresh = np.r_[True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1)] if len(runs) else np.empty(0, bool)
    runs = runs[fresh]
    for _, s, t, period in runs:
        if not np.array_equal(symbols[s : t - period], symbols[s + period : t]):
            return None
    return runs


def merged(runs: np.ndarray, n: int) -> np.ndarray:
    """Maximal (start, end, period): stretches of a period that share as many words as it are one."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    start, end, period = runs.T
    lane = period * (2 * n + 2)  # keeps the periods apart
    reach = np.maximum.accumulate(end + lane)
    opens = np.flatnonzero(np.r_[True, start[1:] + lane[1:] > reach[:-1] - period[1:]])
    ends = reach[np.r_[opens[1:], len(runs)] - 1] - lane[opens]
    runs = np.column_stack([start[opens], ends, period[opens]])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs of documents that stand one after another: document d has the symbols from
    starts[d] to starts[d + 1], no two documents share a symbol. Sorted by start, then period."""
    documents = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    grammar = Grammar(symbols, documents)
    nodes, rule = nonterminals(grammar, starts)
    for salt in count(1):
        found = crossing_runs(nodes, symbols, starts, salt)
        if found is not None:
            break
    of_rule = rule[found[:, 0]]
    once, often = found[of_rule < 0, 1:], found[of_rule >= 0, 1:]
    rules = of_rule[of_rule >= 0]
    of, at = expanded(grammar.place_ends[rules], grammar.place_ends[rules + 1])
    moved = grammar.places[at] - grammar.rules[rules[of], 0]
    derived = often[of] + np.column_stack([moved, moved, np.zeros_like(moved)])
    return merged(np.concatenate([once, derived]), len(symbols))


def batch_runs(words: Sequence[Sequence[bytes]]) -> list[np.ndarray]:
    """The runs of each document of a batch, as (start, length, period) counted from its first word."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.empty(int(starts[-1]), object)
    flat[:] = [w for of in words for w in of]
    names, _ = pd.factorize(flat)
    owner = np.repeat(np.arange(len(words)), sizes)
    symbols, _ = pd.factorize(owner << 32 | names)  # no symbol is of two documents
    runs = runs_of(symbols, starts)
    of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    own = np.column_stack([runs[:, 0] - starts[of], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return np.split(own, np.searchsorted(of, np.arange(1, len(words))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(
    documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    order: Callable[..., np.ndarray | None] | None = None,
) -> DataFrame:
    """The kept columns, n_words, runs (start, length, period; by start, then period) and collapsed (the text's words,
    one space between them, without what follows the first period of a run).

    `order`, given the number of words and the kept columns' values, may return the words to read by their numbers in
    place of the text's own order.
    """
    keep = list(keep)

    def described(rows: pa.RecordBatch, read: list[list[bytes]]) -> pa.RecordBatch:
        runs = batch_runs(read)
        texts = []
        for words, own in zip(read, runs):
            if len(own):
                words = np.array(words, object)[kept_words(len(words), own)].tolist()
            texts.append(b" ".join(words).decode("utf-8"))
        offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        flat = np.concatenate(runs)
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUN)))
        made = [pa.array([len(w) for w in read], pa.int64()), listed, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=[*keep, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, read = 0, 0, []
            kept = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) if order and keep else [()] * batch.num_rows
            for at, content in enumerate(batch.column(batch.num_columns - 1)):
                words = (content.as_py() or "").encode("utf-8").split()
                chosen = order(len(words), *kept[at]) if order else None
                if chosen is not None:
                    words = [words[i] for i in chosen.tolist()]
                if read and held + len(words) > BATCH_WORDS:
                    yield described(batch.slice(begin, at - begin), read)
                    begin, held, read = at, 0, []
                read.append(words)
                held += len(words)
            if read:
                yield described(batch.slice(begin), read)

    fields = documents.select(*keep).schema
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    return documents.select(*keep, text).mapInArrow(run, kinds)
