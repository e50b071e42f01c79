"""Periodic runs against a look at every period of every text."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from dialtone.llm import periodic_runs, queries
from tests.llm import cases


def every_run(words):
    """(start, length, period): each period's maximal stretches, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(rng):
    kind, n = rng.integers(7), int(rng.integers(0, 200))
    if kind == 0:
        return rng.integers(0, 2, n).tolist()
    if kind == 1:
        return np.tile(rng.integers(0, 3, rng.integers(1, 12)), 40)[:n].tolist()
    if kind == 2:
        return np.concatenate([np.tile(rng.integers(0, 4, rng.integers(1, 20)), rng.integers(1, 9)) for _ in range(4)]).tolist()
    if kind == 3:
        return [0] * n
    if kind == 4:  # a period with flaws
        w = np.tile(rng.integers(0, 9, 7), 30)
        w[rng.integers(0, len(w), 3)] = 99
        return w.tolist()
    if kind == 5:  # runs inside runs
        inner = [1] * 30 + rng.integers(2, 5, 3).tolist()
        return (inner * 4)[: n + 20]
    x, y = [0], [0, 1]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


@pytest.mark.parametrize("seed", range(5))
def test_batches_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        docs = [[b"%d" % w for w in made(rng)] for _ in range(rng.integers(1, 7))]
        got = periodic_runs.batch_runs(docs)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [every_run(d) for d in docs]


def test_grammar_derives_the_text():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([np.tile(rng.integers(0, 5, 9), 40), rng.integers(5, 9, 300)])
    grammar = periodic_runs.Grammar(symbols, np.r_[np.zeros(360, int), np.ones(300, int)])
    for r, (first, left, whole) in enumerate(grammar.rules):
        places = grammar.places[grammar.place_ends[r] : grammar.place_ends[r + 1]]
        assert 0 < left < whole and first in places and len(places) > 1
        assert all(np.array_equal(symbols[p : p + whole], symbols[first : first + whole]) for p in places)
    assert len(grammar.heads) < 360 and grammar.heads[0] == 0 and 360 in grammar.heads


def test_few_candidates_at_a_time(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 5)
    rng = np.random.default_rng(9)
    docs = [[b"%d" % w for w in made(rng)] for _ in range(40)]
    assert [[tuple(r) for r in g.tolist()] for g in periodic_runs.batch_runs(docs)] == [every_run(d) for d in docs]


def test_a_misleading_hash_is_noticed(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [[b"%d" % w for w in np.r_[np.tile(rng.integers(0, 30, 20), 5), rng.integers(0, 30, 50)]]]
    of, calls = periodic_runs.Prefixes.of, []

    def poor(self, start, length):  # with the first multiplier only four bits remain
        return of(self, start, length) & np.uint64(15) if len(calls) == 1 else of(self, start, length)

    init = periodic_runs.Prefixes.__init__
    monkeypatch.setattr(periodic_runs.Prefixes, "of", poor)
    monkeypatch.setattr(periodic_runs.Prefixes, "__init__", lambda self, symbols, salt: (calls.append(salt), init(self, symbols, salt))[1])
    assert [[tuple(r) for r in g.tolist()] for g in periodic_runs.batch_runs(docs)] == [every_run(d) for d in docs]
    assert len(calls) > 1


def test_long_text_of_one_word():
    runs, = periodic_runs.batch_runs([[b"x"] * 200_000])
    assert runs.tolist() == [[0, 200_000, 1]]


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 100)
    rows = [*cases.ROWS, (80, "a b c " * 9 + "end", "a"), (80, "a b c " * 9 + "end", "a"), (81, "x" + " y" * 30 + " z" * 40, "b")]
    got = periodic_runs.periodic_runs(cases.documents(spark, rows).repartition(2), keep=("doc_id", "source")).collect()
    want = []
    for doc, text, source in rows:
        words = words_of(text)
        if len(words) > 5000:
            continue
        runs = every_run(words)
        left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        want.append((doc, source, len(words), runs, " ".join(left)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    found = [(r.doc_id, r.source, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.n_words <= 5000]
    assert sorted(found, key=key) == sorted(want, key=key) and len(got) == len(rows)
    long, = [r for r in got if r.doc_id == 42]
    assert [tuple(x) for x in long.runs] == [(0, 40_000, 2)] and long.collapsed == "the of cat sat down"
    assert periodic_runs.periodic_runs(cases.documents(spark, [])).collect() == []


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    looped = 0
    for doc, text in rows:
        words, h = words_of(text), zlib.crc32(str(doc).encode())
        if len(words) > 900:
            continue
        if h % 10 == 0 and words:
            n, g, looped = len(words), h // 10, looped + 1
            a = g % n
            words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
        runs = every_run(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        r = got[doc]
        assert (r.n_runs, r.runs_sha256) == (len(runs), cases.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))
        assert r.collapsed_sha256 == cases.sha(" ".join(left))
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (best and 1000 * best[1] // best[2])
    assert looped > 5
