"""Secret scans, source mixing, spot signatures: SQL and plain Python versions, awkward cases."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from checks.compare import connect, rows_of
from dialtone.llm import secret_scans, source_mixing, spot_signatures
from dialtone.llm.queries import queries
from dialtone.llm.sql import oracles

from tests.llm import cases


ORACLES = oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", ["op2_secret_scans", "op5_spot_signatures", "op6_source_mixing", "op11_exact_dedup"])
def test_plan_has_no_python(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_secrets_of_awkward_texts(spark):
    rows = secret_scans.digests(cases.documents(spark), secret_scans.new_ledger(spark)).collect()
    want = []
    for doc, text, _ in cases.ROWS:
        places = cases.secret_places(text)
        kinds = Counter(p[2] for p in places)
        want.append((doc, kinds["assign"], kinds["access"], kinds["hex"], cases.sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in places))))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == Counter(want)


def test_ledger_scans_only_unseen_blobs(spark):
    ledger = secret_scans.new_ledger(spark)
    first = spark.createDataFrame([("a", "token=aaaaaa"), ("b", "token=aaaaaa"), ("c", "none")], "path string, content string")
    assert secret_scans.findings_of_paths(first, ledger, "path", "content").count() == 2
    # The blob is known by now: a changed content under its address would not be looked at.
    addressed = secret_scans.addressed(first, "path", "content")
    before = ledger.findings("1").count(), ledger.seen("1").count()
    ledger.scan(addressed)
    assert (ledger.findings("1").count(), ledger.seen("1").count()) == before == (1, 2)
    more = spark.createDataFrame([("a", "token=bbbbbb"), ("d", "token=aaaaaa")], "path string, content string")
    got = {(r.path, r.start, r.end) for r in secret_scans.findings_of_paths(more, ledger, "path", "content").collect()}
    assert got == {("a", 0, 12), ("d", 0, 12)} and ledger.seen("1").count() == 3
    ledger.scan(addressed, version="2")  # another version of the rules looks at everything anew
    assert ledger.seen("2").count() == 2


def test_mix_meets_the_contract(spark):
    rows = source_mixing.mix_sources(cases.documents(spark)).collect()
    sizes = [(d, s, len(cases.words(t))) for d, t, s in cases.ROWS]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, n) for d, _, n in sizes)
    held = defaultdict(int)
    for _, source, n in sizes:
        held[source] += n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(held.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * held[s]}
        for s in over or free:
            target[s] = 2.0 * held[s] if over else level * weight[s]
            left -= target[s] if over else 0
        free = free - over if over else set()
    source_of = {d: s for d, _, s in cases.ROWS}
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[source_of[r.doc_id]]) and r.source_size == held[source_of[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.first_words == 0)
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and max(placed) <= sum(target.values()) + 1
    assert rows == source_mixing.mix_sources(cases.documents(spark)).collect()


def test_positions_invert_the_demand(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x, g) for x in (0.0, 10.0, 77.0, 100.0) for g in (-1.0, -0.5, 0.0, 0.25, 1.0)], "x double, g double")
    for r in df.select("x", "g", source_mixing.reached(F.col("x"), F.lit(100.0), F.col("g")).alias("t")).collect():
        assert 100 * ((1 - r.g) * r.t + r.g * r.t**2) == pytest.approx(r.x, abs=1e-9)


def _chains(text):
    import re

    found, tokens = set(), [t for t in re.sub(r"[\W_]+", " ", text.lower()).split()]
    content = [(i, t) for i, t in enumerate(tokens) if t not in spot_signatures.ANCHORS]
    for at, (i, _) in enumerate(content):
        if i and tokens[i - 1] in spot_signatures.ANCHORS and at + 2 < len(content):
            found.add((tokens[i - 1], *[t for _, t in content[at : at + 3]]))
    return found


def test_fingerprints(spark):
    rows = spot_signatures.fingerprints(cases.documents(spark)).collect()
    order = sorted(((d, t or "") for d, t, _ in cases.ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edits = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(text) // 4
        edits.append((doc, len(text), cases.sha(text[: len(text) - k] + after[:k])))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == Counter(edits)
    text_of = {d: t or "" for d, t, _ in cases.ROWS}
    for r in rows:
        own, edited = set(r.fingerprint.split(",")), set(r.edited_fingerprint.split(","))
        assert r.near_edited == pytest.approx(len(own & edited) / len(own | edited)) and 0 <= r.near_next <= 1
        assert len(own) == max(1, len(_chains(text_of[r.doc_id])))
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[6] == by[8] and by[2] == by[3] != by[4]
    # which signatures two texts share says which chains they share, and so how like they are
    chains = lambda t: _chains(t) or {t}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        a, b = chains(text), chains(after)
        mine = [r for r in rows if r.doc_id == doc]
        assert any(r.near_next == pytest.approx(len(a & b) / len(a | b)) for r in mine)


def test_signatures_keep_64_bits(spark):
    texts = spark.createDataFrame([(i, f"number{i}") for i in range(50)] + [(99, "the cat sat down here of blue seas roll")], "doc_id long, text string")
    rows = spot_signatures.with_signatures(texts, "text", "signatures").collect()
    found = [s for r in rows for s in r.signatures]
    assert len(set(found)) == len(found) and {s >> 32 for s in found} != {0}
    assert all(s >> 32 for r in rows if r.doc_id == 99 for s in r.signatures)


def test_successors_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "RANGE_ROWS", 3)
    docs = spark.createDataFrame([(i * i % 101, f"text {i * i % 101}") for i in range(40)], "doc_id long, text string").dropDuplicates(["doc_id"])
    ids = sorted(r.doc_id for r in docs.collect())
    got = {r.doc_id: r.next_text for r in spot_signatures._followed(docs).collect()}
    assert got == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_similar_pairs_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    signed = spot_signatures.with_signatures(docs.fillna("", "text"), "text", "signatures")
    pairs, member = spot_signatures.similar_pairs(signed)
    sets = {r.doc_id: frozenset(r.signatures) for r in signed.collect()}
    named = {}
    for i in sorted(sets):
        named.setdefault(sets[i], i)
    reps = sorted(named.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {r.id: r["class"] for r in member.collect()} == {i: named[s] for i, s in sets.items()}


def _components(sets, ids=None):
    """{id: smallest id} over links of similar sets, all pairs compared; sets are (id, set) rows."""
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if i < j and len(s & t) >= 0.8 * len(s | t) - 1e-12:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_similar_classes_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").fillna("", "text")
    signed = spot_signatures.with_signatures(docs, "text", "signatures")
    sets = [(r.doc_id, frozenset(r.signatures)) for r in signed.collect()]
    want = _components(sets)
    got = {r.id: (r["class"], r.class_size) for r in spot_signatures.similar_classes(signed).collect()}
    sizes = Counter(want.values())
    assert got == {i: (c, sizes[c]) for i, c in want.items()} and max(sizes.values()) > 1


@pytest.mark.parametrize("seed", range(4))
def test_similar_classes_of_made_sets(spark, seed):
    """Chains of near copies, sets that share a frequent core without being similar, repeated ids, rows without one."""
    import random

    rng, rows = random.Random(seed), []
    core = list(range(10))
    for i in range(60):
        kind = i % 4
        if kind == 0:  # a chain: each differs a little from the one before
            rows.append((i, list(range(1000 + i // 4, 1040 + i // 4))))
        elif kind == 1:  # a common core and a few of its own
            rows.append((i, core + [5000 + i * 10 + k for k in range(rng.randint(1, 3))]))
        elif kind == 2:
            rows.append((i, rng.sample(range(2000, 2012), rng.randint(1, 9))))
        else:
            rows.append((i, [7] if i % 8 == 3 else rng.sample(range(3000, 3006), 5)))
    rows += [(0, [99_999]), (61, [99_999]), (None, [99_999])]
    df = spark.createDataFrame([(i, sorted(set(s))) for i, s in rows], "doc_id long, signatures array<long>")
    parent = _components([(i, frozenset(s)) for i, s in rows if i is not None and (i, s) != (0, [99_999])])
    parent[61] = parent[0]  # by the second text of 0
    smallest = {}
    for i, c in parent.items():
        smallest[c] = min(smallest.get(c, i), i)
    sizes = Counter(parent.values())
    got = {r.id: (r["class"], r.class_size) for r in spot_signatures.similar_classes(df.repartition(3)).collect()}
    assert got == {i: (smallest[c], sizes[c]) for i, c in parent.items()}
    assert len(set(parent.values())) > 10 and max(sizes.values()) >= 15


def test_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """A group of which every set is similar to some others only, in many components after the first comparison."""
    import random

    rng, seen, components = random.Random(3), [], spot_signatures.components
    monkeypatch.setattr(spot_signatures, "components", lambda links: (seen.append(links.count()), components(links))[1])
    rows = [(i, sorted([*rng.sample(range(42), 38), 1000 + i // 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, signatures array<long>")
    want = _components([(i, frozenset(s)) for i, s in rows])
    got = {r.id: r["class"] for r in spot_signatures.similar_classes(df).collect()}
    assert got == want and max(Counter(want.values()).values()) == 400
    assert max(seen) < 10 * len(rows)


def test_keys_are_signatures_that_several_sets_have(spark):
    """Signatures that one set has alone come first and are counted, but give no rows."""
    rows = [(0, list(range(10)), 10), (1, list(range(1, 11)), 10), (2, [50, 51], 2), (3, [52, 53, 54], 3)]
    keys = spot_signatures._prefixes(spark.createDataFrame(rows, "node long, s array<long>, n int"), 0.8).collect()
    assert {(k["item"], k["node"], k["at"]) for k in keys} == {(1, 0, 2), (2, 0, 3), (1, 1, 2), (2, 1, 3)}


def test_query_has_classes(spark, sf_dir):
    rows = queries()["op5_spot_signatures"](spark, sf_dir).collect()
    sets = {r.doc_id: frozenset(r.fingerprint.split(",")) for r in rows}
    want = _components(list(sets.items()))
    assert {r.doc_id: r["class"] for r in rows} == want


@pytest.mark.parametrize("made", [
    lambda df, spark: spot_signatures.similar_classes(spot_signatures.with_signatures(df, "text", "signatures")),
    lambda df, spark: secret_scans.digests(df, secret_scans.new_ledger(spark)), lambda df, spark: source_mixing.mix_sources(df),
    lambda df, spark: spot_signatures.fingerprints(df)])
def test_empty_tables(spark, made):
    assert made(cases.documents(spark, []), spark).collect() == []


# Exact dedup


def _exact(rows):
    import re

    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0))
    out = Counter()
    for doc, text, _ in rows:
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[content])
        out[doc, None if best[1] else best[2], len(groups[content]), cases.sha(content), len(text or "")] += 1
    return out


_SPACED = [*cases.ROWS, (50, "a b", "a"), (51, "ab", "a"), (52, "a\tb\r\n", "a"), (53, "ab\x85", "b"), (60, "a b c", "a"), (61, "ab c", "b"),
           (-7, "ab c", None), (None, "ab c", "a"), (None, None, None), (None, None, None), (70, cases.LONG + " ", "b"), (2**63 - 1, "z", "a"), (-2**63, "z", "a")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force(spark, weak):
    from pyspark.sql import functions as F

    from dialtone.llm import exact_dedup

    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    df = cases.documents(spark, _SPACED).repartition(5).withColumns({"digest": F.lit(1), "content": F.lit("c"), "row": F.lit(7), "best": F.lit(0), "name": F.lit("n")})
    rows = exact_dedup.exact_groups(df, digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_chars) for r in rows) == _exact(_SPACED)
    kept = [r for r in rows if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(cases.documents(spark, []), digest).collect() == []


def test_exact_dedup_combines_before_every_shuffle(spark, sf_dir):
    from dialtone.llm import exact_dedup

    texts = exact_dedup._texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), exact_dedup.sha256)
    df = exact_dedup.combined(texts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4 and "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert "Python" not in plan


def test_a_large_group_is_not_shuffled(spark, monkeypatch):
    from dialtone.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "HOT", 10)
    rows = [(i, "same  text" if i % 3 else f"text {i // 6}", "a") for i in range(300)] + [(None, "", "a")] * 60
    got = exact_dedup.exact_groups(cases.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_chars) for r in got) == _exact(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
