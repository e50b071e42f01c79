"""The other operators against plain Python versions, with awkward cases."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from dialtone.llm import (
    components, jaccard_join, license_scans, piece_encoding, piece_model, pivot_search, quality_network, token_counts,
)
from tests.llm import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Licences


def test_licences(spark):
    rows = license_scans.scan_documents(cases.documents(spark)).collect()
    import re
    want = []
    for doc, text, _ in cases.ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, label) for i in range(len(w)) for phrase, label in license_scans.PHRASES if w[i : i + len(phrase.split())] == phrase.split()]
        want.append((doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), tuple(sorted({b for _, b in at}))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in rows) == Counter(want)
    assert {m.label for r in rows if r.doc_id == 1 for m in r.matches} >= {"cc-by-nc", "cc-by"}
    assert license_scans.scan_documents(cases.documents(spark, [])).collect() == []


def test_licence_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    known = sorted(license_scans.template_words())
    index = license_scans.index_of({w: int(rng.integers(100)) for w in known})
    for _ in range(2000):
        at = int(rng.integers(len(index.words)))
        block = set(rng.permutation(index.words[at])[: int(rng.integers(1, len(index.words[at]) + 1))].tolist()) | set(rng.integers(0, len(known), 4).tolist())
        want = {(t, len(block & set(own)) / len(own)) for t, own in enumerate(index.words) if len(block & set(own)) >= license_scans.THRESHOLD * len(own) - 1e-9}
        assert set(license_scans.matches(block, index)) == want


# Search


@pytest.mark.parametrize("rows, width", [(300, 8), (7, 3), (3, 2)])
def test_search_equals_brute_force(spark, rows, width, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(rows)
    data = [(i, np.round(rng.normal(size=width), 1).astype(np.float32).tolist(), "x", 1.0) for i in range(rows)]  # many ties
    odd = [(1000, None, "x", 1.0), (1001, [1.0, None], "x", 1.0), (1002, [float("nan")] * width, "x", 1.0), (1003, [float("inf")] * width, "x", 1.0), (None, [1.0] * width, "x", 1.0), (0, data[0][1], "x", 1.0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, at string, score double")
    got = [tuple(r) for r in pivot_search.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()]
    ints = {i: [math.floor(256 * x) for x in v] for i, v, *_ in data}
    want = []
    for q in range(0, rows, 10):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, at + 1, i, -score) for at, (score, i) in enumerate(best)]
    assert got == want


def test_search_of_nothing(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.nearest(empty, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0]), (7, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_search.nearest(one, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 7, 0)]


# Token counts


def _greedy(word, beginning, continuing):
    rest, count, pieces = piece_model.SPACE + word, 0, beginning
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return 1 + token_counts.UNKNOWN
        rest, count, pieces = rest[size:], count + 1, continuing
    return count


def test_automaton_equals_greedy_matching():
    rng = np.random.default_rng(5)
    for _ in range(60):
        piece = lambda: "".join(rng.choice(list("abc"), int(rng.integers(1, 6))))
        beginning = {piece_model.SPACE + piece() for _ in range(8)} | ({piece_model.SPACE} if rng.random() < 0.5 else set())
        continuing = {piece() for _ in range(10)}
        machine = token_counts.Automaton(beginning, continuing)
        for _ in range(60):
            word = "".join(rng.choice(list("abcd"), int(rng.integers(1, 15)), p=[0.35, 0.3, 0.3, 0.05]))
            assert machine.count(word) == _greedy(word, beginning, continuing)


def test_token_counts(spark):
    rows = token_counts.count_tokens(cases.documents(spark), MODEL).select("doc_id", "counts.*").collect()
    model = piece_model.read_model(MODEL)
    pieces = [p for p, t in zip(model.pieces, model.types) if t == 1 and "▁" not in p[1:]]
    beginning, continuing = {p for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
    import re
    want = []
    for doc, text, _ in cases.ROWS:
        counts = [_greedy(w, beginning, continuing) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        want.append((doc, len(counts), sum(c % token_counts.UNKNOWN for c in counts), sum(c // token_counts.UNKNOWN for c in counts)))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert token_counts.count_tokens(cases.documents(spark, []), MODEL).collect() == []


# Pieces


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(spark):
    library = _library()
    rows = piece_encoding.encoding_digests(cases.documents(spark), MODEL).select("doc_id", "digest.*").collect()
    want = []
    for doc, text, _ in cases.ROWS:
        ids = library.encode(text or "")
        want.append((doc, len(ids), cases.sha(",".join(map(str, ids))), cases.sha(library.decode(ids))))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == Counter(want)
    full = {r.doc_id: r.encoding for r in piece_encoding.encode_texts(cases.documents(spark), MODEL).collect()}
    assert full[9].decoded == library.decode(list(full[9].ids)) and full[9].begins[0] == 0 and full[9].ends[-1] == len(cases.ROWS[8][1].encode())


def test_encoding_of_random_texts_and_spans():
    library, own = _library(), piece_encoding.encoder(MODEL)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab  ▁é🤖\n<0x4>日\x00"), int(rng.integers(0, 120)))) for _ in range(1500)] + ["a" * 3000, " " * 90, "é" * 200]
    for text in texts:
        ids, spans = own.encode(text)
        assert ids.tolist() == library.encode(text) and own.decode(ids.tolist()) == library.decode(ids.tolist())
        begins, ends = spans[:, 0], spans[:, 1]
        assert (begins[1:] == ends[:-1]).all() and (not len(spans) or (begins[0] == 0 and ends[-1] == len(text.encode())))
    odd = [int(i) for i in rng.integers(3, 259, 200)]  # byte pieces that form no characters
    for k in range(1, 200, 7):
        assert own.decode(odd[:k]) == library.decode(odd[:k])


def test_character_map_and_white_space_rules():
    import sentencepiece

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        blob = library.serialized_model_proto()
    except Exception:
        pytest.skip("this build of the library makes no character maps")
    spec = dict(piece_model.fields(dict(piece_model.fields(blob))[3]))
    own = piece_encoding.Encoder(piece_model.read_model(MODEL))
    own.model = piece_model.PieceModel(own.model.pieces, own.model.scores, own.model.types, 2, True, True, True, True, character_map=piece_model.CharacterMap(spec[2]))
    for text in ("ｆｕｌｌ　ｗｉｄｔｈ ①②", "  a   b\tc  ", "ﬁne é", "株式会社 ㍿", "", "   "):
        whole, places = own.normalised(text)
        assert whole == library.normalize(text) and len(places) == len(whole) + 1
        assert all(a <= b for a, b in zip(places, places[1:])) and places[-1] <= len(text.encode())


# Near copies


@pytest.mark.parametrize("size", [1, 2, 4, 5, 6, 9, 30, 144, 700])
def test_linked_sets_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        most = jaccard_join.most_different(len(a), len(a))
        gone = int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most - gone + 1))).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert np.intersect1d(jaccard_join.all_keys(a), jaccard_join.all_keys(b)).size
            assert jaccard_join.least_difference(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b)) <= len(a) + len(b) - 2 * common


def test_short_sets_meet_by_deletions(monkeypatch):
    monkeypatch.setattr(jaccard_join, "scheme", lambda band: (30, 30))  # without slack nearly every set is short
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[int(rng.integers(0, 15)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 15))).astype(np.uint64)])
        if len(a) + len(b) - 2 * len(np.intersect1d(a, b)) < 30:
            assert np.intersect1d(jaccard_join.keys_under(a, 20), jaccard_join.keys_under(b, 20)).size


def test_near_copies_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_classes(docs).collect()}
    named = cases.classes(rows)
    assert got == {i: (len(cases.shingles(t)), named[i]) for i, t in rows}


def test_near_copies_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    cloud = []
    for i in range(60):  # copies of one text that link with some of each other only
        w = [f"w{k}" for k in range(80)]
        for k in rng.integers(0, 80, int(rng.integers(0, 3))):
            w[k] = f"x{rng.integers(3)}"
        cloud.append((100 + i, " ".join(w), "a"))
    rows = cases.ROWS + cloud
    got = jaccard_join.near_duplicate_classes(cases.documents(spark, rows)).collect()
    named = cases.classes([(d, t) for d, t, _ in rows])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(cases.shingles(t)), named.get(d)) for d, t, _ in rows)
    assert jaccard_join.near_duplicate_classes(cases.documents(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# Quality


def test_quality_learns_held_out_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_network.fit(docs, labels, quality_network.TrainingBounds(rows=60, epochs=20))
    rows = quality_network.score(docs, net).join(labels.select("doc_id", "quality"), "doc_id").select("quality", "score", quality_network.held_out(F.col("doc_id")).alias("out")).collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad) and any(r.out for r in rows)


def test_quality_of_awkward_rows(spark):
    docs = cases.documents(spark).withColumnRenamed("score", "other")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    net = quality_network.fit(docs, labels, quality_network.TrainingBounds(rows=5, epochs=1))
    rows = quality_network.score(docs, net).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in rows)
    one = quality_network.fit(docs, labels.where("doc_id = 5"))
    assert all(0 <= r.score <= 1 for r in quality_network.score(docs, one).collect())
    none = quality_network.fit(cases.documents(spark, []), labels.where("false"))
    assert {r.score for r in quality_network.score(docs, none).collect()} == {0.5}


def every_window(net, data):
    """The text as chunks see it, filled up with zero bytes to whole chunks, and all of its windows."""
    step = quality_network.CHUNK - net.taps
    padded = np.zeros(max(1, -(-max(0, len(data) - net.taps) // step)) * step + net.taps, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    plane = np.zeros(len(padded))
    plane[: len(data)] = quality_network.repeats(padded[: len(data)])
    inputs = np.concatenate([net.embedding[padded], plane[:, None]], axis=1).astype(np.float64)
    return padded, plane, np.stack([np.tensordot(inputs[i : i + net.taps], net.filters, ([0, 1], [0, 1])) for i in range(len(padded) - net.taps + 1)])


def random_network(seed):
    rng = np.random.default_rng(seed)
    return quality_network.Network(rng.normal(size=(256, 3)).astype("f4"), rng.normal(size=(6, 4, 5)).astype("f4"),
                                   rng.normal(size=5).astype("f4"), rng.normal(size=5).astype("f4"), 0.25)


@pytest.mark.parametrize("size", [1, 5, 6, 1018, 1024, 1025, 5000])
def test_pooled_responses_equal_brute_force(size):
    rng = np.random.default_rng(size)
    net, data = random_network(size), bytes(rng.integers(97, 100, size, dtype=np.uint8))
    _, _, whole = every_window(net, data)
    want = np.maximum(whole.max(axis=0) + net.offsets, 0)
    assert quality_network.pooled(net, data) == pytest.approx(want, abs=1e-4)
    z = want @ net.weights + net.bias
    assert quality_network.probability(net, data) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert not quality_network.pooled(net, b"").any()


def test_a_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    net, data, label = random_network(11), bytes(rng.integers(97, 104, 2500, dtype=np.uint8)), 0
    names = ("embedding", "filters", "offsets", "weights")
    grads = {n: np.zeros_like(getattr(net, n)) for n in names} | {"bias": np.zeros(1, np.float32)}
    quality_network._gradient(net, quality_network.prepared_of([data], net.taps), label, grads)

    def loss(net):
        _, _, whole = every_window(net, data)
        z = np.maximum(whole.max(axis=0) + net.offsets, 0) @ net.weights.astype(np.float64) + net.bias
        return math.log1p(math.exp(z)) - label * z

    for name in names:
        value = getattr(net, name)
        flat = np.argsort(-np.abs(grads[name]).ravel())[:6]
        for at in [*flat.tolist(), *rng.integers(0, value.size, 4).tolist()]:
            ends = []
            for shift in (1e-3, -1e-3):
                moved = value.astype(np.float64).ravel().copy()
                moved[at] += shift
                ends.append(loss(quality_network.Network(**{**vars(net), name: moved.reshape(value.shape)})))
            assert grads[name].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=2e-2, abs=2e-3), (name, at)


def test_long_texts_are_learned_from(spark):
    from pyspark.sql import functions as F

    good, bad = "the sun shone on the hill and the cat ran home again ", "buy buy now now zzz qqq 777 "
    rows = [(i, (good if i % 2 else bad) * (800 + i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    bounds = quality_network.TrainingBounds(rows=20, epochs=20)
    net = quality_network.fit(docs, labels, bounds)
    scores = {r.doc_id: r.score for r in quality_network.score(docs, net).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2) + 0.3
    # the pieces come from all over the text; a short text is one whole piece
    text = "".join(f"{i:07d} " for i in range(5000))
    piece = quality_network.pieces_of(F.encode(F.lit(text), "utf-8"), 16, 7, F.lit(5))
    pieces = [bytes(p).decode() for p in spark.range(1).select(piece.alias("p")).first()["p"]]
    places = [text.index(p) for p in pieces]
    assert len(pieces) == 16 and all(len(p) == 1024 for p in pieces) and all(i <= at * 16 / (40_000 - 1024) <= i + 1 for i, at in enumerate(places))
    short = spark.range(1).select(quality_network.pieces_of(F.encode(F.lit("é" * 8000), "utf-8"), 16, 7, F.lit(5)).alias("p")).first()["p"]
    assert [bytes(p).decode() for p in short] == ["é" * 8000]
