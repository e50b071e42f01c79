"""Each stage of the pipeline against plain Python, on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialtone.llm import quality_network, source_mixing
from tests.llm import cases


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """{stage: (rows before, rows after)} of one run."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def test_stages_return_documents(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [s[2] == columns for s in stages.values()] == [True] * 4 + [False]


def test_quality_keeps_what_the_network_accepts(spark, sf_dir, stages):
    before, after, _ = stages["quality"]
    net = quality_network.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in before if quality_network.probability(net, (r.text or "").encode()) >= corpus_pipeline.ACCEPTED}
    assert {r.doc_id for r in after} == want
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(good - want) <= 0.03 * len(good)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_copies"]
    named = cases.classes([(r.doc_id, r.text) for r in before])
    assert Counter(r.doc_id for r in after) == Counter(set(named.values()))


def test_secrets_are_replaced(stages):
    before, after, _ = stages["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert len(texts) == len(before)
    for r in before:
        places, out, at = cases.secret_places(r.text), [], 0
        merged = []
        for start, _, kind, end in places:
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        for start, end, kind in merged:
            out += [r.text[at:start], f"[{kind}]"]
            at = end
        assert texts[r.doc_id] == "".join(out) + r.text[at:]


def test_mix_takes_its_words(spark, stages):
    before, after, _ = stages["mixing"]
    docs = spark.createDataFrame(before)
    taken = {r.doc_id: r.taken for r in source_mixing.mix_sources(docs).collect()}
    got = Counter()
    for r in after:
        got[r.doc_id] += len(cases.words(r.text))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}
    whole = {r.doc_id: r.text for r in before}
    assert all(whole[r.doc_id].startswith(r.text) for r in after)


# Names that the stages and their operators use for columns of their own.
USED = (
    "key hash first n more rest copy row position words size source_size take cut cuts blob stretch opens kind start end doc component_id quality _quality "
    "_words _key _text _blob _row _own _of _position _cuts _take _kept _id n_shingles spans digest file at begin part kind_at path content order bucket target"
).split()


def test_stages_on_awkward_rows(spark, sf_dir):
    for rows in (cases.ROWS, []):
        docs = cases.documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert len(out.collect()) >= (len(rows) // 2 if rows and name not in ("quality", "mixing") else 0)


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    plain = cases.documents(spark, extra=False).withColumn("n_chars", F.length("text").cast("long"))
    clashing = plain.withColumns({name: F.lit(f"own {name}") for name in USED})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf_dir)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in USED)
        want = stage(spark, plain, sf_dir).collect()
        assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in rows) == Counter(map(tuple, [(r.doc_id, r.text, r.source, r.n_chars) for r in want]))


def test_repeated_rows_leave_the_same_one(spark, sf_dir):
    rows = [(1, cases.BASE, s) for s in "abcdef"] + [(2, cases.NEAR, "z")]
    kept = [corpus_pipeline.near_copies(spark, cases.documents(spark, order, extra=False).repartition(n), sf_dir).collect()
            for order, n in ((rows, 1), (rows[::-1], 5))]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_training_order_reaches_the_last_table(spark, stages, tmp_path):
    before, after, columns = stages["encoding"]
    assert columns[:3] == ["doc_id", "source", "position"] and sorted(r.position for r in after) == list(range(len(after)))
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS doc_id", "'s' AS source", "string(id) AS text").repartition(9)
    rows.orderBy("doc_id").write.parquet(str(tmp_path / "sorted"))
    back = corpus_pipeline.in_file_order(spark.read.parquet(str(tmp_path / "sorted")))
    assert all(r.position == r.doc_id for r in back.collect())
    made = corpus_pipeline.in_file_order(rows.select("doc_id", "source", "text"))
    assert len({r.position for r in made.collect()}) == 1000
    # in the run itself: positions rise as the mix put the passes
    mixed = [r.doc_id for r in before]
    assert [r.doc_id for r in sorted(after, key=lambda r: r.position)] == mixed


def test_a_run_leaves_its_result_alone(spark, sf_dir, tmp_path, monkeypatch):
    from dialtone.llm import workspace

    monkeypatch.setattr(workspace, "shared_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, sf_dir)
    assert [f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()] == ["pipeline-encoding"] and out.count() > 0
    workspace.staged(spark.range(3), "x")
    workspace.clear(spark)
    assert len(list(tmp_path.iterdir())) == 1


def test_a_cluster_has_to_name_a_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from dialtone.llm import workspace

    conf = SimpleNamespace(get=lambda name, default: default)
    other = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(other)
    other.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        workspace.shared_folder(other)
    other.sparkContext.master = "local[2]"
    assert workspace.shared_folder(other)


def test_mix_takes_rows_without_an_id_once_a_pass(spark, sf_dir):
    rows = [(None, f"a b c{i % 3}", "a") for i in range(30)] + [(i, f"d e f{i}", "b") for i in range(30)]
    docs = cases.documents(spark, rows, extra=False)
    taken = Counter()
    for r in source_mixing.mix_sources(docs.withColumn("k", F.monotonically_increasing_id()), key="k").collect():
        taken[r.doc_id] += r.taken
    after = corpus_pipeline.mixing(spark, docs, sf_dir).collect()
    got = Counter()
    for r in after:
        got[r.doc_id] += len(cases.words(r.text))
    assert got == taken and all(n <= 2 for n in Counter(r.doc_id for r in after if r.doc_id is not None).values())
    assert got[None] <= 2 * 3 * 30 and sum(r.doc_id is None for r in after) <= 60
    mixed = source_mixing.mix_sources(docs.withColumn("k", F.monotonically_increasing_id()), key="k").where("doc_id IS NULL")
    assert mixed.count() == 30 and mixed.select("k").distinct().count() == 30


def test_different_texts_of_an_id_stay(spark, sf_dir):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, cases.BASE, "a"), (1, near, "a"), (1, near, "a"), (1, None, "a"), (2, cases.NEAR, "a"), (3, near, "a"), (4, "one two", "b"), (None, near, "b")]
    after = corpus_pipeline.near_copies(spark, cases.documents(spark, rows, extra=False), sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in after) == Counter([(1, cases.BASE), (1, near), (1, None), (4, "one two"), (None, near)])
