"""From documents to encoded training text: stages that each apply one operator of ``dialtone.llm``.

    1. quality       documents that the quality network rejects go
    2. near_copies   of each group of near duplicates one document stays, the one with the smallest id
    3. secrets       every secret found is replaced by a mark of its kind
    4. mixing        documents are put in the order of their training positions, taken as often and as far as the
                     source mix takes them
    5. encoding      texts become token ids, with their byte spans and the decoded text, and the number of each in
                     training order

A stage takes the documents that the one before kept, with the columns of ``documents``; the last returns the
encoding. Stages write what they decide on to Parquet, each stage reading the files of the one before.

Defined results: a null text is an empty one wherever it is looked at, and stays null until it is encoded. An
empty document passes the quality stage if the network's score of an empty text does, is never a copy of
another, and is taken 0 words and so leaves in the mixing stage. A document without an id is judged by its text
and is a copy of nothing. Rows that repeat an id and its text are one document in the copy stage, the one whose other
columns have the smallest hash; different texts of an id are documents of their own. Very long texts are worked on
whole. Further columns of ``documents``, whatever their names, are carried along. An empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dialtone.llm import jaccard_join, piece_encoding, quality_network, secret_scans, source_mixing, workspace
from dialtone.llm.workspace import staged

ACCEPTED = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one, so that none has the name of one that a stage makes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(None).alias("none")]).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The rows with the columns of `docs`; where a text has changed its number of characters is counted anew."""
    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name)
        kept = F.col("rest")[name]
        if name == "n_chars" and changed is not None:
            kept = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(kept)
        return kept.alias(name)

    return rows.select(*map(column, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, scores at least `ACCEPTED`."""
    net = quality_network.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(quality_network.score(_packed(docs), net, name="quality").where(F.col("quality") >= ACCEPTED), docs)


def _texts_apart(rows: DataFrame) -> DataFrame:
    """Rows with an id, with a number `key` of each id and text: the id where an id has one text, and for one of them."""
    rows = rows.where("doc_id IS NOT NULL").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = staged(rows.select("doc_id", "hash").distinct(), "texts")
    first = texts.groupBy("doc_id").agg(F.min("hash").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    ends = texts.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    number = F.monotonically_increasing_id()
    free = F.lit(ends["most"]) + 1 + number if (ends["most"] or 0) < 1 << 62 else F.lit(ends["least"]) - 1 - number
    more = staged(texts.join(first, "doc_id").where("hash <> first").select("doc_id", "hash", free.alias("more")), "more")
    if more.isEmpty():
        return rows.withColumn("key", F.col("doc_id")).drop("hash")
    return rows.join(more, ["doc_id", "hash"], "left").withColumn("key", F.coalesce("more", "doc_id")).drop("hash", "more")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    packed = _packed(docs)
    rows = _texts_apart(packed)
    classes = jaccard_join.near_duplicate_classes(rows.select(F.col("key").alias("doc_id"), "text"))
    ids = rows.select("key", "doc_id").distinct()
    first = F.min_by("key", F.struct("doc_id", "key"))
    members = classes.distinct().select(F.col("doc_id").alias("key"), "component_id").join(ids, "key")
    leaders = members.groupBy("component_id").agg(first.alias("key")).select("key")
    order = Window.partitionBy("key").orderBy(F.xxhash64("rest"))
    kept = rows.join(leaders, "key", "left_semi").withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return _unpacked(kept.select("doc_id", "text", "rest").unionByName(packed.where("doc_id IS NULL")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by ``[kind]``; of overlapping ones the whole stretch by the first one's kind."""
    rows = _packed(docs).withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    ledger = secret_scans.new_ledger(spark)
    ledger.scan(secret_scans.addressed(docs))
    found = ledger.findings(secret_scans.RULE_VERSION)
    order = Window.partitionBy("blob").orderBy("start", "kind_at")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.when(F.col("start") < reach, 0).otherwise(1))
    found = found.withColumn("stretch", F.sum("opens").over(order))
    stretch = found.groupBy("blob", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind_at")).alias("kind"))
    cuts = stretch.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    rows = rows.join(cuts, "blob", "left")
    # What stands before a cut begins where the cut before it ends.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    pieces = F.transform(F.arrays_zip(F.col("cuts").alias("cut"), F.slice(begins, 1, F.size("cuts")).alias("begin")), lambda z: F.concat(
        F.substring(F.col("text"), (z["begin"] + 1).cast("int"), (z["cut"]["start"] - z["begin"]).cast("int")),
        F.lit("["), z["cut"]["kind"], F.lit("]")))
    tail = F.expr("substring(text, CAST(element_at(cuts, -1).end + 1 AS INT))")
    cut = F.size("cuts") > 0
    rows = rows.withColumn("text", F.when(cut, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text")))
    return _unpacked(rows, docs, changed=cut)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, in training order; the last document of a source is cut to the words
    that the mix takes of it."""
    rows = _packed(docs).select("*", F.col("rest.source").alias("source"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "rows")  # in files, so that a row's number stays
    mixed = source_mixing.mix_sources(rows, key="row")
    passes = F.array(
        F.struct(F.col("position"), F.col("first_words").alias("words")),
        F.struct(F.col("repeat_position").alias("position"), F.col("repeat_words").alias("words")),
    )
    takes = mixed.select("row", F.explode(F.filter(passes, lambda p: p["words"] > 0)).alias("take")).select("row", "take.*")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(source_mixing.WORD)).cast("long")
    rows = rows.drop("source").withColumn("size", size).join(takes, "row")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.col("words") < F.col("size")
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("text")))
    return _unpacked(rows.orderBy("position", "doc_id", "row"), docs, changed=cut)


def in_file_order(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text, position): rows numbered from 0 in the order in which a sorted table was written, whose
    files are numbered; rows that come from no files in the order of their partitions."""
    try:
        rows = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("position"))
    part = F.expr("try_cast(regexp_extract(file, 'part-([0-9]+)', 1) AS INT)")
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)
    # one row per file
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    return rows.join(begins, "file").select("doc_id", "source", "text", (F.col("begin") + F.col("at")).alias("position"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position in training order, and the digests of the encoding of each text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_encoding.encoding_digests(in_file_order(docs), model).select("doc_id", "source", "position", "digest.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding),
]

# The quality network and the piece encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next. Of the
    tables made on the way only the last one stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace.made()
    held = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{workspace.shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        workspace.clear(spark, keep=before)
        docs = spark.read.parquet(path)
        if held:
            workspace.delete(spark, held)
        held = path
    return docs
