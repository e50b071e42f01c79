"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger remembers which blob was
scanned under which version of the rules. A run scans each unseen (blob, rule version) once, however many paths
and versions hold it, writes the findings, then enters the blobs in the ledger, and joins all findings of this
rule version back to every path. A run that dies before the entry is repeated; findings are read as a set.

Places are found with SQL functions alone: a pattern splits a text into what lies between its matches, and a
match starts where the pieces and the matches before it end. Offsets count code points, ends are exclusive.

Defined results: a null content is an empty one. Rows that repeat a path are separate versions. Paths without
findings have no row in `findings_of_paths` and zero counts in `digests`. Very long contents are scanned whole. An
empty table gives no rows. Other columns stay out of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from dialtone.llm.workspace import new_folder

# The base kinds in their order, then further ones. `length_of` is the group whose length counts.


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    hint: str  # a cheaper pattern that every text with a match has
    length_of: int = 0
    least: int = 1


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", "AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "1"


def addressed(versions: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """(path, blob, content) of every version."""
    text = F.coalesce(F.col(content), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("content"))


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, kind_at, start, end) of all matches in (blob, content), leftmost and not overlapping per kind."""

    def chosen(make) -> Column:
        out = F
        for at, rule in enumerate(rules):
            out = out.when(F.col("kind_at") == at, make(rule))
        return out

    hits = F.filter(F.array(*[F.when(F.col("content").rlike(r.hint), F.lit(at)) for at, r in enumerate(rules)]), lambda x: x.isNotNull())
    by_kind = blobs.select("blob", "content", hits.alias("hits")).where(F.size("hits") > 0)
    by_kind = by_kind.select("blob", "content", F.explode("hits").alias("kind_at"))
    parts = F.arrays_zip(
        chosen(lambda r: F.transform(F.split("content", r.pattern, -1), F.length)).alias("gap"),
        chosen(lambda r: F.transform(F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)), F.length)).alias("long"),
        chosen(lambda r: F.transform(F.regexp_extract_all("content", F.lit(r.pattern), F.lit(r.length_of)), F.length)).alias("counted"),
    )
    rows = by_kind.select("blob", "kind_at", F.posexplode(parts).alias("at", "part"))
    rows = rows.select("blob", "kind_at", "at", "part.gap", "part.long", "part.counted")
    before = Window.partitionBy("blob", "kind_at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(before)
    placed = rows.withColumn("end", end.cast("long")).where("long IS NOT NULL")
    return placed.where(F.col("counted") >= chosen(lambda r: F.lit(r.least))).select(
        "blob", chosen(lambda r: F.lit(r.kind)).alias("kind"), "kind_at",
        (F.col("end") - F.col("long")).alias("start"), "end",
    )


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings, as Parquet under one folder of the shared storage."""

    FINDINGS = "blob string, kind string, kind_at int, start long, end long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, what: str, version: str, columns: str) -> DataFrame:
        try:
            return self.spark.read.schema(columns).parquet(f"{self.folder}/{what}/{version}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], columns)

    def seen(self, version: str) -> DataFrame:
        return self._read("scanned", version, "blob string")

    def findings(self, version: str) -> DataFrame:
        return self._read("findings", version, self.FINDINGS).distinct()

    def scan(self, contents: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> None:
        """Scan what (blob, content) rows hold that this rule version has not seen, then enter it in the ledger."""
        seen = self.seen(version)
        fresh = contents.select("blob", "content")
        if not seen.isEmpty():
            fresh = fresh.join(seen, "blob", "left_anti")
        found = spans(fresh.dropDuplicates(["blob"]), rules)
        found.write.mode("append").parquet(f"{self.folder}/findings/{version}")
        done = contents.select("blob").distinct().join(seen, "blob", "left_anti")
        done.write.mode("append").parquet(f"{self.folder}/scanned/{version}")


def new_ledger(spark: SparkSession) -> BlobLedger:
    return BlobLedger(spark, new_folder(spark, "ledger"))


def findings_of_paths(versions: DataFrame, ledger: BlobLedger, path: str = "doc_id", content: str = "text",
                      rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, kind, start, end) of every version, after bringing the ledger up to date."""
    held = addressed(versions, path, content)
    ledger.scan(held, rules, version)
    return held.select("path", "blob").join(ledger.findings(version).drop("kind_at"), "blob").select("path", "blob", "kind", "start", "end")


def digests(versions: DataFrame, ledger: BlobLedger, path: str = "doc_id", content: str = "text",
            rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """One row per version: counts of the base kinds, the digest of their places, and all places."""
    held = addressed(versions, path, content)
    ledger.scan(held, rules, version)
    base = F.col("kind").isin(*BASE_KINDS)
    place = F.struct("start", "kind_at", "end", "kind")
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    by_blob = ledger.findings(version).groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE_KINDS],
        joined(F.collect_list(F.when(base, place))).alias("base"), joined(F.collect_list(place)).alias("spans"),
    )
    narrow = held.select("path", "blob").join(by_blob, "blob", "left")
    return narrow.select(
        F.col("path").alias(path), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob",
    )
