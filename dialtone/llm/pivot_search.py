"""Exact top-k inner-product search by pivot-table elimination.

Vectors are turned into integers. With one more component that brings every candidate to the same length, a
candidate's distance to a query falls as their inner product rises, so bounds on distances bound scores. A few
dozen pivots are picked from a bounded sample; a table holds every candidate's distances to them. For a query
the largest difference of the two rows of distances is the best lower bound on the distance. Candidates are
evaluated in the order of that bound, in integers, and a query stops for good at the first candidate whose bound
is below its k-th best score. Queries start with the k-th best score within the sample.

Queries and candidates meet in blocks of bounded size; each block pair gives k rows a query, which a ranking per
query reduces to the result. What travels is the integers, in as few bytes as the longest vector allows; a block's
table of distances is made where the block is, as the pivots are there already.

Defined results: a vector that is null or holds a null or non-finite component takes no part, nor does a row
without an id. Of rows that share an id the smallest vector counts. Vectors of different lengths are compared as
if the shorter went on with zeros; an empty one scores 0. A query has as many rows as there are candidates, if
fewer than k. Scores must fit a long. The sample bounds only how well the pivots prune, not what is found. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

PIVOTS, SAMPLE = 48, 1024
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 4096, 1024, 96
SCALE = 256.0


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def integers(vectors, width: int) -> np.ndarray:
    """Rows of floor(256 x), filled with zeros to `width` components."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return out


def stored_as(longest: float) -> str:
    """The smallest type that holds the entries of vectors of this squared length at most."""
    most = np.sqrt(longest) + 1
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """The component that brings candidates to the squared length `longest`."""
    return np.sqrt(np.maximum(longest - (rows * rows).sum(axis=1), 0))


def pick_pivots(sample: np.ndarray, longest: float, count: int = PIVOTS) -> np.ndarray:
    """Row numbers of pivots: each is the sample row farthest from those before it."""
    points = np.column_stack([sample, lifted(sample, longest)])
    if not len(points):
        return np.empty(0, np.int64)
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Rows of distances to the pivots."""
    squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares + (extra[:, None] - pivot_extra) ** 2, 0))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer-valued rows."""
    most = float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(len(query), 1)
    if most < 2**53:
        return (rows @ query).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


def eliminate(query: np.ndarray, own: int, start: int | None, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block: candidates in the order of their upper bound, until it is below the k-th."""
    best: list[tuple[int, int]] = []
    limit = -np.inf if start is None else start
    live = np.flatnonzero((bound >= limit) & (ids != own))
    live = live[np.argsort(-bound[live], kind="stable")]
    for begin in range(0, len(live), CHUNK):
        part = live[begin : begin + CHUNK]
        if bound[part[0]] < limit:
            break
        scores = products(rows[part], query)
        good = scores >= limit
        if good.any():
            best = sorted([*best, *zip((-scores[good]).tolist(), ids[part][good].tolist())])[:k]
            if len(best) == k:
                limit = max(limit, -best[-1][0])
    return [(-score, i) for score, i in best]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    held = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("q"))
    held = held.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * SCALE).cast("double") ** 2)
    whole = held.agg(F.count("*").alias("n"), F.count_if("q").alias("queries"), F.max(F.size("v")).alias("width"), F.max(square).alias("longest")).first()
    sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    width, longest = whole["width"] or 0, float(whole["longest"] or 0)
    seeds = integers([r["v"] for r in sample], width)
    seed_ids = np.array([r["id"] for r in sample], np.int64)
    at = pick_pivots(seeds, longest)
    shared = spark.sparkContext.broadcast((seeds, seed_ids, seeds[at], lifted(seeds[at], longest)))  # at most SAMPLE vectors
    query_blocks = max(1, -(-whole["queries"] // QUERY_BLOCK))
    blocks = max(1, -(-whole["n"] // CANDIDATE_BLOCK))

    kind = stored_as(longest)

    def described(as_query: bool):
        def run(batches):
            seeds, seed_ids, _, _ = shared.value
            for part in batches:
                rows = integers(part["v"], width)
                out = pd.DataFrame({"id": part["id"], "at": part["at"], "row": [r.tobytes() for r in rows.astype(kind)]})
                if as_query:
                    starts = []
                    for own, row in zip(part["id"], rows):
                        scores = products(seeds, row)[seed_ids != own]
                        starts.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else None)
                    out["start"] = pd.array(starts, "Int64")
                yield out

        return run

    def block_of(salt: int, count: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(count)).cast("int").alias("at")

    kinds = "id long, at int, row binary"
    asked = held.where("q").select("id", "v", block_of(1, query_blocks)).mapInPandas(described(True), f"{kinds}, start long")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("at", "query_block")
    given = held.select("id", "v", block_of(2, blocks)).mapInPandas(described(False), kinds)
    given = given.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumnRenamed("at", "block")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            _, _, pivots, pivot_extra = shared.value
            asked, rows = (np.frombuffer(b"".join(side["row"]), kind).reshape(len(side), -1).astype(np.float64) for side in (left, right))
            tables = distances(asked, np.zeros(len(asked)), pivots, pivot_extra)
            table = distances(rows, lifted(rows, longest), pivots, pivot_extra)
            ids = right["id"].to_numpy(np.int64)
            lengths = (asked * asked).sum(axis=1)
            for own, start, query, near, length in zip(left["id"], left["start"], asked, tables, lengths):
                gap = np.abs(table - near).max(axis=1, initial=0)
                gap = np.maximum(gap * (1 - 1e-5) - 1e-4 * (1 + np.sqrt(longest)), 0)  # distances are rounded
                bound = (length + longest - gap * gap) / 2
                bound += 1 + 1e-9 * np.abs(bound)
                best = eliminate(query, own, None if pd.isna(start) else int(start), bound, ids, rows, k)
                out += [(own, i, score) for score, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    key_of = ["query_block", "block"]
    found = asked.groupBy(*key_of).cogroup(given.groupBy(*key_of)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
