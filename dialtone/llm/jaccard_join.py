"""N-gram Jaccard join by a partitioned universe and the pigeonhole principle.

A document is the set of hashes of its distinct five-word shingles. Sets fall into bands by size; the scheme of
a band covers pairs whose smaller set lies in it, the larger then lies in it or in the next one. A scheme cuts
the hash universe into m segments. Two sets that link differ in at most H elements, so with m > H segments one
segment is equal in both, and its elements are hashed to a key under which both sets meet.

Empty segments are equal in unrelated sets too, so none gives a key; m has `slack` segments beyond H + 1 to make
up for them. A set with more empty ones than that (a *short* set) allots two units to its fuller segments: it
also gives the keys of every segment of two or more elements with one element left out. Two short sets that
link then share a key, a short and a full set do so by the full set's own count. If even that can't reach H + 1
a set gives one key common to its scheme. `slack` is the one with the fewest expected keys. No pair is lost.

Keys meet in buckets of bounded size, reduced to one document per key and batch before the shuffle. Of each
key, every document is first paired with the smallest one only. Where the verified links leave documents of a
key in different components, their pairs are looked at in blocks of bounded size: a parity bitmap of each set, of
a few bits an element, bounds a pair's difference from below, and of the pairs that may still link each document
gives its nearest few, then more of those left, at last all. Pairs inside a component need no look. Each pair
given is verified on the whole sets. Sets and keys are made anew from the texts where they are needed: keeping them would take more
room than the texts.

Defined results: a null or blank text has an empty set and links with nothing. Rows with the same id are one
document, linked by any of its texts. Rows without an id have no component. Shingles are compared by 64-bit
hashes. Very long texts are compared by their whole sets. An empty table gives no rows. Columns beside the id and the
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialtone.llm.components import components
from dialtone.llm.workspace import release, small_batches, staged

SHINGLE = 5
NEEDED, OF = 80, 100  # a pair links when OF * intersection >= NEEDED * union
BUCKET_KEYS = 250_000
SENT_IDS = 500_000  # ids sent to every task, 16 MB at most
BLOCK, PLACE_ROWS = 1_000, 5_000  # documents of a key in a block, rows in a place
NEAREST = (4, 64, None)  # pairs a document gives of a key, round by round
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(w), SHINGLE)
    with np.errstate(over="ignore"):
        total = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            total += w[k : len(w) - n + 1 + k] * STEPS[k]
    return np.unique(mixed(total))


def most_different(small: int, large: int) -> int:
    """Largest symmetric difference of two linked sets of these sizes."""
    union_part = NEEDED + OF
    return small + large - 2 * -(-NEEDED * (small + large) // union_part)


@lru_cache(None)
def band_ends() -> tuple[int, ...]:
    """Largest size of each band: a linked larger set lies in the same band or the next one."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * OF // NEEDED))
    return tuple(ends)


@lru_cache(None)
def scheme(band: int) -> tuple[int, int]:
    """(H + 1, segments) of a band; the slack with the fewest expected keys for a set of the band's middle size."""
    end = band_ends()[band]
    begin = band_ends()[band - 1] + 1 if band else 1
    needed = max(most_different(n, m) for n in {begin, end} for m in {end, end * OF // NEEDED}) + 1
    needed = max(needed, (end + end * OF // NEEDED) * (OF - NEEDED) // (OF + NEEDED) + 1)
    if needed == 1:
        return 1, 1
    size = (begin + end) // 2

    def cost(slack: int) -> float:
        m = needed + slack
        mean = m * exp(-size / m)
        short = 1 - sum(exp(j * log(mean) - mean - lgamma(j + 1)) for j in range(slack + 1))
        return m + max(short, 0) * (size + m)

    return needed, needed + min(range(max(8, needed // 2)), key=cost)


def keys_under(elements: np.ndarray, band: int) -> np.ndarray:
    """Keys of a non-empty set under the scheme of a band."""
    needed, segments = scheme(band)
    at = ((elements >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    spread = mixed(elements, 0x51)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(spread, starts)
        tag = mixed(at[starts] + (np.uint64(band) << np.uint64(40)), 0x77)
        keys = [mixed(sums + tag)]
        if len(starts) < needed:
            sizes = np.diff(np.r_[starts, len(elements)])
            fuller = np.repeat(sizes >= 2, sizes)
            keys.append(mixed((np.repeat(sums, sizes) - spread + np.repeat(tag, sizes))[fuller]))
            if len(starts) + np.count_nonzero(sizes >= 2) < needed:
                keys.append(mixed(np.array([band], np.uint64), 0xE7))
    return np.concatenate(keys) if len(keys) > 1 else keys[0]


def all_keys(elements: np.ndarray) -> np.ndarray:
    """Keys under the scheme of the set's own band and of the band before."""
    if not len(elements):
        return elements
    band = int(np.searchsorted(band_ends(), len(elements)))
    return np.concatenate([keys_under(elements, b) for b in ({band, band - 1} if band else {0})])


def parity_bits(elements: np.ndarray) -> bytes:
    """A bitmap in which every element flips one bit; two bitmaps differ in no more bits than the sets in elements."""
    width = max(64, 2 << (len(elements) - 1).bit_length()) if len(elements) else 64
    at = (mixed(elements, 0x2B) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the sets' symmetric difference; the wider bitmap is folded to the narrower one."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        sets = [shingle_set(t) for t in part["text"]]
        marks = [(mixed(s, 0x3D).sum(dtype=np.uint64), mixed(s, 0x99).sum(dtype=np.uint64)) for s in sets]
        yield pd.DataFrame({
            "doc_id": part["doc_id"], "n": [len(s) for s in sets],
            "h1": np.array([m[0] for m in marks], np.uint64).view(np.int64),
            "h2": np.array([m[1] for m in marks], np.uint64).view(np.int64),
            "bits": [parity_bits(s) for s in sets],
        })


def _bucketed(buckets: int):
    """Keys of a batch, sorted into buckets; of documents that share a key one goes to the key's bucket, and all of
    them go by another way, as rows already known to share it. A bucket's keys are 48 further bits of the key."""

    def packed(keys: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes, int]:
        rest = (keys // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        least = int(docs.min())
        wide = int(docs.max()) - least >= 1 << 32
        return rest.tobytes(), (docs - least).astype("<i8" if wide else "<u4").tobytes(), least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for whole in batches:
            for start in range(0, len(whole), 1000):
                found, ids = [], []
                for doc, text in zip(whole["doc_id"].iloc[start : start + 1000], whole["text"].iloc[start : start + 1000]):
                    elements = shingle_set(text)
                    mark = xxhash.xxh3_128_digest(elements.tobytes())
                    if len(elements) and mark not in seen:  # equal sets are linked without a key
                        seen.add(mark)
                        found.append(all_keys(elements))
                        ids.append(doc)
                if not found:
                    continue
                docs = np.repeat(np.array(ids, np.int64), [len(k) for k in found])
                keys = np.concatenate(found)
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                first = np.r_[True, keys[1:] != keys[:-1]]
                shared = ~first | np.r_[~first[1:], False]
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                out = []
                if shared.any():
                    for b in np.unique(bucket[shared]):
                        of = shared & (bucket == b)
                        out.append((buckets + int(ids[0] % buckets), int(b), *packed(keys[of], docs[of])))
                keys, docs, bucket = keys[first], docs[first], bucket[first]
                order = np.argsort(bucket, kind="stable")
                keys, docs, bucket = keys[order], docs[order], bucket[order]
                names, at = np.unique(bucket, return_index=True)
                for b, x, y in zip(names, at, np.r_[at[1:], len(bucket)]):
                    out.append((int(b), int(b), *packed(keys[x:y], docs[x:y])))
                yield pd.DataFrame(out, columns=["place", "bucket", "keys", "docs", "least"])

    return run


PACKED = "place long, bucket long, keys binary, docs binary, least long"


def _shared_keys(buckets: int):
    """Of a place, the (bucket, key, document) rows whose key has several documents."""

    def run(place: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys, docs, names = [], [], []
        for bucket, k, d, least in zip(part["bucket"], part["keys"], part["docs"], part["least"]):
            rest = np.zeros((len(k) // 6, 8), np.uint8)
            rest[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
            keys.append(rest.reshape(-1).view("<u8").astype(np.int64))
            docs.append(np.frombuffer(d, "<u4" if len(d) == 4 * len(rest) else "<i8").astype(np.int64) + least)
            names.append(np.full(len(rest), bucket))
        keys, docs, names = map(np.concatenate, (keys, docs, names))
        if place[0] < buckets:
            order = np.argsort(keys, kind="stable")
            keys, docs, names = keys[order], docs[order], names[order]
            same = keys[1:] == keys[:-1]
            shared = np.r_[same, False] | np.r_[False, same]
            keys, docs, names = keys[shared], docs[shared], names[shared]
        return pd.DataFrame({"bucket": names, "key": keys, "doc": docs})

    return run


def _wanted(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of `ids`, chosen before any text goes to Python: by a copy of the ids in every task up to
    `SENT_IDS` of them, by a join that shuffles both sides beyond."""
    few = ids.count() <= SENT_IDS
    named = ids.select(F.col("doc").alias("doc_id"))
    return documents.select("doc_id", "text").join(F.broadcast(named) if few else named, "doc_id", "left_semi")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for start in range(0, len(part), 200):
            few = part.iloc[start : start + 200]
            yield pd.DataFrame({"doc": few["doc_id"], "elements": [shingle_set(t).view(np.int64) for t in few["text"]]})


def _verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, compared on their whole sets."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    sets = staged(_wanted(documents, ids).mapInPandas(_sets, "doc long, elements array<long>"), "sets")
    release(ids)
    one, other = (sets.select(F.col("doc").alias(k), F.col("elements").alias(f"set_{k}")) for k in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    linked = pairs.join(other, "b").join(one, "a").where(common * OF >= union * NEEDED).select("a", "b").distinct()
    linked = staged(linked, "found")
    release(sets)
    return linked


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        kept = [
            x is None or y is None or least_difference(x, y) <= most_different(n, m)
            for x, y, n, m in zip(part["bits_a"], part["bits_b"], part["n_a"], part["n_b"])
        ]
        yield part.loc[kept, ["a", "b"]]


def _comparable(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of documents as distinct pairs of representatives whose sizes and bitmaps let them link."""
    side = lambda k: names.select(
        F.col("doc_id").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("least").alias(f"least_{k}"), F.col("most").alias(f"most_{k}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("rep_a <> rep_b")
    fits = f"{OF} * most_a >= {NEEDED} * least_b AND {OF} * most_b >= {NEEDED} * least_a"
    pairs = pairs.where(fits).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    bits = lambda k: names.where("rep = doc_id").select(
        F.col("doc_id").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("most").alias(f"n_{k}"))
    return pairs.join(bits("a"), "a").join(bits("b"), "b").mapInPandas(_near, "a long, b long")


def _folded(bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of `width` bytes of the rows that have this width or twice as much, and each row's place among them."""
    lengths = np.array([-1 if x is None else len(x) for x in bits])
    rows = np.flatnonzero((lengths == width) | (lengths == 2 * width))
    maps = np.zeros((len(rows), width), np.uint8)
    for out, at in zip(maps, rows):
        out[:] = np.bitwise_xor.reduce(np.frombuffer(bits[at], np.uint8).reshape(-1, width), axis=0)
    place = np.full(len(bits), -1)
    place[rows] = np.arange(len(rows))
    return maps.view(np.uint64), place


def _nearest_pairs(nearest: int | None):
    """Pairs of a place's rows that share key and blocks, are in different components and may link. Of each
    document the nearest few; keys that have more give a row without a pair."""

    def run(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "key", "block_a", "block_b"], kind="stable").reset_index(drop=True)
        marks = part[["bucket", "key", "block_a", "block_b"]].to_numpy(np.int64)
        group = np.cumsum(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
        two = marks[:, 2] != marks[:, 3]  # of two blocks, a row meets those of the other one
        node, component, size, own = (part[c].to_numpy(np.int64) for c in ("node", "component", "n", "own"))
        bits = part["bits"].to_numpy()
        lengths = np.array([0 if x is None else len(x) for x in bits])
        maps = {w: _folded(bits, w) for w in np.unique(lengths[lengths > 0]).tolist()}
        found = []
        for step in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero(group[step:] == group[:-step])
            j = i + step
            total = size[i] + size[j]
            fits = OF * np.minimum(size[i], size[j]) >= NEEDED * np.maximum(size[i], size[j])
            width = np.minimum(lengths[i], lengths[j])
            kept = (component[i] != component[j]) & (fits | (width == 0)) & (~two[i] | (own[i] != own[j]))
            i, j, total, width = i[kept], j[kept], total[kept], width[kept]
            most = total - 2 * -(-NEEDED * total // (NEEDED + OF))
            far = np.zeros(len(i), np.int64)
            for w in np.unique(width[width > 0]).tolist():
                of = np.flatnonzero(width == w)
                bitmap, place = maps[w]
                far[of] = np.bitwise_count(bitmap[place[i[of]]] ^ bitmap[place[j[of]]]).sum(axis=1, dtype=np.int64)
            near = (far <= most) | (width == 0)
            found.append(np.column_stack([i[near], j[near], far[near]]))
        pairs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        more = np.empty(0, np.int64)
        if nearest is not None and len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 0]))]
            first = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(pairs)), 0))
            few = np.arange(len(pairs)) - start < nearest
            more = np.unique(group[pairs[~few, 0]])
            pairs = pairs[few]
        x, y = node[pairs[:, 0]], node[pairs[:, 1]]
        distinct = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
        open_keys = np.unique(marks[np.searchsorted(group, more), :2], axis=0)
        return pd.DataFrame({
            "a": np.r_[distinct[:, 0], np.zeros(len(open_keys), np.int64)],
            "b": np.r_[distinct[:, 1], np.zeros(len(open_keys), np.int64)],
            "bucket": np.r_[np.zeros(len(distinct), np.int64), open_keys[:, 0]],
            "key": np.r_[np.zeros(len(distinct), np.int64), open_keys[:, 1]],
            "more": np.r_[np.zeros(len(distinct), bool), np.ones(len(open_keys), bool)],
        })

    return run


def _open_pairs(rows: DataFrame, key: list[str], nearest: int | None) -> DataFrame:
    """(a, b, bucket, key, more): pairs of rows of a key that may link, and keys that have more of them, from blocks
    of a bounded number of a key's rows."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(*key, "node", "component", "n", "bits", "own", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"))
    rows = staged(rows, "open")
    places = max(1, -(-rows.count() // PLACE_ROWS))
    place = F.pmod(F.xxhash64(*key, "block_a", "block_b"), F.lit(places)).alias("place")
    kinds = "a long, b long, bucket long, key long, more boolean"
    looked = staged(rows.select("*", place).groupBy("place").applyInPandas(_nearest_pairs(nearest), kinds), "looked")
    release(rows)
    return looked


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `documents`.

    component_id is the smallest id reachable by links of a shingle Jaccard similarity of 0.8 or more.
    """
    with small_batches(documents.sparkSession):
        return _classes(documents)


def _classes(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "text")
    sized = staged(rows.mapInPandas(_described, "doc_id long, n int, h1 long, h2 long, bits binary"), "marks")
    known = sized.where("doc_id IS NOT NULL AND n > 0")

    # Equal sets: each is named by its smallest document; an id with several texts stands for itself.
    single = known.groupBy("doc_id").agg(
        F.count("*").alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("bits").alias("bits"))
    same = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    equal = known.join(same, ["h1", "h2"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    alone = single.where("texts = 1")
    reps = alone.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    names = alone.join(reps, ["h1", "h2"]).select("doc_id", "rep", "least", "most", "bits").unionByName(
        single.where("texts > 1").select("doc_id", F.col("doc_id").alias("rep"), "least", "most", F.lit(None).alias("bits")))
    names = staged(names, "names")

    # Keys that several documents share.
    total = sized.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // (2 * BUCKET_KEYS))  # a set has about half as many keys as elements
    packed = rows.where("doc_id IS NOT NULL").mapInPandas(_bucketed(buckets), PACKED)
    shared = packed.groupBy("place").applyInPandas(_shared_keys(buckets), "bucket long, key long, doc long")
    shared = staged(shared.distinct(), "shared")
    key = ["bucket", "key"]

    # First each document of a key with the key's smallest one.
    centre = shared.groupBy(*key).agg(F.min("doc").alias("a"))
    star = shared.join(centre, key).where("a <> doc").select("a", F.col("doc").alias("b")).distinct()
    star = staged(_comparable(star, names), "pairs")
    verified = _verified(star, documents)
    links = [staged(equal.unionByName(verified), "found")]
    release(verified)
    classes = components(links[0])

    # Then the other pairs of a key, where its documents are still in different components.
    nodes = names.where("rep = doc_id").select(F.col("rep").alias("node"), F.col("most").alias("n"), "bits")
    member = shared.join(names.select(F.col("doc_id").alias("doc"), "rep"), "doc").select(*key, F.col("rep").alias("node")).distinct()
    member, tried = staged(member, "members"), [star]
    release(shared)
    for nearest in NEAREST:
        labelled = member.join(classes, "node", "left").select(*key, "node", F.coalesce("component", "node").alias("component"))
        split = labelled.groupBy(*key).agg(F.count("*").alias("held"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        open_ = labelled.join(split.where("c1 <> c2").select(*key, "held"), key).join(nodes, "node")
        looked = _open_pairs(open_, key, nearest)
        found = looked.where("NOT more").select("a", "b").distinct()
        found = staged(found.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "pairs")
        tried.append(found)
        if not found.isEmpty():
            links.append(_verified(found, documents))
            if not links[-1].isEmpty():
                classes = components(reduce(DataFrame.unionByName, links))
        rest = looked.where("more").select(*key).distinct()
        if rest.isEmpty():
            release(member, looked)
            break  # every pair that may link was given
        whole, member = member, staged(member.join(rest, key), "members")
        release(whole, looked)
    release(names, *tried, *links)
    return (
        sized.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
