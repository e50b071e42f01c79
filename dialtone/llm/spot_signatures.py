"""Document fingerprints by spot signatures.

A spot is an anchor, one of a few common function words; its signature is the anchor and the chain of the next
content words, which skips other anchors. The set of a text's signatures, as 64-bit hashes, is its fingerprint:
it follows the running prose and ignores what has no function words. Texts are alike by the Jaccard similarity
of their sets. Similar sets have similar sizes, so the join cuts sizes into ranges: a set is compared only with
sets of its own range and the next one, and only where it shares one of the rarest signatures that a similar set
can't all miss.

Defined results: a null text is an empty one. A text without any whole chain has one signature, of the whole
text, so equal texts always have equal fingerprints, and the fingerprint of the empty text equals only itself.
Rows that repeat an id stay separate rows, in the order of their texts, and are in one class. A row without an id has
no class. Very long texts have as many signatures as chains. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialtone.llm.components import components
from dialtone.llm.workspace import clear, made, release, staged, without_shuffle_files

# Anchors, the commonest function words of some languages.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für ist mit nicht und von zu "
    "al con del el en es la las los para por que se un una y "
    "au aux avec ce dans de du est et il le les pas pour qui sur"
).split()
CHAIN = 3
RANGE_ROWS, MOST_RANGES = 2_000, 2_000
BLOCK = 32  # sets of a key in a block
LETTERS = r"[^\p{L}\p{N}]+"


def with_signatures(rows: DataFrame, text: str, name: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """`rows` with the sorted distinct 64-bit signatures of a text column."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), LETTERS, " "), F.lit(" "))
    # An anchor, or the last of several in a row, becomes a mark on the content word that follows it. The
    # possessive loop takes runs of any length without recursion.
    marked = F.regexp_replace(spaced, f"(?: ({'|'.join(anchors)})(?= ))++ ", " $1|")
    words = F.filter(F.split(marked, " "), lambda w: (w != "") & ~w.endswith("|"))
    rows = rows.withColumn("_words", words)
    rows = rows.withColumn("_plain", F.transform("_words", lambda w: F.substring_index(w, "|", -1)))
    following = [lambda i, k=k: F.get("_plain", i + k) for k in range(1, chain)]
    hashed = F.xxhash64
    spots = F.transform("_words", lambda w, i: F.when(
        w.contains("|") & (i + (chain - 1) < F.size("_words")), hashed(w, *[f(i) for f in following])))
    rows = rows.withColumn("_spots", F.array_sort(F.array_distinct(F.array_compact(spots)))).drop("_words", "_plain")
    whole = F.array(hashed(F.lit("the whole text"), F.col(text)))
    return rows.withColumn(name, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)).drop("_spots")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a count where their sizes keep it below `least`."""
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    apart = F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b))
    return F.when(apart, F.lit(0.0)).otherwise(exact)


def similar_pairs(signed: DataFrame, threshold: float = 0.8, key: str = "doc_id", name: str = "signatures") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) between classes of equal sets, and (id, class) membership.

    Each set is listed under its size range and, for the sets above, under the next one, by its rarest signatures.
    """
    named = signed.select(F.col(key).alias("id"), F.col(name).alias("s")).where("id IS NOT NULL")
    member = named.groupBy("s").agg(F.min("id").alias("class"))
    classes = member.select("class", "s", F.size("s").alias("n"))
    item = classes.select("class", "n", F.explode("s").alias("item"))
    rarity = item.groupBy("item").agg(F.count("*").alias("held"))
    order = Window.partitionBy("class").orderBy("held", "item")
    prefix = item.join(rarity, "item").withColumn("at", F.row_number().over(order))
    prefix = prefix.where(F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    band = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9)
    small = prefix.select("item", F.col("class").alias("x"), F.col("n").alias("nx"), F.explode(F.array(band, band + 1)).alias("band"))
    large = prefix.select("item", F.col("class").alias("y"), F.col("n").alias("ny"), band.alias("band"))
    fits = (F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")) & (F.col("nx") >= threshold * F.col("ny") - 1e-9)
    pairs = small.join(large, ["item", "band"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda k: classes.select(F.col("class").alias(k), F.col("s").alias(f"s{k}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", likeness("sa", "sb", threshold))
    membership = named.join(member, "s").select("id", "class")
    return found.where(F.col("similarity") >= threshold).select("a", "b", "similarity"), membership


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(item, band, node, n, at, large), in files: the keys under which sets meet.

    A set's signatures stand by rarity, `at` is the place. Two similar sets have a first common signature; in the
    larger set it is among those that leave enough for its share of the threshold, in the smaller one among fewer, as
    its partner is no smaller. So a set is listed as the larger one of a pair under its own size range, and by fewer
    signatures as the smaller one under its own and the next range. Signatures that no other set has stand first and
    are only counted.
    """
    item = classes.select("node", "n", F.explode("s").alias("item"))
    # in files, so that the shuffle files of the counts are gone before the signatures are shuffled again
    rarity = staged(item.groupBy("item").agg(F.count("*").alias("held")).where("held > 1"), "rarity")
    whole = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(whole)
    placed = item.join(rarity, "item").withColumn("at", (alone + F.row_number().over(whole.orderBy("held", "item"))).cast("int"))
    left = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    placed = placed.where(F.col("at") <= left(threshold))
    band = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9)
    few = F.col("at") <= left(2 * threshold / (1 + threshold))
    roles = F.array(F.struct(band.alias("band"), F.lit(True).alias("large")), *[
        F.when(few, F.struct((band + k).alias("band"), F.lit(False).alias("large"))) for k in (0, 1)])
    listed = placed.select("item", "node", "n", "at", F.explode(F.array_compact(roles)).alias("role"))
    keys = staged(listed.select("item", "role.*", "node", "n", "at"), "prefixes")
    release(rarity)
    return keys


def _similar(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by their whole sets."""
    side = lambda k: classes.select(F.col("node").alias(k), F.col("s").alias(f"s{k}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.where(likeness("sa", "sb", threshold) >= threshold - 1e-12).select("a", "b")


def _between(open_: DataFrame, threshold: float, how: str) -> DataFrame:
    """Distinct pairs (a, b) of sets of a key that are in different components and whose places let them be similar:
    "some" of one block of about `BLOCK` sets of the key, those with the "first" set of a component and role, or "all"."""
    same = ["item", "band"]
    if how == "some":
        blocks = F.ceil(F.col("held") / BLOCK).cast("int")
        open_ = open_.withColumn("block", F.pmod(F.xxhash64("node", "item"), blocks))
        same.append("block")
    leads = F.lit(True)
    if how == "first":
        role = [*same, "component", "large"]
        open_ = open_.join(open_.groupBy(*role).agg(F.min("node").alias("first")), role)
        leads = F.col("node") == F.col("first")
    open_ = open_.withColumn("leads", leads)
    side = lambda k, large: open_.where(F.col("large") == large).select(
        *same, *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "at", "component", "leads")])
    left = lambda k: F.col(f"n_{k}") - F.col(f"at_{k}")
    needed = F.ceil(threshold / (1 + threshold) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    fits = (F.col("component_x") != F.col("component_y")) & (F.col("n_x") <= F.col("n_y")) & (1 + F.least(left("x"), left("y")) >= needed)
    pairs = side("x", False).where("leads_x").join(side("y", True), same).where(fits)
    if how == "first":
        pairs = pairs.unionByName(side("x", False).join(side("y", True).where("leads_y"), same).where(fits))
    return pairs.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def similar_classes(signed: DataFrame, threshold: float = 0.8, key: str = "doc_id", name: str = "signatures") -> DataFrame:
    """(id, class, class_size): documents in classes by links of similar sets, a class named by its smallest id.

    Equal sets are one node. Under each key all sets are first compared with one of them, so that a large group of near
    copies is one component after that, or a few. Sets of a key that are still in different components are compared
    with some others, then with one set of each other component, and only those still apart after that all with each
    other: what is compared and linked grows with a group's size, not with its square.
    """
    spark, before = signed.sparkSession, made()
    with without_shuffle_files(spark):
        classes = staged(_similar_classes(signed, threshold, key, name), "classes")
    clear(spark, keep=before, but=classes)
    return classes


def _similar_classes(signed: DataFrame, threshold: float, key: str, name: str) -> DataFrame:
    named = staged(signed.select(F.col(key).cast("long").alias("id"), F.col(name).alias("s")).where("id IS NOT NULL").distinct(), "signed")
    classes = named.select("s").distinct().select("s", F.size("s").alias("n"), F.monotonically_increasing_id().alias("node"))
    classes = staged(classes, "sets")  # in files, so that a set's number stays
    member = staged(named.join(classes, "s").select("id", "node"), "set-members")
    release(named)
    # texts of one id are one document
    first = member.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("sets")).where("sets > 1")
    together = member.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b")

    keys = _prefixes(classes, threshold)
    same = ["item", "band"]
    centre = keys.groupBy(*same).agg(F.min_by("node", F.struct(~F.col("large"), "node")).alias("b"), F.max("large").alias("met")).where("met")
    star = keys.join(centre, same).where("node <> b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    links = [staged(_similar(star, classes, threshold).unionByName(together), "similar")]
    found, tried = components(links[0]), []

    for how in ("some", "first", "all"):
        labelled = keys.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = labelled.groupBy(*same).agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("large").alias("met"), F.count("*").alias("held"))
        open_ = staged(labelled.join(apart.where("met AND c1 <> c2").select(*same, "held"), same), "apart")
        pairs = _between(open_, threshold, how)
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(staged(pairs, "pairs"))
        more = staged(_similar(tried[-1], classes, threshold), "similar")
        if not more.isEmpty():
            links.append(more)
            found = components(reduce(DataFrame.unionByName, links))
        release(open_)

    whole = member.join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component")).distinct()
    sizes = whole.groupBy("component").agg(F.min("id").alias("class"), F.count("*").alias("class_size"))
    return whole.join(sizes, "component").select("id", "class", "class_size")


def _followed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, signatures, next_text, next_signatures): rows beside the next row by id, the last beside the first.

    Ids are cut into ranges at ids that occur. The first rows of a range are also put at the end of the range
    before it, so every range finds its successors by itself.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("without"), F.min("doc_id").alias("least")).first()
    ranges = min(MOST_RANGES, -(-max(seen["n"], 1) // RANGE_ROWS))
    cuts: list[int] = []
    if ranges > 1 and seen["least"] is not None:
        shares = [k / ranges for k in range(1, ranges)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] or []
        cuts = sorted(set(found) - {seen["least"]})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    first = F.col("doc_id").isNull() if seen["without"] else F.col("doc_id") == F.lit(seen["least"])
    again = F.when(first, F.lit(len(cuts))).when(F.array_contains(bounds, F.col("doc_id")), at - 1)
    places = F.array_compact(F.array(
        F.struct(at.alias("range"), F.lit(False).alias("again")),
        F.when(again.isNotNull(), F.struct(again.alias("range"), F.lit(True).alias("again"))),
    ))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*").repartition("range")
    dealt = with_signatures(dealt, "text", "signatures")
    order = Window.partitionBy("range").orderBy("again", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select(
        "doc_id", "text", "signatures", "again", F.lead("text").over(order).alias("next_text"),
        F.lead("signatures").over(order).alias("next_signatures"),
    ).where("NOT again").drop("again")


def fingerprints(documents: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last quarter replaced by the beginning of the
    next document), and its likeness to that and to the next document; also the columns of `beside`, a row per doc_id."""
    rows = _followed(documents).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = with_signatures(rows.drop("text", "next_text"), "edited", "edited_signatures")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "signatures", "edited_signatures",
        likeness("signatures", "edited_signatures").alias("near_edited"), likeness("signatures", "next_signatures").alias("near_next"),
    )
    if beside is not None:
        rows = rows.join(beside, "doc_id", "left")  # before the digits are written, which take twice the room
    written = lambda c: F.array_join(F.transform(c, lambda x: F.hex(x)), ",")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written("signatures").alias("fingerprint"),
        written("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next",
        *[c for c in (beside.columns if beside is not None else ()) if c != "doc_id"],
    )
