"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification. DataFrame operations only.

* Documents with the same word sequence (lower-cased) form one text class, by aggregation with map-side
  combine; only class representatives are joined, so thousands of copies cost one row.
* ``N_HASHES`` MinHash values per representative: word n-gram hashes are exploded and folded by ``min`` in
  one aggregation, inside generated code.
* The forest: ``trees`` prefix tries, each over its own order of the hash values. Two texts meet in a tree
  when they share a prefix of the current depth. Trees share hash values, so the chance p(J) to meet is that of
  these very prefixes, not of as many independent ones. Depth starts at the longest prefix that gives a pair
  at the threshold the target recall, so no similarity above it has less; from a longer start it is shortened
  until, in each band of similarity, found / sum(1/p(J)) over the verified pairs reaches the target.
* The crowd: buckets of more than ``BLOCK`` texts, whose pairs would grow as their square, form none. Links among
  their texts are found exactly instead: within a dense group (texts near a leader) all pairs are compared by bitmaps
  of the group's shingles, counted and not written; the others meet by their rarest shingles.
* Verification: pairs with too few equal hash values go; for the others, the shingle arrays of texts that hang
  together meet in one task, block by block, and are compared exactly.
"""

from __future__ import annotations

import math
import random
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, components, gram_hashes, hit_filter, lookup, materialise, may_hit, partitions, text_of, unboxed, words_of

#: A multiple of 4, at most 60; with 40 trees of depth 3 each value is in two prefixes.
N_HASHES = 60
TREES = 40
MAX_DEPTH = 5
MIN_DEPTH = 2
#: Bands of similarity of the estimated recall, and steps of the table of chances.
RECALL_BANDS = 20
STEPS = 1000
#: Rows of the largest bucket whose pairs are formed as such; texts of larger ones are the crowd. A dense group has more texts than this.
BLOCK = 64
#: Texts of one block of a component.
GROUP = 256
#: Texts of one block of a dense group, and words of 64 bits of their bitmaps, so many at a time.
SQUARE = 1024
WORDS = 32
STRIDE = 8
#: Bitmaps of 4 KB of the filter that picks the texts to verify; a fuller filter only lets more texts through.
FILTER = 1024


def forest_orders(trees: int = TREES, depth: int = MAX_DEPTH, hashes: int = N_HASHES) -> list[list[int]]:
    """The hash numbers that each tree's prefix reads: dealt place by place, so prefixes of any depth use all values alike."""
    rng = random.Random(7)
    orders: list[list[int]] = [[] for _ in range(trees)]
    deck: list[int] = []
    for _ in range(depth):
        for order in orders:
            if all(k in order for k in deck):
                deck += rng.sample(range(hashes), hashes)
            order.append(deck.pop(next(i for i, k in enumerate(deck) if k not in order)))
    return orders


@cache
def met_chances(depth: int, trees: int, hashes: int = N_HASHES, samples: int = 200_000) -> tuple[float, ...]:
    """The chance that texts of similarity 0, 1 / STEPS, ..., 1 share a prefix of this depth in some tree of the forest.

    Value k is equal when a uniform number of its own is below the similarity, so a pair meets from the least,
    over the trees, of the greatest number in a prefix.
    """
    rng = np.random.default_rng(7)
    orders = np.array([order[:depth] for order in forest_orders(trees, hashes=hashes)])
    least = np.sort(np.concatenate([rng.random((samples // 20, hashes))[:, orders].max(2).min(1) for _ in range(20)]))
    return tuple((np.searchsorted(least, np.arange(STEPS + 1) / STEPS) / len(least)).tolist())


def met_chance(j: Column, depth: int, trees: int) -> Column:
    """The chance, above 0, that texts of similarity ``j`` share a prefix of this depth in some tree."""
    table = F.array(*[F.lit(max(p, 1e-6)) for p in met_chances(depth, trees)])
    return F.element_at(table, F.floor(j * STEPS).cast("int") + 1)


def shingles(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the word n-grams; the whole text is one gram if it has fewer words; none if empty."""
    size = F.size(words)
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size < n, short).otherwise(F.array_distinct(gram_hashes(words, n)))


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``members(id, digest)`` and ``classes(digest, rep, n)``, where rep is the smallest id of equal word sequences."""
    words = F.lower(F.array_join(words_of(text_of(text_col)), " "))
    members = materialise(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(words, 256)).alias("digest")), "members")
    return members, materialise(members.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``(id, size, p0, p1, ...)`` of ``docs(id, w)``: the low 16 bits of each MinHash value, four to a number; texts without shingles have none."""
    grams = shingles(F.col("w"), n)
    mins = [F.min(F.xxhash64("g", F.lit(k))).alias(f"h{k}") for k in range(N_HASHES)]
    out = docs.select("id", F.explode(grams).alias("g")).groupBy("id").agg(F.count("*").alias("size"), *mins)
    low = lambda k: F.shiftleft(F.col(f"h{k}").bitwiseAND(0xFFFF), 16 * (k % 4))
    packed = [low(4 * j).bitwiseOR(low(4 * j + 1)).bitwiseOR(low(4 * j + 2)).bitwiseOR(low(4 * j + 3)).alias(f"p{j}") for j in range(N_HASHES // 4)]
    return out.select("id", "size", *packed)


def value(k: int) -> Column:
    """The k-th value of a packed signature."""
    return F.shiftrightunsigned(F.col(f"p{k // 4}"), 16 * (k % 4)).bitwiseAND(0xFFFF)


def least_matches(threshold: float) -> int:
    """How many hash values texts at the threshold share but for one time in 10,000."""
    at_most, k = 0.0, 0
    while True:
        at_most += math.comb(N_HASHES, k) * threshold**k * (1 - threshold) ** (N_HASHES - k)
        if at_most > 1e-4:
            return k
        k += 1


def prefixes(sigs: DataFrame, depth: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """``rows(id, tree, key)``, the prefix of each text in each tree, and ``buckets(key, n, first, last)``: those that several texts share, with two of them, the leaders."""
    prefix = F.array(*[F.xxhash64(F.lit(t), *[value(k) for k in order[:depth]]) for t, order in enumerate(forest_orders(trees))])
    rows = materialise(sigs.select("id", F.posexplode(prefix).alias("tree", "key")), "prefixes")
    return rows, materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1"), "buckets")


def compared(met: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``mask``, whose bits are the equal values of the signatures in ``a_p0, ...`` and ``b_p0, ...``."""
    packs = [f"p{j}" for j in range(N_HASHES // 4)]
    met = met.select(*keep, *[F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")).alias(c) for c in packs])
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(value(k) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(N_HASHES)])
    return met.select(*keep, F.explode(F.array(mask)).alias("mask"))  # a generator, lest the long expression be copied into each use


def sides(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, with ``a_`` and ``b_`` before the names of all columns but ``keys``."""
    a, b = (rows.select(*keys, *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in keys]) for x in "ab")
    return a, b


def sizes_allow(threshold: float) -> Column:
    return F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold


def share_enough(common: Column, threshold: float) -> Column:
    """Whether sets of ``a_size`` and ``b_size`` that share so many reach the threshold."""
    return common * (1 + threshold) >= (F.col("a_size") + F.col("b_size")) * threshold - 1e-9


def candidates(sigs: DataFrame, rows: DataFrame, buckets: DataFrame, crowd: DataFrame | None, depth: int, trees: int, threshold: float) -> DataFrame:
    """Pairs ``a < b`` that meet in a bucket of at most ``BLOCK`` rows and whose sizes and signatures allow the threshold.

    Each pair comes from the first tree that it shares, so it is formed once; those within the crowd are left out.
    """
    rows = rows.join(buckets.where(F.col("n") <= BLOCK).select("key"), "key").join(sigs, "id")
    rows = rows.withColumn("crowd", F.lit(False)) if crowd is None else rows.join(crowd.withColumn("crowd", F.lit(True)), "id", "left").fillna(False, ["crowd"])
    left, right = sides(rows, "key", "tree")
    met = left.join(right, ["key", "tree"]).where((F.col("a_id") < F.col("b_id")) & ~(F.col("a_crowd") & F.col("b_crowd")) & sizes_allow(threshold))
    met = compared(met.withColumnsRenamed({"a_id": "a", "b_id": "b"}), "tree", "a", "b")
    of_tree = [sum(1 << k for k in order[:depth]) for order in forest_orders(trees)]
    first = F.coalesce(*[F.when(F.col("mask").bitwiseAND(m) == m, t) for t, m in enumerate(of_tree)])
    return met.where((F.bit_count("mask") >= least_matches(threshold)) & (first == F.col("tree"))).select("a", "b")


def crowd_texts(crowded: DataFrame, sigs: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(id, label, m, size, grams)`` of the texts in ``crowded(id, leader)``, the rows of buckets of more than ``BLOCK``.

    Texts whose signatures say that they are near a leader of a bucket get its label, also through others. Those of
    a label that has ``m > BLOCK`` texts are a dense group; the others get labels of their own, and no ``m``.
    """
    a, b = sides(sigs)
    stars = crowded.where("id <> leader").select(F.col("id").alias("a_id"), F.col("leader").alias("b_id")).distinct().join(a, "a_id").join(b, "b_id").where(sizes_allow(threshold))
    stars = compared(stars.withColumnsRenamed({"a_id": "a", "b_id": "b"}), "a", "b").where(F.bit_count("mask") >= math.floor(threshold * N_HASHES)).select("a", "b")
    roots = components(stars)
    dense = roots.join(roots.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "root")
    crowd = crowded.select("id").distinct()
    labels = crowd.join(dense, "id", "left").select("id", F.coalesce("root", "id").alias("label"), "m")
    rows = may_hit(docs, hit_filter(crowd, "id", FILTER), "id", FILTER).select("id", shingles(F.col("w"), n).alias("grams"))
    rows = rows.join(labels, "id").groupBy("id", "label", "m").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    return materialise(rows.select("id", "label", "m", F.size("grams").alias("size"), "grams"), "crowd")


def crowd_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of the crowd, not of one dense group, that can reach the threshold: by prefix filtering, so none is missed.

    Two sets of that similarity share one of the rarest size - ceil(threshold * size) + 1 shingles of each, and from the
    rarest that they share on, either has as many left as they must share. Lines that many texts have come last, so
    texts that have little else in common don't meet. Where one label has most of a shingle's texts, only the others
    look for partners.
    """
    grams = texts.select("id", F.explode("grams").alias("g"))
    counted = grams.join(grams.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("grams"))
    length = (F.size("grams") - F.ceil(F.size("grams") * threshold - 1e-6) + 1).cast("int")
    rare = counted.select("id", F.size("grams").alias("size"), F.posexplode(F.slice("grams", F.lit(1), length)).alias("at", "x")).where("x.n > 1").select("id", "x.g", (F.col("size") - F.col("at")).alias("left"))
    rare = materialise(rare.join(texts.select("id", "label", "size"), "id"), "rare-shingles")
    homes = rare.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.count("*").alias("labels"))
    left, right = sides(rare.join(homes.where("labels > 1").drop("labels"), "g"), "g", "home")
    met = left.where("a_label <> home").join(right, ["g", "home"]).where("a_label <> b_label AND (b_label = home OR a_id < b_id)").where(sizes_allow(threshold) & share_enough(F.least("a_left", "b_left"), threshold))
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def bitmaps(texts: DataFrame) -> DataFrame:
    """``(id, label, m, size, b0, b1, ..., rest)`` of the dense groups' texts: which of the group's shingles each has.

    Only shingles that several texts of the group have are numbered, the most frequent first; those that have no
    place in the ``WORDS`` words of 64 bits are in the array ``rest``.
    """
    grams = texts.where("m IS NOT NULL").select("id", "label", "m", "size", F.explode("grams").alias("g"))
    places = grams.groupBy("label", "g").agg(F.count("*").alias("n")).where("n > 1")
    places = places.select("label", "g", (F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "g")) - 1).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / 64) == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(WORDS)]
    rest = F.collect_list(F.when(F.col("at") >= 64 * WORDS, F.col("at"))).alias("rest")
    return materialise(grams.join(places, ["label", "g"]).groupBy("id", "label", "m", "size").agg(*words, rest), "bitmaps")


def dense_pairs(maps: DataFrame, threshold: float, where: str = "true") -> DataFrame:
    """``(a, b, jaccard)`` of all pairs of texts of a dense group that reach the threshold and meet ``where``; never written.

    A group is cut into blocks of ``SQUARE`` texts; each pair of blocks is a task key of its own.
    """
    blocks = F.ceil(F.col("m") / SQUARE).cast("int")
    maps = maps.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("m")
    maps = maps.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    left, right = sides(maps, "label", "i", "j")
    met = left.where("a_block = i").join(right.where("b_block = j"), ["label", "i", "j"])
    met = met.where("i < j OR a_id < b_id").where(where).where(sizes_allow(threshold)).withColumn("bits", F.lit(0))
    for k in range(0, WORDS, STRIDE):  # by generators, as in compared(), few words in each: compiled code of all at once runs much slower
        bits = [F.bit_count(F.col(f"a_b{x}").bitwiseAND(F.col(f"b_b{x}"))) for x in range(k, min(k + STRIDE, WORDS))]
        met = met.withColumn("bits", F.explode(F.array(reduce(lambda x, y: x + y, bits, F.col("bits")))))
    more = F.when((F.size("a_rest") == 0) | (F.size("b_rest") == 0), 0).otherwise(F.size(F.array_intersect("a_rest", "b_rest")))
    at_most = F.col("bits") + F.least(F.size("a_rest"), F.size("b_rest"))
    met = met.where(share_enough(F.col("bits"), threshold) | (share_enough(at_most, threshold) & share_enough(F.col("bits") + more, threshold)))
    common = F.col("bits") + more
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), (common / (F.col("a_size") + F.col("b_size") - common)).alias("jaccard"))


def ends(pairs: DataFrame) -> DataFrame:
    """``(id, other)`` of ``pairs(a, b)``, both ways round."""
    both = F.array(*[F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")])
    return pairs.select(F.inline(both))


def verify(pairs: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``pairs(a, b, jaccard)`` with exact similarity of at least the threshold; ``docs(id, w)`` has the words.

    Candidates that hang together go to the same task: their component is cut into blocks of ``GROUP`` texts,
    and a text's shingles travel once to each pair of blocks in which it has a candidate, not once a pair.
    """
    spark = pairs.sparkSession
    roots = components(pairs)
    ids = roots.select("id")
    rows = may_hit(docs, hit_filter(ids, "id", FILTER), "id", FILTER)
    grams = materialise(rows.select("id", shingles(F.col("w"), n).alias("grams")).join(ids, "id", "left_semi"), "shingles")
    place = roots.join(roots.groupBy("root").agg(F.count("*").alias("m")), "root")
    place = place.select("id", "root", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / GROUP)).alias("block"))
    of_a, of_b = (place.select(F.col("id").alias(x), "root", F.col("block").alias(f"block_{x}")) for x in "ab")
    keyed = pairs.join(of_a, "a").join(of_b.drop("root"), "b")
    keyed = keyed.select("a", "b", F.xxhash64("root", F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("task"))
    keyed = materialise(keyed, "keyed-pairs")
    sent = keyed.select("task", F.col("a").alias("id")).union(keyed.select("task", F.col("b").alias("id"))).distinct()
    parts = partitions(spark)
    sent = sent.join(grams, "id").repartition(parts, "task")
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # rows of a task are together, so joins by task and id need no further exchange
    try:
        left = sent.select("task", F.col("id").alias("a"), F.col("grams").alias("grams_a")).hint("shuffle_hash")
        right = sent.select("task", F.col("id").alias("b"), F.col("grams").alias("grams_b")).hint("shuffle_hash")
        both = keyed.repartition(parts, "task").join(left, ["task", "a"]).join(right, ["task", "b"])
        sizes = both.select("a", "b", F.size("grams_a").alias("na"), F.size("grams_b").alias("nb"), F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
        scored = sizes.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))
        return materialise(scored.where(F.col("jaccard") >= threshold), "links")
    finally:
        spark.conf.set(conf, before)


def first_depth(threshold: float, target_recall: float, trees: int) -> int:
    """The longest prefix that gives a pair at the threshold the target recall; the shortest if none does."""
    reached = [d for d in range(MAX_DEPTH, MIN_DEPTH - 1, -1) if met_chances(d, trees)[int(threshold * STEPS)] >= target_recall]
    return reached[0] if reached else MIN_DEPTH


def recall_reached(found: DataFrame, depth: int, trees: int, target_recall: float) -> bool:
    """Whether the estimated recall reaches the target in every band of similarity that has pairs; those of the crowd, which can't be missed, count like others."""
    band = F.floor(F.col("jaccard") * RECALL_BANDS).alias("band")
    rates = found.groupBy(band).agg((F.count("*") / F.sum(1 / met_chance(F.col("jaccard"), depth, trees))).alias("rate"))
    return rates.where(F.col("rate") < target_recall).isEmpty()


def linked(docs: DataFrame, reps: DataFrame, n: int, threshold: float, target_recall: float = 0.98, trees: int = TREES, start: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``links(a, b, jaccard)`` between the texts ``docs(id, w)`` whose id is in ``reps(id)``, but for those within a dense group, and the groups' bitmaps, if there are any."""
    sigs = materialise(signatures(docs, n).join(reps, "id", "left_semi"), "signatures")
    for depth in range(start or first_depth(threshold, target_recall, trees), MIN_DEPTH - 1, -1):
        rows, buckets = prefixes(sigs, depth, trees)  # a shorter prefix finds all that a longer one does
        crowd = maps = None
        large = buckets.where(F.col("n") > BLOCK)
        if not large.isEmpty():
            crowded = materialise(rows.join(large, "key").select("id", F.explode(F.array("first", "last")).alias("leader")), "crowded")
            texts = crowd_texts(crowded, sigs, docs, n, threshold)
            crowd, maps = texts.select("id"), bitmaps(texts)
        pairs = candidates(sigs, rows, buckets, crowd, depth, trees, threshold)
        pairs = materialise(pairs if crowd is None else pairs.union(crowd_pairs(texts, threshold)), "candidates")
        found = verify(pairs, docs, n, threshold)
        if recall_reached(found, depth, trees, target_recall):
            break
    return found, maps


def similar_pairs(docs: DataFrame, reps: DataFrame, n: int, threshold: float, *args, **options) -> DataFrame:
    """``(a, b, jaccard)`` of all links of ``linked``, one by one: in a dense group they grow as its square."""
    found, maps = linked(docs, reps, n, threshold, *args, **options)
    return found if maps is None else found.union(dense_pairs(maps, threshold))


def classes_and_degrees(links: DataFrame, maps: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``roots(id, root)`` and ``degrees(id, n_links)`` of all texts with links.

    Links within dense groups are counted where they are found. For the classes, each text gives one link to another
    class of those found so far, until there is none: at each round half of the classes that still have one go.
    """
    degrees, edges = ends(links).groupBy("id").agg(F.count("*").alias("n_links")), links.select("a", "b")
    if maps is not None:
        dense = materialise(ends(dense_pairs(maps, threshold)).groupBy("id").agg(F.count("*").alias("n_links"), F.min("other").alias("least")), "dense-degrees")
        degrees = degrees.union(dense.select("id", "n_links")).groupBy("id").agg(F.sum("n_links").alias("n_links"))
        edges = edges.union(dense.select("id", "least"))
    while True:
        roots = components(edges)
        if maps is None:
            return roots, degrees
        placed = maps.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        across = ends(dense_pairs(placed, threshold, "a_root <> b_root")).groupBy("id").agg(F.min("other"))
        across = materialise(across, "across")
        if across.isEmpty():
            return roots, degrees
        edges = edges.union(across)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, target_recall: float = 0.98) -> DataFrame:
    """One row per document: ``id, class_id, copy_of, n_copies, n_links, kept``.

    class_id: smallest id of all documents joined, directly or through others, by n-gram Jaccard similarity
    of at least the threshold; copy_of: smallest id with the same word sequence (lower-cased); n_copies: how
    many documents have it; n_links: how many different texts are linked to this one; kept: the document is
    the one of its class that stays, the one with the smallest id.

    Null text counts as empty; empty texts are copies of each other and are linked to nothing else. Texts of
    fewer than n words are one gram. Repeated ids are each reported. A row with a null id is linked by its exact
    words only. No rows give no rows.
    """
    members, classes = text_classes(docs, id_col, text_col)
    words = docs.select(F.col(id_col).alias("id"), words_of(F.lower(text_of(text_col))).alias("w"))
    links, maps = linked(words, classes.select(F.col("rep").alias("id")), n, threshold, target_recall)
    roots, degree = classes_and_degrees(links, maps, threshold)
    per_class = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = materialise(per_class.select("digest", "rep", "n", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "per-class")
    out = lookup(members, per_class, "digest", "n", members.count())
    return out.select(
        F.col("id").alias(id_col), "class_id", F.col("rep").alias("copy_of"), F.col("n").alias("n_copies"), "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each class; same columns. Repeated ids stay together."""
    kept = ngram_join(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    rows = boxed(docs, F.col(id_col).alias("_id")).join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    return unboxed(rows, docs.columns, {})
