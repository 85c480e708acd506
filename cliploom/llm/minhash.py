"""Near-duplicate documents by BagMinHash (operator 6).

A document is the multiset of its shingles (`SHINGLE` words, unchanged). Each shingle carries a Poisson process
over time and weight, split by a hierarchy of weight ranges ([0,1), [1,2), [2,4), ...); a point counts for a
document if its weight cell lies below the shingle's count there, and falls on one of `SIZE` places. A place keeps
its earliest point, so two documents agree on a place with the probability of their weighted Jaccard similarity.
A range's process stops once its time is past the document's slowest place.

Places are banded; documents that agree on a band meet. Equal texts are settled first and count as one node. In
each band the members are held against the most central one (that meets most others, as an original does among its
copies), those that are not similar to it against the most central of the rest, and so on for `PIVOTS` rounds. Then
every pair of a band whose members are in different classes is tested, whether a pivot took them or not, but for pairs
that cannot be similar by their sizes, by the triangle inequality over their distances to the band's pivots, or by
their sketches: each shingle of a multiset turns one of `SKETCH` x 64 bits, so two multisets differ in as many
shingles as bits at least. Every link is verified on the whole multisets:
similarity `LEAST` or more. A class is what links connect, the same as if all pairs of each band had been tested.

A similar pair shares no band with a probability of (1 - LEAST ** ROWS) ** BANDS, 0.00003, or less.

Texts of one to four words have one shingle of all their words; null and empty texts have none, so empty ones are
equal to each other and null ones are classes of their own. Rows are told apart by a number given on reading.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import WordTable, mixed, sizes_of, slices, stash, table
from cliploom.llm.components import components
from cliploom.llm.phrases import rolled

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
SIZE = BANDS * ROWS
#: Rounds of pivots in each band, before all pairs of what is still in different classes.
PIVOTS = 4
#: Words of 64 bits of a sketch.
SKETCH = 16
#: Members of a band that one task holds against the others.
SALT = 512


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle, sorted by both."""
    words = WordTable(texts)
    owner = words.owner
    left = words.first[1:][owner] - np.arange(len(owner))
    at = np.flatnonzero(left >= SHINGLE)
    hashes = rolled(words.codes, words.values, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    owner = owner[at]
    short = [i for i, n in enumerate(np.diff(words.first)) if 0 < n < SHINGLE]
    if short:
        whole = [xxhash.xxh3_64_intdigest(b" ".join(words.words[words.first[i] : words.first[i + 1]])) for i in short]
        owner, hashes = np.r_[owner, short], np.r_[hashes, np.array(whole, np.uint64)]
    by = np.lexsort((hashes, owner))
    return owner[by], hashes[by]


def signatures(owner: np.ndarray, hashes: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """Times of the earliest points: one row of `size` for each text (infinite where a text has no shingle)."""
    earliest = np.full((texts, size), np.inf)
    if not len(owner):
        return earliest
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    weight = np.diff(np.r_[new, len(owner)])
    owner, hashes = owner[new], hashes[new]
    parts, level = [], 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        has = weight > low
        if not has.any():
            break
        seed = mixed(hashes[has] ^ np.uint64(0xA0761D6478BD642F * (level + 1) % (1 << 64)))
        parts.append((owner[has], seed, np.full(has.sum(), max(1, low)), np.full(has.sum(), low), weight[has]))
        level += 1
    doc, seed, span, low, weight = (np.concatenate(x) for x in zip(*parts))
    time, step = np.zeros(len(doc)), 0
    slowest = np.full(texts, np.inf)
    while len(doc):
        step += 1
        with np.errstate(over="ignore"):
            draw = mixed(seed + np.uint64(step) * np.uint64(0xE7037ED1A0B428DB))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)) / span
        going = time < slowest[doc]
        doc, seed, span, low, weight, time, draw = (x[going] for x in (doc, seed, span, low, weight, time, draw))
        more = mixed(draw)
        place = ((more >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        cell = low + (((more & np.uint64(0xFFFFFFFF)) * span.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = cell < weight
        np.minimum.at(earliest, (doc[counts], place[counts]), time[counts])
        slowest = earliest.max(axis=1)
    return earliest


def banded(earliest: np.ndarray) -> np.ndarray:
    """Band hashes of each row."""
    bits = mixed(np.ascontiguousarray(earliest).view(np.uint64)).reshape(len(earliest), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2])
    for k in range(ROWS):
        out = mixed(out ^ bits[:, :, k])
    return out.view(np.int64)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(sizes_of(texts)):
            owner, hashes = shingles(texts[i:j])
            n = np.bincount(owner, minlength=j - i)
            bands = banded(signatures(owner, hashes, j - i))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_no").slice(i, j - i), batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i),
                    pa.array(n), pa.array([list(b) if k else [] for b, k in zip(bands, n)], pa.list_(pa.int64())),
                ],
                names=["row_no", "doc_id", "text_key", "n_shingles", "bands"],
            )


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of each text as a set, where a shingle's k-th occurrence is hashed with k, and its sketch."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(sizes_of(texts)):
            owner, hashes = shingles(texts[i:j])
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(owner)]
            at = np.arange(len(owner))
            nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
            with np.errstate(over="ignore"):
                items = np.where(nth > 0, mixed(hashes ^ (nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))), hashes).view(np.int64)
            cut = np.searchsorted(owner, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").slice(i, j - i), pa.array([items[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int64())),
                    pa.array(list(sketches(owner, items, j - i)), pa.list_(pa.int64())),
                ],
                names=["node", "bag", "sketch"],
            )


def sketches(owner: np.ndarray, items: np.ndarray, texts: int) -> np.ndarray:
    """One row of `SKETCH` words for each text: every item of its set turns one bit."""
    bits = np.zeros((texts, SKETCH * 64), np.bool_)
    place = (mixed(items.view(np.uint64)) >> np.uint64(20)) % np.uint64(SKETCH * 64)
    np.logical_xor.at(bits, (owner, place.astype(np.int64)), True)
    return np.packbits(bits, axis=1).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("text_key"))


class Verifier:
    """Weighted Jaccard similarity of pairs of nodes, each pair once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes
        self.ready = None

    def texts(self, wanted: DataFrame) -> None:
        """Make the multisets of the wanted nodes, one text for each."""
        wanted = wanted.join(self.nodes.select("node", "text_key"), "node")
        found = self.docs.select("text", "text_key").join(wanted, "text_key").dropDuplicates(["text_key"])
        self.ready = stash(found.select("node", "text").mapInArrow(bags, "node long, bag array<long>, sketch array<long>"), "bags")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of pairs (a, b)."""
        left = self.ready.select(F.col("node").alias("a"), F.col("bag").alias("x"))
        right = self.ready.select(F.col("node").alias("b"), F.col("bag").alias("y"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))


def unsettled(members: DataFrame, sizes: DataFrame, ready: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of `members` (node, band, far, root) of one band and different roots that can be similar.

    far: distance to each pivot that the member was held against; -d where it is d at least and not known.
    `sizes` has n for each node, `ready` the sketches.
    """
    mixed_bands = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    members = members.join(mixed_bands.select("band"), "band")
    members = stash(members.join(sizes, "node").join(ready.select("node", "sketch"), "node"), "unsettled")

    salts = members.groupBy("band").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    salted = members.join(salts, "band")
    x = salted.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    y = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    names = ("band", "salt", "node", "far", "root", "n", "sketch")
    x, y = (d.select(*[F.col(c).alias(f"{c}_{e}") for c in names]) for d, e in ((x, "x"), (y, "y")))
    beyond = 1 - least + 1e-9
    high = lambda d: F.when(d >= 0, d).otherwise(1.0)
    close = lambda d, e: d.isNull() | e.isNull() | ((F.abs(d) - high(e) <= beyond) & (F.abs(e) - high(d) <= beyond))
    differ = reduce(Column.__add__, [F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i)))) for i in range(SKETCH)])
    can = (
        (F.col("band_x") == F.col("band_y")) & (F.col("salt_x") == F.col("salt_y")) & (F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y"))
        & (F.least("n_x", "n_y") + 1e-6 >= least * F.greatest("n_x", "n_y"))
        & (differ - 1e-6 <= (1 - least) / (1 + least) * (F.col("n_x") + F.col("n_y")))
        & F.forall(F.zip_with("far_x", "far_y", close), lambda ok: ok)
    )
    return x.join(y, can).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(row_no, doc_id, text_key, class_id, class_key, n_rows, n_links) for each row of `docs` (doc_id, text).

    class_id is the least id in the class, which can be null or the same in several classes; class_key, its least
    text_key, tells classes apart (null for a null text, which is a class of its own). n_links counts the similar
    other texts that the row's text was found with.
    """
    docs = keyed(docs)
    signed = docs.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(
        sign, "row_no long, doc_id long, text_key string, n_shingles long, bands array<long>"
    )
    rows = stash(signed, "signed")
    nodes = stash(rows.where("text_key is not null").groupBy("text_key").agg(F.min("row_no").alias("node"), F.min("n_shingles").alias("n")), "nodes")
    single = rows.join(nodes.select(F.col("node").alias("row_no")), "row_no", "left_semi")
    members = single.select(F.col("row_no").alias("node"), F.explode("bands").alias("band"))

    # each band's most central member comes first: it meets most others, as an original does among its copies
    met = members.join(members.groupBy("band").agg(F.count("*").alias("n_band")).where("n_band > 1"), "band")
    met = stash(met, "met")
    central = met.groupBy("node").agg(F.sum("n_band").alias("weight"))
    left = stash(met.join(central, "node").select("node", "band", F.struct("weight", -F.col("node")).alias("rank")), "members")

    def pivoted(left: DataFrame) -> DataFrame:
        """Members with the most central of their band."""
        pivots = left.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("p"))
        return left.join(pivots.select("band", F.col("p.node").alias("pivot")), "band")

    verifier = Verifier(docs, nodes)
    verifier.texts(central.select("node"))
    sizes = nodes.select("node", "n")
    fit = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs (a, b), each once, whose sizes allow a link."""
        near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
        near = near.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").where(fit).select("a", "b")
        return verifier.similar(near)

    every, held = None, None
    left = left.withColumn("far", F.array().cast("array<double>"))
    for k in range(PIVOTS):
        open_ = pivoted(left)
        pairs = open_.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        tested = stash(verified(pairs), "tested")
        linked = tested.where(F.col("similarity") >= least).select("a", "b")
        every = linked if every is None else every.union(linked)
        tested = tested.union(tested.select("b", "a", "similarity")).toDF("node", "pivot", "similarity")
        known = open_.join(tested, ["node", "pivot"], "left").join(sizes, "node").join(sizes.toDF("pivot", "n_pivot"), "pivot")
        apart = F.coalesce(1 - F.col("similarity"), F.least("n", "n_pivot") / F.greatest("n", "n_pivot") - 1)
        taken = (F.col("node") == F.col("pivot")) | F.coalesce(F.col("similarity") >= least, F.lit(False))
        known = stash(known.select("node", "band", "rank", F.concat("far", F.array(apart)).alias("far"), taken.alias("taken")), "members")
        now = known.where("taken").select("node", "band", "far")
        held = now if held is None else held.union(now)
        left = known.where("not taken").drop("taken")

    links = stash(every.distinct(), "links")
    roots = components(links)
    members = held.union(left.select("node", "band", "far")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stash(members, "held")
    more = stash(verified(unsettled(members, sizes, verifier.ready, least)).where(F.col("similarity") >= least).select("a", "b"), "links")
    if more.limit(1).count():
        links = stash(links.union(more).distinct(), "links")
        roots = components(links)
    degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    known = nodes.join(roots, "node", "left").join(degree, "node", "left").select(
        "text_key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    placed = rows.select("row_no", "doc_id", "text_key").join(known, "text_key", "left").withColumn("root", F.coalesce("root", "row_no"))
    placed = stash(placed.withColumn("n_links", F.coalesce("n_links", F.lit(0))), "placed")
    least_id = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("text_key").alias("class_key"), F.count("*").alias("n_rows"))
    return placed.join(least_id, "root").select("row_no", "doc_id", "text_key", "class_id", "class_key", "n_rows", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_key", "n_rows", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id. Rows alike in id and text are one document."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = classes(docs).where("class_key is not null").groupBy("class_key").agg(first.alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    rows = docs.select(F.struct("*").alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(kept["kept_id"]) & (F.md5("whole.text") == kept["kept_key"])
    found = rows.join(kept, same).dropDuplicates(["kept_id", "kept_key"]).select("whole.*")
    return found.unionByName(docs.where("text is null"))
