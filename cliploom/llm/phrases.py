"""Substring dedup by repeated-phrase automata (operator 5).

A word goes if a window of `WINDOW` words around it also starts in a document with a smaller id.

1. Every text is read once: its words, their checksum, and its anchors (hashes of `ANCHOR` words, the least of
   each window, so every window holds one and equal windows hold equal ones). Documents whose words are those of
   a document with a smaller id are settled here: every window of theirs recurs.
2. Anchors in two documents or more mark candidate windows; these are hashed, and windows in two documents or more
   are confirmed as recurring, with the first document that has them. Their runs in that document are passages.
3. Documents go to shards with the passages of their first documents. A shard compiles an Aho-Corasick automaton
   (words as symbols) from blocks of `BLOCK` words at every WINDOW - BLOCK + 1 places of its passages: every window
   holds one. The shard's documents are streamed through it; each hit is extended word by word, and an agreeing
   run of a window or more is removed. Removal rests on equal words, never on a hash.

Null and empty texts have no words and lose none. A null id is neither first nor has a first: its text stays.
Rows with one id are one document: the windows of each of its texts start in it, and repeated rows each give a row. An anchor, window or passage that a third of
all documents share is counted in parts before the shuffle, and sent once to each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import WordTable, sizes_of, slices, stash, table, words_of

WINDOW = 50
ANCHOR = 12
BLOCK = 25
#: Bytes of text that a shard's automaton is compiled for, about.
SHARD_BYTES = 6 << 20
ODD = 0x9E3779B97F4A7C15
NONE = hashlib.sha256(b"").hexdigest()


def rolled(codes: np.ndarray, values: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of `width` words from each place on (wraps around at the end; callers know where that is)."""
    own = np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64)[codes]
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        step, done, power = own.copy(), 0, np.uint64(ODD)
        size = 1  # step covers `size` words; `power` is the base to that many
        while True:
            if width & size:
                out = out * power + np.roll(step, -done)
                done += size
            if done == width:
                break
            step = step * power + np.roll(step, -size)
            power *= power
            size *= 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of `width` values from each place on, as far as there are any."""
    out, size = x.copy(), 1
    while size < width:
        step = min(size, width - size)
        out[:-step] = best(out[:-step], out[step:].copy())
        size += step
    return out


def anchors(words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: in every window of WINDOW words, all that have the least hash."""
    n = len(words.codes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = words.first[1:][words.owner] - np.arange(n)
    hashes = rolled(words.codes, words.values, ANCHOR)
    span = WINDOW - ANCHOR + 1
    least = sliding(hashes, span)
    least[left < WINDOW] = 0
    greatest = sliding(np.r_[np.zeros(span - 1, np.uint64), least], span, np.maximum)[:n]
    places = np.flatnonzero((greatest == hashes) & (left >= ANCHOR) & (greatest > 0))
    return places, hashes[places]


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, checksum of the words, and distinct anchors of each text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(sizes_of(texts)):
            words = WordTable(texts[i:j])
            places, hashes = anchors(words)
            cut = np.searchsorted(places, words.first)
            found = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:])]
            sums = [hashlib.sha256(b" ".join(words.words[a:b])).hexdigest() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(np.diff(words.first)),
                    pa.array(sums, pa.string()), pa.array(found, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_words", "words_sha256", "anchors"],
            )


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and places of the windows that hold one of the row's `wanted` anchors."""
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
        texts, wanted = batch.column("text").to_pylist(), batch.column("wanted")
        for i, j in slices(sizes_of(texts), 1 << 20):
            words = WordTable(texts[i:j])
            places, hashes = anchors(words)
            cut = np.searchsorted(places, words.first)
            mark = np.zeros(len(words.codes) + 1, np.int64)
            for k in range(j - i):
                mine = places[cut[k] : cut[k + 1]]
                good = mine[np.isin(hashes[cut[k] : cut[k + 1]], np.array(wanted[i + k].as_py(), np.int64).view(np.uint64))]
                np.add.at(mark, np.maximum(good - (WINDOW - ANCHOR), words.first[k]), 1)
                np.add.at(mark, good + 1, -1)
            owner = words.owner
            left = words.first[1:][owner] - np.arange(len(owner))
            starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (left >= WINDOW))
            if len(starts):
                whole = rolled(words.codes, words.values, WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][owner[starts]]), pa.array(keys[i:j][owner[starts]]), pa.array((starts - words.first[owner[starts]]).astype(np.int32)), pa.array(whole[starts].view(np.int64))],
                    names=["doc_id", "text_key", "place", "window"],
                )


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each run of recurring windows in its first document."""
    for batch in batches:
        firsts, out = batch.column("first_id").to_pylist(), []
        for first, text, runs in zip(firsts, batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = words_of(text)
            out += [(first, b" ".join(words[r["a"] : r["b"] + WINDOW]).decode("utf-8")) for r in runs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["first_id", "passage"]
        )


class Automaton:
    """Aho-Corasick automaton over words, from blocks of passages, that removes what windows of passages cover."""

    def __init__(self, sources: list[tuple[int, str]]):
        import ahocorasick

        self.codes: dict[bytes, int] = {}
        self.passages: list[tuple[int, list[int]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for first, passage in sources:
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(passage)]
            for at in range(0, len(words) - BLOCK + 1, WINDOW - BLOCK + 1):
                blocks.setdefault(tuple(words[at : at + BLOCK]), []).append((len(self.passages), at))
            self.passages.append((first, words))
        for key, places in blocks.items():
            self.automaton.add_word(key, places)
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window that a passage of an earlier document holds."""
        gone = np.zeros(len(words), bool)
        if self.empty or len(words) < WINDOW:
            return gone
        text = tuple(self.codes.get(w, 0) for w in words)
        n = len(text)
        for end, places in self.automaton.iter(text):
            start, end = end - BLOCK + 1, end + 1
            if gone[max(0, start - WINDOW) : end + WINDOW].all():
                continue
            for k, at in places:
                first, passage = self.passages[k]
                if first >= doc_id:
                    continue
                a, p = start, at
                while a > 0 and p > 0 and text[a - 1] == passage[p - 1]:
                    a, p = a - 1, p - 1
                b, p = end, at + BLOCK
                while b < n and p < len(passage) and text[b] == passage[p]:
                    b, p = b + 1, p + 1
                if b - a >= WINDOW:
                    gone[a:b] = True
        return gone


def stream(docs: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """The documents of one shard, streamed through the automaton of its passages."""
    automaton = Automaton(list(zip(sources["first_id"], sources["passage"])))
    out = []
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        words = words_of(text)
        gone = automaton.covered(doc_id, words)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc_id, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): words, removed words, checksum of the kept ones and, on wish, their text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = stash(docs.mapInArrow(read, "doc_id long, text_key long, n_words long, words_sha256 string, anchors array<long>"), "anchors")

    # whole texts whose words a smaller id has
    firsts = rows.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    later = firsts.where("last_id > first_id").select("words_sha256", "first_id")
    marked = rows.join(later, "words_sha256", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id")
    marked = stash(marked, "marked")

    # recurring anchors, by document
    held = marked.where(~F.col("copy") & F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    wanted = held.join(shared, "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("wanted"))
    taking = stash(docs.join(wanted, ["doc_id", "text_key"]), "texts")

    # recurring windows, their first documents, and the runs they make there
    seen = taking.select("doc_id", "text_key", "text", "wanted").mapInArrow(windows, "doc_id long, text_key long, place int, window long")
    first = seen.groupBy("window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("window", "first_id")
    linked = stash(
        seen.join(first, "window")
        .select("doc_id", "first_id", *(F.when(F.col("doc_id") == F.col("first_id"), F.col(c)).alias(c) for c in ("text_key", "place")))
        .distinct(),
        "links",
    )
    in_order = Window.partitionBy("first_id", "text_key").orderBy("place")
    fresh = (F.col("place") - F.lag("place").over(in_order) > WINDOW).cast("int")
    runs = linked.where("place is not null").select("first_id", "text_key", "place", fresh.alias("fresh"))
    runs = runs.withColumn("run", F.sum(F.coalesce("fresh", F.lit(1))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("first_id", "text_key", "run").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    runs = runs.groupBy("first_id", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    texts_of = taking.select(F.col("doc_id").alias("first_id"), "text_key", "text").dropDuplicates(["first_id", "text_key"])
    sources = texts_of.join(runs, ["first_id", "text_key"]).select("first_id", "text", "runs")
    sources = stash(sources.mapInArrow(passages, "first_id long, passage string"), "passages")

    # shards of documents, each with the passages of their first documents
    pairs = linked.where("doc_id > first_id").select("doc_id", "first_id").distinct()
    affected = stash(taking.select("doc_id", "text_key", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "affected")
    size = affected.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    needed = pairs.select(shard, "first_id").distinct().join(sources, "first_id")
    cleaned = (
        affected.select(shard, "doc_id", "text").groupBy("shard").cogroup(needed.groupBy("shard"))
        .applyInPandas(stream, "doc_id long, n_words long, n_removed long, kept string")
        .withColumn("kept_sha256", F.sha2("kept", 256))
    )
    done = affected.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    untouched = marked.join(done, marked["doc_id"].eqNullSafe(done["d"]) & (marked["text_key"] == done["k"]), "left_anti")
    whole = untouched.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(NONE)).otherwise(F.col("words_sha256")).alias("kept_sha256"),
    )
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return whole.select(columns).unionByName(cleaned.select(columns))


#: Words by RE2's own white space cannot be used: it knows other characters than the six.
ORACLE_SQL = """
with words as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), places as (
    select doc_id, w, unnest(range(1, len(w) - 48)) as p from words where len(w) >= 50
), windows as (
    select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from places
), firsts as (
    select h, min(doc_id) as f from windows group by h
), gone as (
    select distinct doc_id, unnest(range(p, p + 50)) as i from windows join firsts using (h) where f < doc_id
), dropped as (
    select doc_id, list(i) as d from gone group by doc_id
), kept as (
    select words.doc_id, len(w) as n_words, coalesce(len(d), 0) as n_removed,
        list_filter(w, lambda x, i: d is null or not list_contains(d, i)) as k
    from words left join dropped using (doc_id)
)
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
