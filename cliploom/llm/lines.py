"""Line dedup by a segment-partition edit join (operator 9).

Lines (without white space at the ends) that are equal, or within the edits that their length allows, are linked;
linked lines form classes. The first line of a class (least doc_id, then text, then line number) stays, all others of
the class go. Lines without a character but white space stay. A line of n characters may differ by
min(`MOST_EDITS`, n // `CHARS_PER_EDIT`) edits; of two lines the shorter one counts. Short lines thus match when equal.

Two lines within e edits: if one is cut into e + 1 segments, the other holds one of them whole, near its place.
Every line is indexed by its segments (key: length, segment number, content), and probes the indexes of its own and
slightly smaller lengths with the substrings that may hold a segment. Keys of one line only are given up at once.
What meets is verified on the lines' texts by a banded bit-parallel automaton, after equal ends are cut off.

A key that many lines share makes no pairs of all of them: its members are held against the most central one, those
that are not similar to it against the most central of the rest, for `CENTRES` rounds; then members of one key that
are still in different classes are tested. Pairs are passed over only if their classes are the same or their letter
counts differ by more than the edits can change, so the classes are those of testing all pairs of each key.

Null and empty texts have no lines that count. A null id comes before all others; documents with one id and different
texts are told apart by their texts. Rows alike in id and text are one document and share its lines' fate. A line that
a third of all rows share is one node of the join; it is counted in parts before a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import mixed, sizes_of, slices, stash, table
from cliploom.llm.components import components

MOST_EDITS = 2
CHARS_PER_EDIT = 20
SPACE = " \t\r\v\f"
#: Characters hashed at a time inside a task (a longer line is taken alone).
CHUNK = 1 << 20
#: Rounds of central lines in each key, before pairs of what is still in different classes.
CENTRES = 3
#: Members of a key that one task holds against the others.
SALT = 512
#: Rows that are broadcast at most (shared keys, candidate lines, first lines); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of characters of the letter counts, and counts told apart of each.
KINDS, COUNTS = 32, 256


def budget(n):
    """Edits that a line of `n` characters (a number or an array) may differ by."""
    return np.minimum(n // CHARS_PER_EDIT, MOST_EDITS)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** n modulo 2 ** 64."""
    steps = np.full(n + 1, BASE)
    steps[0] = 1
    return np.cumprod(steps)


@lru_cache(maxsize=1)
def letter_bits() -> np.ndarray:
    """Row k, column n: the bits of n characters of kind k. One character more turns one bit."""
    one = np.uint64(1) << (mixed(np.arange(KINDS * COUNTS, dtype=np.uint64)) % np.uint64(64))
    table_ = one.reshape(KINDS, COUNTS).copy()
    table_[:, 0] = 0
    return np.bitwise_xor.accumulate(table_, axis=1)


def letters(chars: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A sketch of each line's letter counts: two lines differ in as many letters as bits at least."""
    counts = np.bincount(owner * KINDS + (chars & (KINDS - 1)), minlength=n * KINDS).reshape(n, KINDS)
    bits = letter_bits()[np.arange(KINDS), np.minimum(counts, COUNTS - 1)]
    return np.bitwise_xor.reduce(bits, axis=1)


def keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) of all keys of `lines`, by line, each once; then the letter sketch of each line.

    A key's last bit tells whether the line is indexed under it (1) or only looks there (0); the others name it.
    """
    size = np.array(list(map(len, lines)), np.int64)
    start = np.r_[0, np.cumsum(size)][:-1]
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.int64)
    sketch = letters(chars, np.repeat(np.arange(len(lines)), size), len(lines))
    found_lines, found_keys = [], []
    with np.errstate(over="ignore"):
        power = powers(len(chars))
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(chars), np.uint64(pow(int(BASE), -1, 1 << 64)))])
        sums = np.r_[np.uint64(0), np.cumsum(mixed(chars.astype(np.uint64)) * inverse[:-1])]
        for more in range(MOST_EDITS + 1):
            other = size - more
            for edits in range(max(1, more), MOST_EDITS + 1):
                at = np.flatnonzero((other > 0) & (budget(other) == edits))
                if not len(at):
                    continue
                n, begin = other[at], start[at]
                short, longer = np.divmod(n, edits + 1)
                for i in range(edits + 1):
                    place = i * short + np.maximum(0, i - (edits + 1 - longer))
                    width = short + (i >= edits + 1 - longer)
                    low = np.maximum(np.maximum(0, place - i), place + more - (edits - i))
                    high = np.minimum(np.minimum(size[at] - width, place + i), place + more + (edits - i))
                    for shift in range(2 * edits + 1):
                        good = low + shift <= high
                        p = (low + shift)[good]
                        a = begin[good] + p
                        content = (sums[a + width[good]] - sums[a]) * power[a]
                        key = mixed(mixed(content) ^ (n[good].astype(np.uint64) << np.uint64(2)) ^ np.uint64(i))
                        own = (p == place[good]) & (more == 0)
                        found_lines.append(at[good])
                        found_keys.append((key & ~np.uint64(1)) | own.astype(np.uint64))
    if not found_keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sketch.view(np.int64)
    line, key = np.concatenate(found_lines), np.concatenate(found_keys)
    by = np.lexsort((key, line))
    line, key = line[by], key[by]
    # of two equal keys the indexed one comes last
    last = np.r_[(line[1:] != line[:-1]) | ((key[1:] ^ key[:-1]) > 1), True]
    return line[last], key[last].view(np.int64), sketch.view(np.int64)


def within(s: str, t: str, edits: int = MOST_EDITS) -> bool:
    """Whether `edits` insertions, deletions and substitutions turn s into t.

    Level d of the automaton is a word with a bit for each diagonal of the band that d edits reach.
    """
    if abs(len(s) - len(t)) > edits:
        return False
    a, end = 0, min(len(s), len(t))
    while a < end and s[a] == t[a]:
        a += 1
    b = 0
    while b < end - a and s[-1 - b] == t[-1 - b]:
        b += 1
    s, t = s[a : len(s) - b], t[a : len(t) - b]
    band, n = (1 << (2 * edits + 1)) - 1, len(t)
    levels = [(1 << edits) << d & band for d in range(edits + 1)]
    for d in range(1, edits + 1):
        levels[d] |= levels[d - 1]
    for i, c in enumerate(s):
        match = 0
        for k in range(2 * edits + 1):
            j = i + k - edits
            if 0 <= j < n and t[j] == c:
                match |= 1 << k
        before, levels = levels, [levels[0] & match]
        for d in range(1, edits + 1):
            x = (before[d] & match) | before[d - 1] | (before[d - 1] >> 1) | (levels[d - 1] << 1)
            levels.append(x & band)
        if not levels[-1]:
            return False
    at = n - len(s) + edits
    return bool(levels[-1] >> at & 1)


def alike(s: str, t: str) -> bool:
    return within(s, t, int(budget(min(len(s), len(t)))))


READ = "doc_id long, text_key long, line_no int, line binary, edits byte, letters long, keys array<long>"


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, checksum, letter sketch and keys of each line that counts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(sizes_of(texts)):
            split = [[x.strip(SPACE) for x in t.split("\n")] if t else [] for t in texts[i:j]]
            sizes = list(map(len, split))
            row, number = np.repeat(np.arange(i, j), sizes), np.concatenate([np.arange(n) for n in sizes])
            flat = [x for part in split for x in part]
            some = np.flatnonzero(np.array(list(map(len, flat)), np.int64) > 0)
            lines = [flat[k] for k in some]
            for a, b in slices(sizes_of(lines), CHUNK):
                part, at = lines[a:b], some[a:b]
                owner, found, sketch = keys(part)
                offsets = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
                rows = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(number[at].astype(np.int32)),
                        pa.array([hashlib.md5(x.encode("utf-8")).digest() for x in part], pa.binary()),
                        pa.array(budget(np.array(list(map(len, part)))).astype(np.int8)), pa.array(sketch),
                        pa.ListArray.from_arrays(offsets, pa.array(found)),
                    ],
                    names=["doc_id", "text_key", "line_no", "line", "edits", "letters", "keys"],
                )


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [alike(s, t) for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has BROADCAST_ROWS rows or less."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def meeting(lines: DataFrame) -> DataFrame:
    """(key, short, own, edits, letters) of the lines of keys that two lines have, one of them indexed there.

    Lines go by a short number. Equal lines fall together on the map side, before any row moves.
    """
    found = lines.where("edits > 0").select(F.xxhash64("line").alias("short"), "edits", "letters", F.explode("keys").alias("k"))
    found = found.select(F.shiftright("k", 1).alias("key"), "short", F.col("k").bitwiseAND(F.lit(1)).alias("own"), "edits", "letters")
    shared = found.groupBy("key").agg(F.min("short").alias("a"), F.max("short").alias("b"), F.max("own").alias("own"))
    shared = stash(shared.where("a < b and own = 1").select("key"), "keys")
    return stash(found.join(small(shared), "key", "left_semi").distinct(), "meeting")


def bodies(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(short, line, body) of the lines of `members`; two lines can share a short number."""
    wanted = small(stash(members.select("short").distinct(), "wanted"))
    texts = docs.select(F.explode(F.split("text", "\n")).alias("body")).select(F.btrim("body", F.lit(SPACE)).alias("body"))
    texts = texts.where(F.length("body") >= CHARS_PER_EDIT).select(F.unhex(F.md5("body")).alias("line"), "body").withColumn("short", F.xxhash64("line"))
    return stash(texts.join(wanted, "short", "left_semi").dropDuplicates(["line"]), "bodies")


#: Whether the letter counts of x and y allow that they are within the edits of the indexed one.
ALLOWED = "bit_count(letters_x ^ letters_y) <= 2 * {edits}"


def similar(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (a, b) of lines (by their checksums) that connect what the links of all pairs would connect."""
    members = meeting(lines)
    texts = bodies(docs, members)
    left, right = texts.toDF("x", "a", "s"), texts.toDF("y", "b", "t")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (x, y) of short numbers."""
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        both = pairs.join(left, "x").join(right, "y").select("a", "b", "s", "t")
        return stash(both.mapInArrow(verify, "a binary, b binary"), "links")

    weight = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("short").agg(F.sum("n").alias("weight"))
    open_ = stash(members.join(weight, "short"), "open")
    links = None
    for _ in range(CENTRES):
        rank = F.struct("weight", F.col("short").alias("x"), F.col("edits").alias("edits_x"), F.col("letters").alias("letters_x"))
        centres = open_.where("own = 1").groupBy("key").agg(F.max(rank).alias("c")).select("key", "c.*").drop("weight")
        held = stash(open_.join(centres, "key").withColumnRenamed("letters", "letters_y"), "held")
        now = verified(held.where("short != x").where(ALLOWED.format(edits="edits_x")).select("x", F.col("short").alias("y")))
        links = now if links is None else links.union(now)
        taken = now.union(now.select("b", "a")).select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("short"))
        rest = held.where("short != x").join(taken, ["x", "short"], "left_anti")
        open_ = stash(rest.select("key", "short", "own", "edits", F.col("letters_y").alias("letters"), "weight"), "open")
    links = stash(links.distinct(), "links")
    roots = components(links)
    more = verified(unsettled(members, roots))
    return stash(links.union(more).distinct(), "links") if more.limit(1).count() else links


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (x, y) of members of one key that are in different classes and can be similar.

    A key's members are dealt out by a salt, so that no task holds all pairs of a large key.
    """
    members = members.join(roots.select(F.xxhash64("node").alias("short"), F.xxhash64("root").alias("root")), "short", "left")
    members = members.withColumn("root", F.coalesce("root", "short"))
    members = stash(members, "members")
    mixed_keys = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = members.join(mixed_keys.where("low < high").select("key", "salts"), "key")
    x = members.where("own = 1").withColumn("salt", F.pmod(F.xxhash64("short"), "salts").cast("int"))
    y = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    x = x.select("key", "salt", F.col("short").alias("x"), F.col("root").alias("root_x"), F.col("letters").alias("letters_x"), F.col("edits").alias("edits_x"))
    y = y.select(F.col("key").alias("key_y"), F.col("salt").alias("salt_y"), F.col("short").alias("y"), F.col("root").alias("root_y"), F.col("letters").alias("letters_y"))
    can = (F.col("key") == F.col("key_y")) & (F.col("salt") == F.col("salt_y")) & (F.col("root_x") != F.col("root_y"))
    return x.join(y, can & F.expr(ALLOWED.format(edits="edits_x"))).select("x", "y").distinct()


def drops(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text_key) with a line of a class of two lines or more.

    gone: its line numbers that go; n_linked: how many other lines, of all rows, its lines share a class with;
    first_ids: the documents whose lines stay for those that go.
    """
    docs = keyed(docs)
    lines = stash(docs.mapInArrow(read, READ), "lines")
    roots = small(stash(components(similar(docs, lines)), "roots"))
    placed = lines.select("doc_id", "text_key", "line_no", "line").join(roots.withColumnRenamed("node", "line"), "line", "left")
    placed = stash(placed.select("doc_id", "text_key", "line_no", F.coalesce("root", "line").alias("root")), "placed")
    order = F.struct("doc_id", "text_key", "line_no")
    first = placed.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = placed.join(small(stash(first, "first")), "root")
    mine = F.collect_set(F.struct("line_no", "first", "n", (order != F.col("first")).alias("goes"))).alias("mine")
    found = found.groupBy("doc_id", "text_key").agg(mine)
    going = F.filter("mine", lambda x: x["goes"])
    return found.select(
        "doc_id", "text_key", F.sort_array(F.transform(going, lambda x: x["line_no"])).alias("gone"),
        F.aggregate("mine", F.lit(0).cast("long"), lambda n, x: n + x["n"] - 1).alias("n_linked"),
        F.array_distinct(F.transform(going, lambda x: x["first"]["doc_id"])).alias("first_ids"),
    )


def with_drops(docs: DataFrame) -> DataFrame:
    """Each row of `docs` in a struct `whole`, with what drops() has for it (null where that is nothing)."""
    found = drops(docs)
    rows = docs.select(F.struct("*").alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64("whole.text") == found["text_key"])
    return rows.join(found, same, "left").select("whole", "gone", "n_linked", "first_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, those that go, and the first document that holds one of its classes' lines."""
    rows = with_drops(table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc_id = F.col("whole.doc_id").cast("long")
    none = F.array().cast("array<int>")
    return rows.select(
        doc_id.alias("doc_id"), F.size(F.split(F.coalesce("whole.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_min("first_ids"), doc_id).alias("class_id"),
        F.array_join(F.coalesce("gone", none), ",").alias("dropped_lines"), F.array_sort(F.coalesce("first_ids", F.array().cast("array<long>"))).alias("first_ids"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that go; n_chars follows where there is such a column."""
    rows = with_drops(docs)
    left = F.array_join(F.filter(F.split("whole.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("whole.text"))
    rows = rows.withColumn("whole", F.col("whole").withField("text", text))
    if "n_chars" in docs.columns:
        count = F.when(F.size("gone") > 0, F.length("whole.text").cast("long")).otherwise(F.col("whole.n_chars"))
        rows = rows.withColumn("whole", F.col("whole").withField("n_chars", count))
    return rows.select("whole.*")
