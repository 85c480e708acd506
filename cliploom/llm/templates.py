"""Benchmark decontamination by template canonicalisation (operator 7); DataFrame functions only.

Numbers, names and units become typed placeholders, so a question asked again with other values has the same
template. Windows of `WIDTH` template words at every place of the benchmark and of every document are hash-joined; a
window with fewer than `LEAST_PLAIN` words that are no placeholders says little and is joined by its own words
instead. Items of fewer words are joined by windows of their own length. A document and an item that meet are laid
side by side at every offset at which they met: the item's words that lie in agreeing runs of WIDTH template words
(all of a shorter item) are counted, and each slot in these runs (a placeholder's own words) must have one value
throughout in the document.

A pair is a leak if at some offset `LEAST_WORDS` words agree so (all, in a shorter item), which is `LEAST_SHARE` of
the item at least or holds LEAST_WORDS words that are no placeholders, and the slots are consistent.

Null and empty texts hold nothing and leak nothing. Rows are told apart by id and text, so repeated rows share
their verdict; so do repeated items. An empty benchmark gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import stash, table

#: Words of a window, a power of two.
WIDTH = 8
LEAST_WORDS = 11
LEAST_SHARE = 0.5
LEAST_PLAIN = 4
#: Rows that are broadcast at most, of benchmark windows and of pairs; more are joined by a shuffle.
BROADCAST_WINDOWS = 400_000
BROADCAST_PAIRS = 50_000
SPACE = " \t\n\x0b\f\r"
#: Fixed units of measure, as words of their own after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs ms day days week weeks month months year years kb mb gb tb hz khz mhz w kw v a pa k mph kmh usd eur gbp dollars euros percent degrees"


def plain(text: Column) -> Column:
    """The text's words between single spaces, without '#', which marks placeholders, and without words that hold neither letter nor digit."""
    text = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "#", " "))
    return F.btrim(F.regexp_replace(text, r"\s+(?:[^\p{L}0-9\s]++(?:\s+|$))*", " "))


def template(text: Column) -> Column:
    """The template of a plain() text, word for word. Every capitalised word counts as a name."""
    num = F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "#num")
    num = F.regexp_replace(num, rf"(?i)(?<=#num )(?:{'|'.join(UNITS.split())})(?=[.,;:!?)]*(?: |$))", "#unit")
    text = F.when(text.rlike("[0-9]"), num).otherwise(text)
    text = F.regexp_replace(text, r"(?<!\S)[^\p{L} ]*+\p{Lu}\S*+", "#name")
    return F.lower(F.regexp_replace(text, r"[^\p{L}# ]+", ""))


def words_of(text: Column) -> Column:
    return F.split(text, " ")


def is_plain(word: Column) -> Column:
    return ~F.startswith(word, F.lit("#"))


def shifted(a: Column, by: int) -> Column:
    """The array without its first `by` elements."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def combined(a: Column, b: Column, by: int) -> Column:
    """From windows at every place, and others to follow `by` places on, the windows of both."""
    rest = shifted(b, by)
    one = lambda x, y: F.shiftleft(F.xxhash64(x, y), 4) + x.bitwiseAND(F.lit(15)) + y.bitwiseAND(F.lit(15))
    return F.zip_with(F.slice(a, F.lit(1), F.size(rest)), rest, one)


def telling(hashes: Column, width: int) -> Column:
    """The window hashes, those of the own words where a window has too few plain words."""
    own = lambda i: F.xxhash64(F.array_join(F.slice("raw", i + 1, F.lit(width)), " "))
    return F.transform(hashes, lambda h, i: F.when(h.bitwiseAND(F.lit(15)) >= min(LEAST_PLAIN, width), h).otherwise(own(i)))


def windows(rows: DataFrame, widths: list[int], *columns: str) -> DataFrame:
    """(columns, wide, at, window) of the windows of each of `widths` words at every place of rows with `p`, a plain() text.

    A hash's last four bits count its plain words; sums of doubled windows give all lengths. The outer explodes keep
    Spark from putting a filter with the whole window expression below each of them.
    """
    codes = F.transform("words", lambda w: F.shiftleft(F.xxhash64(w), 4) + is_plain(w).cast("long"))
    rows = rows.select(*columns, words_of(F.col("p")).alias("raw"), words_of(template(F.col("p"))).alias("words")).withColumn("w1", codes)
    size = 1
    while size * 2 <= max(widths):
        rows = rows.withColumn(f"w{2 * size}", combined(F.col(f"w{size}"), F.col(f"w{size}"), size))
        size *= 2
    found = []
    for width in widths:
        parts = [1 << k for k in range(width.bit_length() - 1, -1, -1) if width >> k & 1]
        name, done = f"w{parts[0]}", parts[0]
        for part in parts[1:]:
            rows = rows.withColumn(f"x{width}_{part}", combined(F.col(name), F.col(f"w{part}"), done))
            name, done = f"x{width}_{part}", done + part
        found.append(telling(F.col(name), width))
    rows = rows.select(*columns, F.array(*found).alias("listed"))
    rows = rows.select(*columns, F.posexplode_outer("listed").alias("wide", "w"))
    return rows.select(*columns, "wide", F.posexplode_outer("w").alias("at", "window"))


def prepare(benchmark: DataFrame) -> DataFrame:
    """Items with their own and template words, and a number."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("p")).dropDuplicates().where("p <> ''")
    items = items.select("item_id", "p", words_of(F.col("p")).alias("raw"), words_of(template(F.col("p"))).alias("words"))
    return stash(items.withColumn("item_no", F.monotonically_increasing_id()), "items")


def meet(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_no, shift) of documents and items with a window in common, at every offset."""
    short = [r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < WIDTH).distinct().collect()]
    widths = [WIDTH, *sorted(short)]
    mine = F.array_position(F.array(*map(F.lit, widths)), F.least(F.size("words"), F.lit(WIDTH))) - 1
    theirs = windows(items.withColumn("mine", mine), widths, "item_no", "mine").where("wide = mine")
    theirs = theirs.select("item_no", "wide", "window", F.col("at").alias("item_at"))
    if theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        theirs = F.broadcast(theirs)
    ours = windows(docs.select("doc_id", "text_key", plain(F.col("text")).alias("p")), widths, "doc_id", "text_key")
    return ours.join(theirs, ["wide", "window"]).select("doc_id", "text_key", "item_no", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def with_runs(rows: DataFrame) -> DataFrame:
    """Adds `runs` to rows with `same` (what agrees): what lies in runs of WIDTH at least; all that agrees of fewer than WIDTH.

    Each step is a column of its own, as Spark writes out an expression wherever it is used.
    """
    step, last = 1, "same"
    while step < WIDTH:
        both = F.zip_with(last, shifted(F.col(last), step), lambda x, y: x & F.coalesce(y, F.lit(False)))
        last = f"all{2 * step}"
        rows = rows.withColumn(last, both)
        step *= 2
    for step in (1 << k for k in range(WIDTH.bit_length() - 1)):
        before = F.slice(F.concat(F.array_repeat(F.lit(False), step), F.col(last)), F.lit(1), F.size(last))
        either = F.zip_with(last, before, lambda x, y: x | y)
        last = f"any{2 * step}"
        rows = rows.withColumn(last, either)
    return rows.withColumn("runs", F.when(F.size("same") < WIDTH, F.col("same")).otherwise(F.col(last)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaked pairs of `docs` (doc_id, text) and `benchmark` (item_id, text), with what agrees at the best offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    items = prepare(benchmark)
    pairs = stash(meet(docs, items), "pairs")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    same = (docs["doc_id"].eqNullSafe(pairs["doc_id"])) & (docs["text_key"] == pairs["text_key"])
    both = docs if few else docs.dropDuplicates(["doc_id", "text_key"])
    both = both.join(F.broadcast(pairs) if few else pairs, same).select(docs["doc_id"], docs["text_key"], "item_no", "shift", plain(F.col("text")).alias("p"))
    both = both.select("doc_id", "text_key", "item_no", "shift", words_of(F.col("p")).alias("their_raw"), words_of(template(F.col("p"))).alias("theirs"))
    both = both.join(items, "item_no")
    side = lambda w, i: F.struct(
        w.alias("w"), F.get("raw", i).alias("r"),
        F.when(i + F.col("shift") >= 0, F.get("theirs", i + F.col("shift"))).alias("v"),
        F.when(i + F.col("shift") >= 0, F.get("their_raw", i + F.col("shift"))).alias("q"),
    )
    laid = both.select("doc_id", "text_key", "item_id", "shift", F.transform("words", side).alias("laid"))
    laid = laid.withColumn("same", F.transform("laid", lambda x: F.coalesce(x["w"] == x["v"], F.lit(False))))
    agree = with_runs(laid).select("doc_id", "text_key", "item_id", "shift", F.size("laid").cast("long").alias("n_item"), F.filter("laid", lambda x, i: F.get("runs", i)).alias("agree"))
    bare = lambda c: F.regexp_replace(c, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
    slots = F.filter("agree", lambda x: ~is_plain(x["w"]))
    measured = agree.select(
        "doc_id", "text_key", "item_id", "shift", "n_item", F.size("agree").cast("long").alias("n_same"),
        F.size(F.filter("agree", lambda x: is_plain(x["w"]))).cast("long").alias("n_plain"),
        F.array_distinct(F.transform(slots, lambda x: F.struct(bare(x["r"]).alias("r"), bare(x["q"]).alias("q")))).alias("slots"),
    )
    values = F.size(F.array_distinct(F.transform("slots", lambda x: x["r"])))
    changed = F.size(F.filter("slots", lambda x: x["r"] != x["q"])).cast("long")
    measured = measured.withColumn("consistent", values == F.size("slots")).withColumn("n_changed", changed).drop("slots")
    measured = stash(measured, "measured")  # else the filter below would be written out again on the texts
    enough = F.col("n_same") >= F.least(F.lit(LEAST_WORDS), F.col("n_item"))
    much = (F.col("n_same") >= LEAST_SHARE * F.col("n_item")) | (F.col("n_plain") >= LEAST_WORDS)
    names = ("n_item", "n_same", "n_plain", "n_changed")
    best = F.max_by(F.struct(*names), F.struct("n_same", "n_plain", -F.col("n_changed"), -F.col("shift"))).alias("best")
    leaked = measured.where(enough & much & F.col("consistent")).groupBy("doc_id", "text_key", "item_id").agg(best)
    return leaked.select("doc_id", "text_key", "item_id", "best.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item leaks."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    found = stash(found.select(F.col("doc_id").alias("leaked_id"), F.col("text_key").alias("leaked_key")), "leaked")
    few = found.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    same = docs["doc_id"].cast("long").eqNullSafe(found["leaked_id"]) & (F.xxhash64(docs["text"]) == found["leaked_key"])
    return docs.join(F.broadcast(found) if few else found, same, "left_anti")
