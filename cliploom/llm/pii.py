"""Personal data by bootstrapped contextual extraction (operator 3); DataFrame functions only.

Four fixed patterns find e-mail addresses, IPs, payment cards and phone numbers. These spans are the seeds. The one,
two and three words to the left of a span and the word to its right are its lexical patterns. Patterns and the
strings that stand at them form a graph, which is scored in rounds: a pattern's score is the summed confidence of
its strings over all occurrences of its words in the corpus, and a string that is not a seed gets the score of its
best accepted pattern. A pattern is accepted with `SUPPORT` different confident strings and a score of
`LEAST_SCORE`. Rounds go on until one accepts no new pattern; confidences only rise, so they end. What looks like an
identifier (`DIGITS` digits or more, `LEAST_CHARS` characters) at an accepted pattern and overlaps no seed is a new
span of kind "found". Words of a pattern lie between a span and its neighbours of the same kind.

Null text counts as empty. Rows are told apart by a number given on reading, so repeated rows and null ids do no
harm. A pattern at which a third of all strings stand is summed in parts before any shuffle. An empty table gives no
rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import stash, table

KINDS = ("email", "ip", "card", "phone", "found")
#: Fixed patterns, in forms that do not go back: each starts where its run of characters starts or the last match
#: ended (\G), and takes whole runs. They find what the plain forms find, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
#: What a text must hold for a pattern to be worth trying.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+", "token": None}
EDGES = "([{<\"'.,;:!?)]}>"

SUPPORT = 3
LEAST_SCORE = 0.5
DIGITS = 3
LEAST_CHARS = 5
#: Patterns whose counts are broadcast; with more of them the words are joined by a shuffle.
BROADCAST_PATTERNS = 100_000


def spaced(text: Column) -> Column:
    """The text with each white space character as a space."""
    return F.translate(text, "\t\n\x0b\x0c\r", " " * 5)


def occurrences(text: Column, kind: str) -> Column:
    """All matches: length of the gap before each, the match, up to three words on its left, one on its right.

    Words that touch the match, and words beyond the matches before and after it, do not count.
    """
    pattern = PATTERNS[kind]
    one_space = lambda gap: F.trim(F.regexp_replace(spaced(gap), "\x20+", " "))
    left = lambda gap: F.when(F.endswith(spaced(F.right(gap, F.lit(1))), F.lit(" ")), F.lower(F.substring_index(one_space(gap), " ", -3)))
    right = lambda gap: F.when(F.startswith(spaced(F.left(gap, F.lit(1))), F.lit(" ")), F.lower(F.substring_index(F.ltrim(spaced(gap)), " ", 1)))
    found, parts = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    gaps = F.zip_with(
        F.slice(parts, F.lit(1), F.size(found)), F.slice(parts, F.lit(2), F.size(found)),
        lambda x, y: F.struct(F.length(x).alias("gap"), F.nullif(left(x), F.lit("")).alias("left"), F.nullif(right(y), F.lit("")).alias("right")),
    )
    one = lambda m, g: F.struct(g["gap"].alias("gap"), m.alias("value"), g["left"].alias("left"), g["right"].alias("right"))
    worth = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    if NEEDED[kind]:
        worth &= F.contains(text, F.lit(NEEDED[kind]))
    return F.when(worth, F.zip_with(found, gaps, one))


def contexts(left: Column, right: Column) -> Column:
    """The patterns of a span: (side, words) for its last one, two and three words on the left and one on the right."""
    tails = [F.substring_index(left, " ", -k) for k in (1, 2, 3)]
    longer = [tails[0], *(F.when(F.length(b) > F.length(a), b) for a, b in zip(tails, tails[1:]))]
    every = [F.struct(F.lit("left").alias("side"), x.alias("words")) for x in longer]
    every.append(F.struct(F.lit("right").alias("side"), right.alias("words")))
    return F.filter(F.array(*every), lambda x: x["words"].isNotNull())


def luhn(value: Column) -> Column:
    """Whether the digits pass the check sum (every second one from the right doubled)."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """Whether a match is kept: parts of an IP, digits of a card or phone."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    small = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(digits.between(14, 19), luhn(value)).otherwise(False))
        .when(kind == "phone", digits.between(10, 15))
        .otherwise(True)
    )


def located(docs: DataFrame) -> DataFrame:
    """Rows (row_no, kind, s, e, value, left, right): kept matches, and tokens with digits that overlap none of them."""
    listed = reduce(DataFrame.unionByName, (
        docs.where(F.col(kind).isNotNull()).select("row_no", F.lit(kind).alias("kind"), F.posexplode(kind).alias("no", "x"))
        for kind in PATTERNS
    ))
    end = F.sum(F.col("x.gap") + F.length("x.value")).over(Window.partitionBy("row_no", "kind").orderBy("no"))
    listed = listed.select("row_no", "kind", end.cast("long").alias("e"), "x.value", "x.left", "x.right")
    listed = listed.where(holds(F.col("kind"), F.col("value")))
    core = F.rtrim(F.col("value"), F.lit(EDGES))
    lead = F.length(core) - F.length(F.ltrim(core, F.lit(EDGES)))
    cut = F.col("kind") == "token"
    start = F.col("e") - F.length("value")
    listed = listed.select(
        "row_no", "kind", "left", "right",
        F.when(cut, start + lead).otherwise(start).cast("long").alias("s"),
        F.when(cut, start + F.length(core)).otherwise(F.col("e")).cast("long").alias("e"),
        F.when(cut, F.ltrim(core, F.lit(EDGES))).otherwise(F.col("value")).alias("value"),
    )
    base = F.col("kind") != "token"
    by = Window.partitionBy("row_no").orderBy("s", F.desc("e"))
    before = F.max(F.when(base, F.col("e"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("s"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("s")) & (F.coalesce(after, F.col("e")) >= F.col("e"))
    shaped = (F.length(F.regexp_replace("value", "[^0-9]", "")) >= DIGITS) & (F.length("value") >= LEAST_CHARS)
    return listed.withColumn("free", free).where(base | (F.col("free") & shaped)).drop("free")


def totals(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Occurrences in the corpus of the words (one to three) of each pattern that enough different strings share."""
    wanted = placed.groupBy("side", "words", "value").agg(F.lit(1).alias("one")).groupBy("side", "words").count()
    wanted = stash(wanted.where(F.col("count") >= SUPPORT).select("words").distinct(), "patterns")
    few = wanted.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    one = F.split(F.trim(F.lower(spaced(F.col("text")))), "\x20+")
    after = lambda a, k: F.zip_with(a, F.slice(F.col("one"), F.lit(k), F.size("one")), lambda x, y: F.concat(x, F.lit(" "), y))
    read = docs.select(one.alias("one")).withColumn("two", after(F.col("one"), 2)).withColumn("three", after(F.col("two"), 3))
    words = read.select(F.explode(F.concat("one", "two", "three")).alias("words")).where("words is not null")
    if few:
        words = words.join(F.broadcast(wanted), "words", "left_semi")
    words = words.groupBy("words").agg(F.count("*").alias("total"))
    return words if few else words.join(wanted, "words", "left_semi")


def bootstrap(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted patterns (side, words, score), by rounds over the graph of patterns and strings until none is new."""
    pattern = ["side", "words"]
    edges = placed.groupBy(*pattern, "value").agg(F.count("*").alias("n"), F.max((F.col("kind") != "token").cast("int")).alias("seed"))
    edges = stash(edges.join(counts, "words").withColumn("confidence", F.col("seed").cast("double")), "edges")
    known = 0
    while True:
        sure = F.col("confidence") >= LEAST_SCORE
        accepted = (
            edges.groupBy(*pattern, "total")
            .agg(F.sum(F.col("n") * F.col("confidence")).alias("held"), F.count(F.when(sure, 1)).alias("support"))
            .select(*pattern, (F.col("held") / F.col("total")).alias("score"), "support")
            .where((F.col("score") >= LEAST_SCORE) & (F.col("support") >= SUPPORT))
        )
        accepted = stash(accepted.drop("support"), "accepted")
        now = accepted.count()
        if now == known:
            return accepted
        known = now
        best = edges.join(accepted, pattern).groupBy("value").agg(F.max("score").alias("best"))
        raised = F.greatest("confidence", F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)))
        edges = stash(edges.join(best, "value", "left").withColumn("confidence", raised).drop("best"), "edges")


def find(docs: DataFrame) -> DataFrame:
    """Spans in each row of `docs` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row_no", F.monotonically_increasing_id())
    rows = stash(read.select("row_no", "doc_id", *(occurrences(F.col("text"), k).alias(k) for k in PATTERNS)), "matches")
    spans = stash(located(rows), "spans")
    placed = spans.select("row_no", "kind", "s", "e", "value", F.explode(contexts(F.col("left"), F.col("right"))).alias("at"))
    placed = placed.select("row_no", "kind", "s", "e", "value", "at.*")
    patterns = bootstrap(placed, totals(docs, placed))
    base = spans.where("kind != 'token'").select("row_no", "kind", "s", "e")
    found = placed.where("kind = 'token'").join(patterns, ["side", "words"], "left_semi")
    found = found.select("row_no", F.lit("found").alias("kind"), "s", "e").distinct()
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    every = base.unionByName(found).groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("s", number.alias("k"), "e", "kind"))).alias("all"))
    listed = rows.select("row_no", "doc_id").join(every, "row_no", "left")
    spans_of = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    whole = F.coalesce("all", F.expr("cast(array() as array<struct<s: bigint, k: int, e: bigint, kind: string>>)"))
    seeds = F.filter(whole, lambda x: x["k"] < len(KINDS))
    count = lambda k: F.size(F.filter(whole, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return listed.select("doc_id", *map(count, KINDS), F.sha2(spans_of(seeds), 256).alias("base_sha256"), spans_of(whole).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
