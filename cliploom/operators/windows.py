"""Windows found by hotness, snapped to marks and pauses with a quality, and bounds refined on a scored grid.

Time is in whole milliseconds and scores are whole numbers where ties decide, so every run and partitioning gives the
same windows. Marks, pauses and words meet windows by equi-joins on (episode, time bin): a very long episode is spread
over its bins. Only the curve itself (two rows a second) is sorted by episode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators import large
from cliploom.operators.patterns import greedy_keep, range_join
from cliploom.operators.written import written

#: Words of the light scores of a hop, and the share of each score in the hotness curve.
ASKING = ("what", "why", "how", "when", "where", "who", "which")
CURIOUS = ("but", "however", "here's why", "the catch", "what you don't", "what no one")
INTENSE = ("amazing", "incredible", "shocking", "surprising", "unbelievable", "stunning")
VALUE = ("insight", "secret", "tip", "trick", "strategy", "method", "way", "solution")
ACTION = ("learn", "discover", "find", "get", "achieve", "create", "build", "make")
LISTING = ("first", "second", "third", "next", "then", "finally", "also", "additionally")
GLAD = ("love", "amazing", "great", "awesome", "fantastic", "wonderful", "excellent")
UPSET = ("hate", "terrible", "awful", "horrible", "disgusting", "annoying", "frustrating")
CATCHPHRASES = ("you know", "i mean", "basically", "literally", "obviously")
SHARES = {"hook": 0.26, "arousal": 0.20, "payoff": 0.18, "info": 0.11, "q_or_list": 0.09, "emotion": 0.06, "loop": 0.05}

#: Lengths tried around a peak, and the cues of a good start and a good end.
LENGTHS = (12_000, 18_000, 23_000, 30_000, 35_000, 45_000, 60_000, 75_000, 90_000)
HOOK_CUES = ("why", "how", "stop", "the secret", "here's", "watch", "don't", "never")
CONTEXT_CUES = ("ever watched", "webinar", "video that", "ramble on", "go into circles")
OPEN_CUES = CURIOUS + ("?", "…")
PAYOFF_CUES = (
    "that's why", "so that's", "and that's", "which means", "this shows", "proves that",
    "the point is", "bottom line", "in the end", "finally", "as a result", "so in short", "long story short",
)

HOP_MS = 500
#: Hops that meet their words together.
BLOCK_HOPS = 16
NANO = 1_000_000_000
#: Bound scores are counted in parts of this many, in which every weight is whole.
UNIT = 220_000
LEAST_MS, MOST_MS = 8_000, 90_000


def _present(text: Column, phrases, weight: float) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(p).cast("int") for p in phrases)) * weight


def _times(text: Column, phrase: str) -> Column:
    """How often a phrase of ASCII letters stands in the text, without overlap."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def _capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def lite_scores(words: DataFrame, half_ms: int = 2_000) -> DataFrame:
    """(episode_id, hop, seven scores) for every half second of an episode, from the words that start within ±2 s.

    Words meet hops in blocks of sixteen hops: a word goes to the one or two blocks it touches, and a block gives its hops
    and those of the silence after it. Hops without words score 0. Words without a start are left out; a null word counts
    as an empty one.
    """
    words = words.where("start_ms is not null").withColumn("w", F.coalesce("w", F.lit("")))
    low, high = F.greatest(F.ceil((F.col("start_ms") - half_ms) / HOP_MS), F.lit(0)), F.floor((F.col("start_ms") + half_ms) / HOP_MS)
    touched = F.sequence(F.floor(low / BLOCK_HOPS), F.floor(F.greatest(low, high) / BLOCK_HOPS))
    spread = words.select("episode_id", "start_ms", "end_ms", "word_idx", "w", F.explode(touched).alias("_block"))
    word = F.struct("start_ms", "word_idx", "w")
    blocks = spread.groupBy("episode_id", "_block").agg(F.sort_array(F.collect_list(word)).alias("_words"), F.max(F.greatest("end_ms", "start_ms")).alias("_end"))
    order = Window.partitionBy("episode_id").orderBy("_block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("_last", F.floor(F.max("_end").over(whole) / HOP_MS)).withColumn("_next", F.lead("_block").over(order))
    blocks = blocks.withColumn("_from", F.when(F.lag("_block").over(order).isNull(), 0).otherwise(F.col("_block") * BLOCK_HOPS).cast("long"))
    blocks = blocks.withColumn("_to", F.least(F.coalesce(F.col("_next") * BLOCK_HOPS - 1, "_last"), "_last").cast("long")).where("_from <= _to")

    def heard(hop: Column) -> Column:
        near = F.filter("_words", lambda r: F.abs(r["start_ms"] - hop * HOP_MS) <= half_ms)
        return F.struct(hop.alias("hop"), F.trim(F.concat_ws(" ", F.transform(near, lambda r: r["w"]))).alias("_text"))

    rows = blocks.select("episode_id", F.explode(F.transform(F.sequence("_from", "_to"), heard)).alias("x")).select("episode_id", "x.*")
    # columns of their own: what a lambda repeats is then computed once for each hop
    rows = rows.withColumn("_low", F.lower("_text")).withColumn("_parts", F.filter(F.split("_low", r"\s+"), lambda p: p != ""))
    rows = rows.withColumn("_n", F.size("_parts")).withColumn("_bytes", F.octet_length("_low"))
    text, low, parts, n = (F.col(c) for c in ("_text", "_low", "_parts", "_n"))
    chars = F.length(F.regexp_replace(text, r"\s+", ""))
    asking = reduce(lambda a, b: a + b, (_times(low, p) for p in ASKING)) * 0.1
    threes = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(parts, i, 3)))
    # a run of three words comes again only if its middle word does
    again = (n > 3) & (F.size(F.array_distinct(parts)) < n) & F.exists(threes, lambda g: F.col("_bytes") - F.octet_length(F.replace(low, g, F.lit(""))) > F.octet_length(g))
    listed = text.rlike(r"[0-9]+\.|[•·-]")
    scores = {
        "hook": asking + _present(low, CURIOUS, 0.2) + F.regexp_count(text, F.lit("[?]")) * 0.15,
        "arousal": F.regexp_count(text, F.lit("[!]")) * 0.2 + _present(low, INTENSE, 0.15) + F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.length(text), F.lit(1)) * 0.1,
        "payoff": _present(low, VALUE, 0.1) + _present(low, ACTION, 0.08) + F.regexp_count(text, F.lit("[0-9]+")) * 0.05,
        "info": F.when(n > 0, (n / 20) * (chars / n / 5)).otherwise(0.0),
        "q_or_list": text.contains("?").cast("int") * 0.3 + listed.cast("int") * 0.2 + _present(low, LISTING, 0.1),
        "emotion": _present(low, GLAD, 0.1) + _present(low, UPSET, 0.1),
        "loop": F.coalesce(again, F.lit(False)).cast("int") * 0.2 + _present(low, CATCHPHRASES, 0.1),
    }
    return rows.select("episode_id", "hop", *(_capped(c).alias(name) for name, c in scores.items()))


def _hops():
    return Window.partitionBy("episode_id").orderBy("hop")


def hotness_curve(grid: DataFrame) -> DataFrame:
    """(episode_id, hop, last, hot): weighted scores averaged over 3 s around, 4.5 s in episodes of less than ten minutes.

    `hot` is a whole number of billionths, so sums are exact; missing scores count as 0.
    """
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SHARES.items() if c in grid.columns))
    rows = grid.select("episode_id", "hop", F.round(total * NANO).cast("long").alias("raw"))
    rows = rows.withColumn("last", F.max("hop").over(_hops().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def mean(half: int) -> Column:
        around = _hops().rowsBetween(-half, half)
        return F.floor(F.sum("raw").over(around) / F.count("raw").over(around))

    short = F.col("last") * HOP_MS < 600_000
    return rows.select("episode_id", "hop", "last", F.when(short, mean(4)).otherwise(mean(3)).cast("long").alias("hot"))


def hot_peaks(curve: DataFrame) -> DataFrame:
    """Strict local maxima, highest first, 6 s apart (4 s in episodes under ten minutes), 20 to 60 of them by length.

    The maxima are written once, as the selection counts its groups before it reads them.
    """
    rows = curve.withColumn("_a", F.lag("hot").over(_hops())).withColumn("_b", F.lead("hot").over(_hops())).where("hot > _a and hot > _b")
    # places in thirds or halves of a hop: 4 s and 6 s are then the same distance
    rows = rows.withColumn("place", F.col("hop") * F.when(F.col("last") * HOP_MS < 600_000, 3).otherwise(2))
    rows = written(rows.select("episode_id", "hop", "hot", "last", "place"), "maxima")
    picked = greedy_keep(rows, "episode_id", [-F.col("hot"), F.col("hop")], ["hop", "hot", "last", "place"], large.Near(("place",), 23), limit=60)
    k = F.least(F.greatest(F.floor(F.col("last") * HOP_MS * 1.5 / 60_000), F.lit(20)), F.lit(60))
    return picked.where(F.col("pick") <= k).select("episode_id", "hop", "hot", F.col("pick").cast("long").alias("pick"))


def pauses(words: DataFrame, pause_ms: int = 350) -> DataFrame:
    """(episode_id, t_ms, kind): starts of words after a pause ('open') and ends of words before one ('close')."""
    order = Window.partitionBy("episode_id").orderBy("start_ms", "word_idx")
    gaps = words.withColumn("_end", F.lag("end_ms").over(order)).where(F.col("start_ms") - F.col("_end") > pause_ms)
    both = F.array(F.struct(F.col("start_ms").alias("t_ms"), F.lit("open").alias("kind")), F.struct(F.col("_end").alias("t_ms"), F.lit("close").alias("kind")))
    return gaps.select("episode_id", F.explode(both).alias("x")).select("episode_id", "x.*")


def snap_to_marks(centres: DataFrame, eos: DataFrame, words: DataFrame, reach_ms: int = 3_000, pause_ms: int = 350) -> DataFrame:
    """`centres` (episode_id, centre_ms, size_ms, more columns) with start_ms, end_ms and quality.

    A start goes to the first end mark that lies before it within reach (1.0), else to the first word within reach that
    follows a pause (0.8); an end goes to the next end mark within reach (1.0), else to the first word end within reach
    before a pause (0.8). Quality is the mean of both, less 0.01 and 0.02 for an unsnapped start and end. An episode
    without words or without marks keeps its targets, with quality 0. Equal (episode, centre, size) rows snap alike.
    """
    key = ["episode_id", "centre_ms", "size_ms"]
    targets = centres.select(*key).distinct().withColumn("_from", F.col("centre_ms") - F.expr("size_ms div 2"))
    targets = targets.withColumn("_to", F.col("_from") + F.col("size_ms"))
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("_from").alias("at")), F.struct(F.lit("e").alias("side"), F.col("_to").alias("at")))
    probes = targets.select(*key, F.explode(sides).alias("x")).select(*key, "x.*")
    probes = probes.withColumn("lo", F.greatest(F.col("at") - reach_ms, F.lit(0))).withColumn("hi", F.greatest(F.col("at") + reach_ms, F.lit(0)))
    marks = eos.select("episode_id", F.col("t_ms").cast("long").alias("t_ms"), F.lit("eos").alias("kind")).distinct().unionByName(pauses(words, pause_ms))
    near = lambda a, b: F.abs(F.col("t_ms") - F.col("at")) <= reach_ms
    met = range_join(marks, probes, "episode_id", ("t_ms", "t_ms"), ("lo", "hi"), near)
    first = lambda condition: F.min(F.when(condition, F.col("t_ms")))
    found = met.groupBy(*key).agg(
        first((F.col("side") == "s") & (F.col("kind") == "eos") & (F.col("t_ms") < F.col("at"))).alias("_s1"),
        first((F.col("side") == "s") & (F.col("kind") == "open")).alias("_s2"),
        first((F.col("side") == "e") & (F.col("kind") == "eos") & (F.col("t_ms") >= F.col("at"))).alias("_e1"),
        first((F.col("side") == "e") & (F.col("kind") == "close")).alias("_e2"),
    )
    live = words.select("episode_id").distinct().join(eos.select("episode_id").distinct(), "episode_id").withColumn("_live", F.lit(True))
    rows = targets.join(found.hint("merge"), key, "left").join(live, "episode_id", "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    grade = lambda a, b: F.when(F.col(a).isNotNull(), 1.0).when(F.col(b).isNotNull(), 0.8).otherwise(0.0)
    at = lambda a, b, target: F.when(F.col("_live"), F.coalesce(a, b, target)).otherwise(F.col(target)).cast("long")
    malus = F.when(F.coalesce("_s1", "_s2").isNull(), 0.01).otherwise(0.0) + F.when(F.coalesce("_e1", "_e2").isNull(), 0.02).otherwise(0.0)
    quality = F.when(F.col("_live"), (grade("_s1", "_s2") + grade("_e1", "_e2")) / 2 - malus).otherwise(0.0)
    snapped = rows.select(*key, at("_s1", "_s2", "_from").alias("start_ms"), at("_e1", "_e2", "_to").alias("end_ms"), F.round(quality, 4).alias("quality"))
    return centres.join(snapped.hint("merge"), key)


def hot_windows(tops: DataFrame, curve: DataFrame, eos: DataFrame, words: DataFrame, keep: int = 2, lengths=LENGTHS, ms=(7_000, 120_000)) -> DataFrame:
    """The best `keep` snapped windows of each peak by mean hotness (then quality): all lengths at once, no search in steps.

    The mean is a difference of two running sums of the curve, each met by an equi-join on (episode, hop). The joins here
    and in `snap_to_marks` merge sorted sides: written tables are small by their bytes, not by their rows.
    """
    sizes = F.explode(F.array(*(F.lit(x).cast("long") for x in lengths)))
    centres = tops.select("episode_id", F.col("hop").alias("peak"), (F.col("hop") * HOP_MS).alias("centre_ms"), sizes.alias("size_ms"))
    rows = snap_to_marks(centres, eos, words).withColumn("start_ms", F.greatest("start_ms", F.lit(0)))
    length = F.col("end_ms") - F.col("start_ms")
    rows = rows.where(length.between(*ms)).groupBy("episode_id", "peak", "start_ms", "end_ms").agg(F.max("quality").alias("quality"))
    sums = curve.select("episode_id", "hop", "last", F.sum("hot").over(_hops().rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    ends = sums.groupBy("episode_id").agg(F.max("last").alias("_last"))
    rows = rows.join(ends, "episode_id").withColumn("_a", F.ceil(F.col("start_ms") / HOP_MS) - 1).withColumn("_b", F.least(F.ceil(F.col("end_ms") / HOP_MS) - 1, F.col("_last")))
    before = sums.select("episode_id", F.col("hop").alias("_a"), F.col("_sum").alias("_before"))
    until = sums.select("episode_id", F.col("hop").alias("_b"), F.col("_sum").alias("_until"))
    rows = rows.where("_b > _a").join(before.hint("merge"), ["episode_id", "_a"], "left").join(until.hint("merge"), ["episode_id", "_b"])
    heat = F.floor((F.col("_until") - F.coalesce("_before", F.lit(0))) / (F.col("_b") - F.col("_a"))).cast("long")
    rank = F.row_number().over(Window.partitionBy("episode_id", "peak").orderBy(F.desc("heat"), F.desc("quality"), "start_ms", "end_ms"))
    return rows.withColumn("heat", heat).withColumn("_rank", rank).where(F.col("_rank") <= keep).select("episode_id", "peak", "start_ms", "end_ms", "heat", "quality")


def discover_windows(words: DataFrame, eos: DataFrame, least_heat: float = 0.1, overlap: float = 0.6) -> DataFrame:
    """Hot windows of each episode: curve, peaks, two windows for each, none that overlap by `overlap`, 20 to 40 by length.

    heat is the mean hotness of the window (0 to 1). Episodes without words give none. The curve, the peaks and the windows
    are written once each, as the selections count their groups before they read them.
    """
    curve = written(hotness_curve(lite_scores(words)), "hotness")
    found = hot_windows(written(hot_peaks(curve), "peaks"), curve, eos, words).where(F.col("heat") > int(least_heat * NANO))
    order = [-F.col("heat"), -F.col("quality"), F.col("start_ms"), F.col("end_ms")]
    rows = found.groupBy("episode_id", "start_ms", "end_ms").agg(F.max("heat").alias("heat"), F.max("quality").alias("quality"))
    rows = written(rows, "windows")
    kept = greedy_keep(rows, "episode_id", order, ["start_ms", "end_ms", "heat", "quality"], large.Overlap(overlap), limit=40)
    minutes = words.groupBy("episode_id").agg(F.floor(F.max("end_ms") / 60_000).alias("_minutes"))
    least = F.least(F.greatest("_minutes", F.lit(20)), F.lit(40))
    rows = kept.join(minutes.hint("merge"), "episode_id").where(F.col("pick") <= least)
    return rows.select("episode_id", "start_ms", "end_ms", (F.col("heat") / NANO).alias("heat"), "quality", F.col("pick").cast("long").alias("rank"))


# --- bounds ------------------------------------------------------------------------------------------------------


def word_cells(words: DataFrame) -> DataFrame:
    """(episode_id, at, until, gap, ends, w): each word owns the time until the next one starts.

    gap is the silence after the word (up to 0 at the last one); ends are the ends of words with a full stop among the
    two words before and after. The time before the first word is a cell without a word.
    """
    order = Window.partitionBy("episode_id").orderBy("start_ms", "word_idx")
    closed = F.when(F.trim("w").rlike("[.!?…]$"), F.col("end_ms"))
    rows = words.withColumn("_closed", closed).withColumn("_next", F.lead("start_ms").over(order)).withColumn("_first", F.lag("start_ms").over(order).isNull())
    ends = F.array_compact(F.array(*(F.lag("_closed", i).over(order) for i in (2, 1)), F.col("_closed"), *(F.lead("_closed", i).over(order) for i in (1, 2))))
    rows = rows.withColumn("_ends", ends).withColumn("_ahead", F.array_compact(F.array(F.col("_closed"), F.lead("_closed", 1).over(order))))
    until = F.coalesce(F.col("_next") - 1, F.greatest("start_ms", "end_ms") + 120_000)
    gap = F.greatest(F.coalesce(F.col("_next") - F.col("end_ms"), F.lit(0)), F.lit(0))
    cell = lambda at, until, gap, ends, w: F.struct(at.cast("long").alias("at"), until.cast("long").alias("until"), gap.cast("long").alias("gap"), ends.alias("ends"), w.alias("w"))
    own = cell(F.col("start_ms"), until, gap, F.col("_ends"), F.col("w"))
    head = cell(F.lit(-1), F.col("start_ms") - 1, F.greatest("start_ms", F.lit(0)), F.col("_ahead"), F.lit(None).cast("string"))
    return rows.select("episode_id", F.explode(F.when(F.col("_first") & (F.col("start_ms") > 0), F.array(head, own)).otherwise(F.array(own))).alias("x")).select("episode_id", "x.*")


def _said(cells: Column) -> Column:
    return F.trim(F.concat_ws(" ", cells["w"]))


def _at_places(cells: Column, places: Column, reach: Callable[[Column], tuple[Column, Column]]) -> Column:
    """For each place its cell and the cells between the two ends of `reach`: structs of t, here, heard."""

    def one(t: Column) -> Column:
        lo, hi = reach(t)
        here = F.try_element_at(F.filter(cells, lambda c: (c["at"] <= t) & (c["until"] >= t)), F.lit(-1))
        return F.struct(t.alias("t"), here.alias("here"), F.filter(cells, lambda c: (c["until"] >= lo) & (c["at"] <= hi)).alias("heard"))

    return F.transform(places, one)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside lambdas Spark would compute it again wherever it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _holds(text: Column, cues) -> Column:
    return _once(text, lambda x: reduce(lambda a, b: a | b, (x.contains(c) for c in cues)).cast("int"))


def _place(here: Column, t: Column) -> tuple[Column, Column]:
    """Silence in a cell (up to 220 ms) and whether a full stop lies within 250 ms of a time."""
    gap = F.coalesce(F.least(here["gap"], F.lit(220)), F.lit(0))
    return gap, F.coalesce(F.exists(here["ends"], lambda e: F.abs(e - t) <= 250), F.lit(False)).cast("int")


def _share(x: float) -> int:
    return round(x * UNIT)


def refine_by_cues(clips: DataFrame, words: DataFrame, reach_ms: int = 1_000, step_ms: int = 50) -> DataFrame:
    """Starts and ends of `clips` (episode_id, clip_id, start_ms, end_ms) moved to the best place within ±1 s, to 10 ms.

    Places are 50 ms apart. A start earns silence (0.5), a full stop (0.25), a hook in the next two seconds (0.0375) and a
    context cue in the next eight (0.03); an end silence (0.55), a full stop (0.35), an open question in the last four
    seconds (0.0625) and how the last 1.4 seconds close; both lose up to 0.35 by distance. Of equal places the earliest
    wins. Clips keep 8 to 90 s; clips under 8 s, or of episodes without words, stay. Ids are unique within an episode.
    """
    edge = lambda side, lo, hi: F.struct(F.lit(side).alias("side"), F.greatest(lo, F.lit(0)).alias("lo"), F.greatest(hi, F.lit(0)).alias("hi"))
    long_enough = clips.where(F.col("end_ms") - F.col("start_ms") >= LEAST_MS)
    sides = F.array(edge("s", F.col("start_ms") - reach_ms, F.col("start_ms") + reach_ms + 8_000), edge("e", F.col("end_ms") - reach_ms - 4_000, F.col("end_ms") + reach_ms))
    probes = long_enough.select("episode_id", "clip_id", F.explode(sides).alias("x")).select("episode_id", "clip_id", "x.*")
    touch = lambda a, b: (F.col("until") >= F.col("lo")) & (F.col("at") <= F.col("hi"))
    spans = word_cells(words).withColumn("_from", F.greatest("at", F.lit(0)))
    met = range_join(spans, probes, "episode_id", ("_from", "until"), ("lo", "hi"), touch)
    cell = F.struct("at", "until", "gap", "ends", "w")
    local = met.groupBy("episode_id", "clip_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, cell))).alias(f"_{s}") for s in "se"))
    rows = long_enough.select("episode_id", "clip_id", "start_ms", "end_ms").join(local, ["episode_id", "clip_id"])
    far = lambda t, at: F.lit(_share(0.35)) * F.abs(t - at) / reach_ms

    def start_value(x: Column) -> Column:
        t = x["t"]
        gap, stop = _place(x["here"], t)
        hook = _holds(F.lower(F.substring(_said(F.filter(x["heard"], lambda c: c["at"] <= t + 2_000)), 1, 120)), HOOK_CUES)
        context = _holds(F.lower(F.substring(_said(x["heard"]), 1, 200)), CONTEXT_CUES)
        return gap * (_share(0.5) // 220) + stop * _share(0.25) + hook * _share(0.0375) + context * _share(0.03) - far(t, F.col("start_ms"))

    def end_value(x: Column) -> Column:
        t = x["t"]
        gap, stop = _place(x["here"], t)
        last = _once(_said(x["heard"]), lambda tail: F.lower(F.when(F.length(tail) > 120, F.substring(tail, -120, 120)).otherwise(tail)))
        open_ = _holds(last, OPEN_CUES)
        ends = lambda close: close.rlike("[.!?]$").cast("int") * _share(0.12) - close.rlike(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+|[0-9]+)$").cast("int") * _share(0.15)
        closes = lambda close: _holds(F.lower(close), PAYOFF_CUES) * _share(0.25) + ends(close)
        closing = _once(_said(F.filter(x["heard"], lambda c: c["until"] >= F.greatest("_start", t - 1_400))), closes)
        return gap * (_share(0.55) // 220) + stop * _share(0.35) + open_ * _share(0.0625) + closing - far(t, F.col("end_ms"))

    def best(cells: str, lo: Column, hi: Column, reach, value, otherwise: str) -> Column:
        places = F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"), F.lit(step_ms).cast("long"))
        top = F.array_max(F.transform(_at_places(F.col(cells), places, reach), lambda x: F.struct(value(x).alias("value"), (-x["t"]).alias("t"))))
        return F.when(lo <= hi, -top["t"]).otherwise(F.col(otherwise))

    ahead = lambda t: (t, t + 8_000)
    behind = lambda t: (F.greatest("_start", t - 4_000), t)
    start, end = F.col("start_ms"), F.col("end_ms")
    rows = rows.withColumn("_start", best("_s", F.greatest(start - reach_ms, F.lit(0)), F.least(end - LEAST_MS, start + reach_ms), ahead, start_value, "start_ms"))
    rows = rows.withColumn("_end", best("_e", F.greatest(F.col("_start") + LEAST_MS, end - reach_ms), F.least(F.col("_start") + MOST_MS, end + reach_ms), behind, end_value, "end_ms"))
    new_start = F.greatest(F.least(F.col("_start"), F.col("_end") - LEAST_MS), F.lit(0))
    tens = lambda c: F.floor((c + 5) / 10).cast("long") * 10
    rows = rows.withColumn("_to", F.least(F.col("_start") + MOST_MS, F.greatest("_end", new_start + LEAST_MS))).withColumn("_from", new_start)
    moved = rows.select("episode_id", "clip_id", tens(F.col("_from")).alias("_from"), tens(F.col("_to")).alias("_to"))
    both = clips.join(moved, ["episode_id", "clip_id"], "left")
    return both.withColumn("start_ms", F.coalesce("_from", "start_ms")).withColumn("end_ms", F.coalesce("_to", "end_ms")).drop("_from", "_to")
