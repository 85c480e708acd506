"""Sentences, end marks, boundaries and candidate windows along an episode's time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.joins import next_eos, ordered_text, prev_eos, segment_window_text
from cliploom.operators import large
from cliploom.operators.patterns import islands, ordered_fold, range_join
from cliploom.operators.written import written

ENDS = r"[.!?]$"
CLOSED = r"[.!?][\"')\]\u201D\u2019\u00BB\u203A]*\s*$"
ENDS_WIDE = "[.!?…]$"

#: Phrases that mark a strong opening, a topic shift and an insight.
OPENING_STARTS = (
    "look", "listen", "here's", "here is", "let me", "the thing is", "real talk", "so here's", "okay so", "so today", "what we're",
    "we're gonna", "and i'll", "and i will", "the 3", "the three", "top ", "why ", "how ",
)
TOPIC_SHIFTS = (
    "but", "however", "meanwhile", "on the other hand", "speaking of", "that reminds me", "by the way", "oh wait", "actually", "now", "so",
    "well", "okay", "right", "alright", "anyway", "moving on", "next", "another thing", "also", "plus", "additionally", "furthermore",
)
INSIGHT_PHRASES = (
    "here's the thing", "the key is", "the key insight", "what i learned", "my take", "the bottom line", "in summary", "to wrap up",
    "main observation", "key takeaway", "the thing is", "what i found", "here's what", "the insight", "here's why", "let me tell you",
    "you know what", "this is why", "the reason is", "the problem is", "the issue is", "the challenge is", "the solution is",
    "the answer is", "the truth is", "the reality is", "the fact is", "the secret is", "the trick is", "the way to", "the best way",
    "the only way", "the right way", "the wrong way", "i think", "i believe", "i feel", "i know", "i understand", "i realize",
    "the point is", "the idea is", "the concept is", "the principle is",
)
CLOSERS = ("right?", "you know?", "that's it.", "that's right.", "all set.", "we're done.")


def _by(*order: str):
    return Window.partitionBy("episode_id").orderBy(*order)


def any_of(text: Column, phrases) -> Column:
    """Whether a text holds one of the phrases anywhere."""
    import re

    return text.rlike("|".join(re.escape(p) for p in sorted(phrases)))


# --- sentences and marks -----------------------------------------------------------------------------------------


def distribute_punct(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words with `after`: the segment's last punctuation, on its last word, if that has none of its own."""
    last = F.row_number().over(Window.partitionBy("episode_id", "seg_idx").orderBy(F.desc("word_idx"))) == 1
    mark = F.regexp_extract(F.rtrim("text"), r"([.!?,;:]+)$", 1)
    rows = words.join(segments.select("episode_id", "seg_idx", mark.alias("mark")), ["episode_id", "seg_idx"], "left")
    after = F.when(last & (F.col("mark") != "") & ~F.col("w").rlike(r"[.!?,;:]$"), F.col("mark")).otherwise(F.lit(""))
    return rows.withColumn("after", after).drop("mark")


def sentence_spans(words: DataFrame, pause_ms: int = 400) -> DataFrame:
    """(episode_id, span_idx, start_ms, end_ms, text, n_words): cut after final punctuation, and after the word that
    follows a pause of `pause_ms`."""
    order = _by("word_idx")
    paused = F.col("start_ms") - F.lag("end_ms").over(order) >= pause_ms
    ended = F.col("w").rlike(ENDS) | F.coalesce(paused, F.lit(False))
    rows = words.withColumn("_ended", ended)
    rows = islands(rows, ["episode_id"], ["word_idx"], F.lag("_ended").over(order), "span_idx")
    return rows.groupBy("episode_id", "span_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), ordered_text("word_idx", "w").alias("text"), F.count("*").alias("n_words")
    )


def span_flags(spans: DataFrame, payoff_cues=("the answer", "that means", "because", "the key", "so ")) -> DataFrame:
    """Spans with strong_opening and complete_payoff."""
    lower = F.trim(F.lower("text"))
    opening = lower.endswith("?")
    for p in OPENING_STARTS:
        opening |= lower.startswith(p)
    payoff = any_of(lower, payoff_cues) & lower.rlike(ENDS) & (F.size(F.split(lower, "[.!?]+")) >= 2)
    return spans.withColumn("strong_opening", opening).withColumn("complete_payoff", payoff)


def context_seeds(spans: DataFrame, least_ms: int = 8_000, more: int = 3, reach_ms: int = 90_000) -> DataFrame:
    """From each strong opening, whole sentences up to the least length, then up to `more` until one pays off or ends."""
    flagged = span_flags(spans)
    openings = flagged.where("strong_opening").select("episode_id", F.col("span_idx").alias("first_idx"), F.col("start_ms").alias("seed_start"), (F.col("start_ms") + reach_ms).alias("seed_limit"))
    follow = lambda a, b: (F.col("span_idx") >= F.col("first_idx")) & (F.col("end_ms") <= F.col("seed_limit"))
    rows = range_join(flagged, openings, "episode_id", ("start_ms", "end_ms"), ("seed_start", "seed_limit"), follow)
    grown = Window.partitionBy("episode_id", "first_idx").orderBy("span_idx")
    long_enough = F.col("end_ms") - F.col("seed_start") >= least_ms
    rows = rows.withColumn("extra", F.sum(long_enough.cast("int")).over(grown))
    stop = F.when(F.col("complete_payoff") | F.col("text").rlike(ENDS), 0).otherwise(1)
    best = rows.where((F.col("extra") >= 1) & (F.col("extra") <= more + 1))
    pick = F.row_number().over(Window.partitionBy("episode_id", "first_idx").orderBy(stop, "span_idx"))
    ends = best.withColumn("pick", pick).where("pick = 1").select("episode_id", "first_idx", F.col("span_idx").alias("last_idx"), "seed_start", F.col("end_ms").alias("seed_end"))
    return ends.withColumnRenamed("seed_start", "start_ms").withColumnRenamed("seed_end", "end_ms")


def word_gaps(words: DataFrame, by: tuple[str, ...] = ("episode_id",), kinds: bool = False) -> DataFrame:
    """(by, t_ms, gap, named): each word's end, the gap after it in its group, and whether it ends a sentence or is a closer;
    with `kinds` also its kind of `eos_strong_weak`. One window over the words, written without texts, as it is read thrice."""
    order = Window.partitionBy(*by).orderBy("word_idx")
    rows = words.withColumn("gap", F.lead("start_ms").over(order) - F.col("end_ms"))
    named = F.coalesce(F.col("w").rlike(ENDS_WIDE) | F.lower("w").isin(*CLOSERS), F.lit(False)).alias("named")
    kind = [mark_kind(F.lead("w").over(order)).alias("kind")] if kinds else []
    return written(rows.select(*by, F.col("end_ms").alias("t_ms"), "gap", named, *kind), "gaps")


def eos_from_words(words: DataFrame, base_ms: int = 280) -> DataFrame:
    """Marks at word ends: final punctuation, a gap of max(base, median + central median gap), spoken closers."""
    return marks_of_gaps(word_gaps(words), base_ms)


def marks_of_gaps(gaps: DataFrame, base_ms: int = 280, by: tuple[str, ...] = ("episode_id",)) -> DataFrame:
    """Marks of `eos_from_words`. Equal gaps of a group are counted before their median is taken."""
    by = list(by)
    counts = gaps.where("gap > 0").groupBy(*by, "gap").agg(F.count("*").alias("n"))
    spread = gaps.where("gap > 0").groupBy(*by).agg(F.stddev_samp("gap").alias("dev"))
    stats = counts.groupBy(*by).agg(F.percentile("gap", 0.5, F.col("n")).alias("mid")).join(spread, by)
    central = counts.join(stats, by).where(F.abs(F.col("gap") - F.col("mid")) <= F.col("dev"))
    central = central.groupBy(*by).agg(F.percentile("gap", 0.5, F.col("n")).alias("near"))
    limits = stats.join(central, by, "left").select(*by, F.greatest(F.lit(float(base_ms)), F.col("mid") + F.coalesce("near", "mid")).alias("limit_ms"))
    rows = gaps.where("gap is not null").join(limits, by, "left")
    marks = rows.where(F.col("named") | (F.col("gap") >= F.coalesce("limit_ms", F.lit(float(base_ms)))))
    return marks.select("episode_id", "t_ms", F.lit("words").alias("source")).distinct()


def mark_kind(next_w: Column, pause_ms: int = 500) -> Column:
    strong = F.col("w").rlike(ENDS) & (next_w.isNull() | next_w.rlike(r"^\p{Lu}"))
    weak = F.col("w").rlike("[,;:]$") & (F.col("gap") > pause_ms)
    return F.when(strong, "strong").when(weak, "weak")


def eos_strong_weak(words: DataFrame, pause_ms: int = 500) -> DataFrame:
    """Marks after . ! ? where the next word has a capital or there is none, and after , ; : before a pause."""
    order = _by("word_idx")
    rows = words.withColumn("next_w", F.lead("w").over(order)).withColumn("gap", F.lead("start_ms").over(order) - F.col("end_ms"))
    return rows.select("episode_id", F.col("end_ms").alias("t_ms"), mark_kind(F.col("next_w"), pause_ms).alias("source")).where("source is not null")


def eos_from_text(segments: DataFrame) -> DataFrame:
    """Marks at . ! ? by their place in the text mapped to the segment's time, and at segment ends."""
    rows = segments.select("episode_id", "start_ms", "end_ms", F.length("text").alias("size"), F.posexplode(F.split("text", "")).alias("at", "c"))
    inside = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col("at") / F.greatest("size", F.lit(1)))
    marks = rows.where(F.col("c").isin(".", "!", "?")).select("episode_id", inside.cast("long").alias("t_ms"))
    ends = segments.where("end_ms > 0").select("episode_id", F.col("end_ms").alias("t_ms"))
    return marks.union(ends).distinct().withColumn("source", F.lit("text"))


def eos_from_gaps(segments: DataFrame, gap_ms: int = 300, words_after: int = 8) -> DataFrame:
    """Marks at segment ends before a gap, with enough words still to come."""
    order = _by("seg_idx")
    after = F.sum("n_words").over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = segments.withColumn("gap", F.lead("start_ms").over(order) - F.col("end_ms")).withColumn("after", F.coalesce(after, F.lit(0)))
    return rows.where((F.col("gap") >= gap_ms) & (F.col("after") >= words_after)).select("episode_id", F.col("end_ms").alias("t_ms"), F.lit("gaps").alias("source"))


def thin_marks(marks: DataFrame, tolerance_ms: int = 250, large_group: int = large.LARGE_GROUP) -> DataFrame:
    """Marks of which each is more than the tolerance after the last one kept.

    The marks are written once, as their groups are counted before they are read.
    """

    def step(kept: Column, x: Column) -> Column:
        near = (F.size(kept) > 0) & (x["t_ms"] - F.element_at(kept, -1) <= tolerance_ms)
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x["t_ms"])))

    def fold(rows: DataFrame) -> DataFrame:
        folded = ordered_fold(rows, "episode_id", [F.col("t_ms")], ["t_ms"], "cast(array() as array<bigint>)", step, "kept")
        return folded.select("episode_id", F.explode("kept").alias("t_ms"))

    def begin():
        last: list = []

        def take(row: dict):
            if not last or row["t_ms"] - last[0] > tolerance_ms:
                last[:] = [row["t_ms"]]
                yield (row["t_ms"],)

        return take, lambda: ()

    rows = written(marks.where("t_ms is not null").select("episode_id", F.col("t_ms").cast("long").alias("t_ms")).distinct(), "marks")
    return large.by_size(rows, "episode_id", fold, lambda r: large.ordered_stream(r, "episode_id", [F.col("t_ms")], ["t_ms"], begin, "t_ms long"), large_group)


def unify_marks(marks: DataFrame, word_marks: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """Both sets as one, thinned, each mark moved to the nearest word-based mark within the tolerance."""
    words = written(word_marks.select("episode_id", "t_ms"), "word-marks")
    kept = thin_marks(marks.select("episode_id", "t_ms").union(words), tolerance_ms)
    rows = prev_eos(next_eos(kept.withColumnRenamed("t_ms", "at_ms"), words, "at_ms"), words, "at_ms")
    ahead, behind = F.col("next_ms") - F.col("at_ms"), F.col("at_ms") - F.col("prev_ms")
    use_prev = F.coalesce(behind <= tolerance_ms, F.lit(False)) & (F.col("next_ms").isNull() | (behind <= ahead))
    use_next = F.coalesce(ahead <= tolerance_ms, F.lit(False))
    t = F.when(use_prev, F.col("prev_ms")).when(use_next, F.col("next_ms")).otherwise(F.col("at_ms"))
    return rows.select("episode_id", t.alias("t_ms")).distinct()


def eos_index(words: DataFrame, segments: DataFrame, least_words: int = 100, least_marks: int = 10, per_word: float = 0.015) -> DataFrame:
    """Marks of the best source of each episode: words where there are enough of them, else the text; gaps are added
    where the marks are few for the words.

    The gaps hold a row for each word, so words are counted there, and only texts of episodes with few words are searched. These
    and the best marks are written, as they are read twice: Spark takes a union of sides dealt by episode as dealt by episode
    itself and may drop that while it runs, when groups and joins above it no longer hold.
    """
    gaps = word_gaps(words)
    counts = gaps.groupBy("episode_id").agg(F.count("*").alias("n_words"))
    by_words = marks_of_gaps(gaps).join(counts, "episode_id").where(F.col("n_words") >= least_words)
    few = segments.select("episode_id", "start_ms", "end_ms", "text").join(counts, "episode_id", "left").where(F.coalesce("n_words", F.lit(0)) < least_words)
    by_text = eos_from_text(written(few.drop("n_words"), "few-words"))
    best = written(by_words.drop("n_words").unionByName(by_text), "best-marks")
    sparse = counts.join(best.groupBy("episode_id").agg(F.count("*").alias("n_marks")), "episode_id", "left")
    marks = F.coalesce("n_marks", F.lit(0))
    sparse = sparse.where((marks < least_marks) | (marks < per_word * F.col("n_words"))).select("episode_id")
    extra = eos_from_gaps(segments).join(sparse, "episode_id", "left_semi")
    both = best.unionByName(extra)
    return both.groupBy("episode_id", "t_ms").agg(F.max("source").alias("source"))


def eos_waterfall(
    segments: DataFrame, words: DataFrame | None = None, segment_words: DataFrame | None = None, least_words: int = 100, least_marks: int = 10, per_word: float = 0.015, gap_ms: int = 300
) -> DataFrame:
    """(episode_id, t_ms, source): each episode's marks from the best source that has any.

    In order: the words of the episode, if there are `least_words` (gaps, closers and capitals, unified); the words of its single
    segments; the punctuation of its text; the ends of its segments. Where the marks are fewer than `least_marks`, or than
    `per_word` for each word, segment ends before a gap with eight words still to come join them, and the source is
    "gap_fallback" if there is any such gap. Sources are ranked in one union and one window over the episode.
    """
    episode, parts = F.col("episode_id"), []
    none = segments.where(F.lit(False)).select("episode_id", F.lit(0).cast("long").alias("n"))
    spoken = words.groupBy("episode_id").agg(F.count("*").alias("n")) if words is not None else none
    if words is not None:
        enough = words.join(spoken.where(F.col("n") >= least_words).select("episode_id"), "episode_id", "left_semi")
        gaps = word_gaps(enough, kinds=True)
        parts.append(unify_marks(marks_of_gaps(gaps), gaps.where("kind is not null")).withColumn("source", F.lit("episode+enhanced")))
    by_segment = none
    if segment_words is not None:
        inside = ("episode_id", "seg_idx")
        single = marks_of_gaps(word_gaps(segment_words, inside), by=inside)
        parts.append(single.select("episode_id", "t_ms").withColumn("source", F.lit("segment")))
        by_segment = segment_words.groupBy("episode_id").agg(F.count("*").alias("n"))
    parts.append(eos_from_text(segments.where(F.trim("text") != "")).withColumn("source", F.lit("fallback")))
    parts.append(segments.where("end_ms > 0").select("episode_id", F.col("end_ms").cast("long").alias("t_ms")).distinct().withColumn("source", F.lit("segment_boundary")))
    order = F.array(*map(F.lit, ("episode+enhanced", "segment", "fallback", "segment_boundary")))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.array_position(order, F.col("source")))
    best = ranked.withColumn("best", F.min("rank").over(Window.partitionBy("episode_id"))).where("rank = best").select("episode_id", "t_ms", "source")
    # Episodes without words of their own are measured by the words of their segments.
    sizes = spoken.withColumn("own", F.lit(1)).unionByName(by_segment.withColumn("own", F.lit(0))).groupBy("episode_id").agg(F.max_by("n", "own").alias("n_words"))
    state = segments.select("episode_id").distinct().join(best.groupBy("episode_id").agg(F.count("*").alias("n_marks")), "episode_id", "left").join(sizes, "episode_id", "left")
    marks, total = F.coalesce("n_marks", F.lit(0)), F.coalesce("n_words", F.lit(0))
    sparse = state.where((marks < least_marks) | ((total > 0) & (marks < per_word * total))).select("episode_id")
    gaps = segments.withColumn("gap", F.lead("start_ms").over(_by("seg_idx")) - F.col("end_ms")).where(F.col("gap") >= gap_ms).select("episode_id").distinct().join(sparse, "episode_id", "left_semi")
    extra = eos_from_gaps(segments, gap_ms).join(sparse, "episode_id", "left_semi").select("episode_id", "t_ms", F.lit("gap_fallback").alias("source"))
    named = best.join(gaps.withColumn("filled", F.lit(True)), "episode_id", "left").withColumn("source", F.when(F.col("filled"), "gap_fallback").otherwise(F.col("source"))).drop("filled")
    return named.unionByName(extra).select(episode, F.col("t_ms").cast("long").alias("t_ms"), "source").distinct()


def eos_density(words: DataFrame, eos: DataFrame, least: float = 6.0) -> DataFrame:
    """(episode_id, n_words, n_marks, per_minute, fallback): marks a minute (a minute at least)."""
    spoken = words.groupBy("episode_id").agg(F.count("*").alias("n_words"), F.max("end_ms").alias("last"), F.min("start_ms").alias("first"))
    marks = eos.groupBy("episode_id").agg(F.count("*").alias("n_marks"))
    rows = spoken.join(marks, "episode_id", "left").withColumn("n_marks", F.coalesce("n_marks", F.lit(0)))
    density = F.round(F.col("n_marks") / F.greatest((F.col("last") - F.col("first")) / 60_000, F.lit(1.0)), 6)
    return rows.select("episode_id", "n_words", "n_marks", density.alias("per_minute")).withColumn("fallback", F.col("per_minute") < least)


def natural_boundaries(docs: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, position, kind, confidence): the first rule that holds at a word, one boundary for each position.

    A lone "?" is a sentence end, as that rule comes first; a rule for questions and answers after it could never hold.
    """
    rows = docs.select(key, F.split(F.trim("text"), r"\s+").alias("ws"))
    n = F.size("ws")

    def kind(w: Column, i: Column) -> Column:
        near = lambda a, b: F.array_join(F.slice("ws", F.greatest(i + a, F.lit(0)) + 1, F.greatest(F.least(i + b, n - 1) - F.greatest(i + a, F.lit(0)) + 1, F.lit(0))), " ")
        return (
            F.when(w.rlike("[.!?:;]$"), F.lit("sentence_end"))
            .when(any_of(near(-2, 2), TOPIC_SHIFTS), F.lit("topic_shift"))
            .when(any_of(near(-1, 1), INSIGHT_PHRASES), F.lit("insight_marker"))
            .when((w == ",") & (i > 5) & (i < n - 5) & any_of(near(-3, 3), ("first", "second", "third", "also", "additionally", "furthermore")), F.lit("comma_boundary"))
        )

    # The neighbours of a word are read from the text's own array, so words do not move and only boundaries leave a row.
    found = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("at"), kind(w, i).alias("kind"), n.alias("n"))), lambda x: x["kind"].isNotNull())
    rows = rows.select(key, F.explode(found).alias("x")).select(key, "x.*")
    after = F.col("kind").isin("sentence_end", "comma_boundary").cast("int")
    rows = rows.withColumn("position", F.col("at") + after).where("position > 0 and position < n")
    first = F.row_number().over(Window.partitionBy(key, "position").orderBy("at"))
    sure = F.when(F.col("kind") == "sentence_end", 0.9).when(F.col("kind") == "topic_shift", 0.6).when(F.col("kind") == "insight_marker", 0.7).otherwise(0.5)
    return rows.withColumn("first", first).where("first = 1").select(key, F.col("position").cast("long").alias("position"), "kind", sure.alias("confidence"))


# --- segments ----------------------------------------------------------------------------------------------------


def topic_segments(segments: DataFrame, markers=TOPIC_SHIFTS, least_ms: int = 8_000, most_ms: int = 90_000) -> DataFrame:
    """Runs of segments between openings with a topic marker, of 8 to 90 seconds."""
    opens = F.trim(F.lower("text"))
    begins = F.lit(False)
    for m in markers:
        begins |= opens.startswith(m + " ")
    rows = islands(segments, ["episode_id"], ["seg_idx"], begins, "topic")
    joined = rows.groupBy("episode_id", "topic").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), ordered_text("seg_idx", "text").alias("text"))
    return joined.where((F.col("end_ms") - F.col("start_ms")).between(least_ms, most_ms))


def dynamic_segments(segments: DataFrame, least_ms: int = 8_000) -> DataFrame:
    """Pieces of an episode between natural boundaries, timed by their share of the words, at least `least_ms` long."""
    whole = segments.groupBy("episode_id").agg(ordered_text("seg_idx", "text").alias("text"), F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
    n = F.size(F.split(F.trim("text"), r"\s+"))
    cuts = natural_boundaries(whole).where("confidence >= 0.7").select("episode_id", "position")
    zero = whole.select("episode_id", F.lit(0).cast("long").alias("position"))
    rows = cuts.union(zero).distinct().join(whole.select("episode_id", "first", "last", n.alias("n")), "episode_id")
    to = F.coalesce(F.lead("position").over(_by("position")), F.col("n"))
    at = lambda p: F.col("first") + F.floor((F.col("last") - F.col("first")) * p / F.col("n"))
    spans = rows.select("episode_id", at(F.col("position")).alias("start_ms"), at(to).alias("cut_ms"), "last")
    end = F.least(F.greatest(F.col("cut_ms"), F.col("start_ms") + least_ms), F.col("last"))
    spans = spans.select("episode_id", F.concat_ws("-", "start_ms", end).alias("clip_id"), "start_ms", end.alias("end_ms"))
    return segment_window_text(segments, written(spans, "spans"))


def merge_short_seeds(segments: DataFrame, gap_ms: int = 250, least_ms: int = 16_000, most_ms: int = 28_000, large_group: int = large.LARGE_GROUP) -> DataFrame:
    """Neighbours of one speaker with little gap, merged in order until they are long enough.

    Episodes of many segments are read in order and hold the one seed that is open.
    """
    fields = ["start_ms", "end_ms", "speaker", "text"]
    kind = "struct<start_ms: bigint, end_ms: bigint, speaker: string, text: string, n: bigint>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (x["start_ms"] - last["end_ms"] <= gap_ms) & (x["speaker"] == last["speaker"])
        fits &= (last["end_ms"] - last["start_ms"] < least_ms) & (x["end_ms"] - last["start_ms"] <= most_ms)
        one = F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["speaker"].alias("speaker"), x["text"].alias("text"), F.lit(1).cast("long").alias("n"))
        both = F.struct(last["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), last["speaker"].alias("speaker"), F.concat_ws(" ", last["text"], x["text"]).alias("text"), (last["n"] + 1).alias("n"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(one)))

    def fold(rows: DataFrame) -> DataFrame:
        folded = ordered_fold(rows, "episode_id", [F.col("seg_idx")], fields, f"cast(array() as array<{kind}>)", step, "done")
        return folded.select("episode_id", F.posexplode("done").alias("seed_idx", "x")).select("episode_id", "seed_idx", "x.*")

    def begin():
        open_, texts, done = [], [], [0]

        def close():
            if open_:
                start, end, speaker = open_
                yield done[0], start, end, speaker, " ".join(t for t in texts if t is not None) if len(texts) > 1 else texts[0], len(texts)
                done[0] += 1

        def take(row: dict):
            start, end, speaker, text = row.values()
            if open_ and None not in (start, end, speaker, *open_):
                fits = start - open_[1] <= gap_ms and speaker == open_[2] and open_[1] - open_[0] < least_ms and end - open_[0] <= most_ms
                if fits:
                    open_[1] = end
                    texts.append(text)
                    return
            yield from close()
            open_[:], texts[:] = (start, end, speaker), (text,)

        return take, close

    out = "seed_idx int, start_ms long, end_ms long, speaker string, text string, n long"
    return large.by_size(segments, "episode_id", fold, lambda rows: large.ordered_stream(rows, "episode_id", [F.col("seg_idx")], fields, begin, out), large_group)


def sliding_windows(segments: DataFrame, window_ms: int = 28_000, step_ms: int = 18_000, least_ms: int = 8_000, least_chars: int = 20) -> DataFrame:
    """Fixed windows over each episode with the text of the segments they overlap; short ones go."""
    total = segments.groupBy("episode_id").agg(F.max("end_ms").alias("total"))
    rows = total.select("episode_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(step_ms).cast("long"))).alias("start_ms"))
    rows = rows.withColumn("end_ms", F.least(F.col("start_ms") + window_ms, F.col("total"))).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    rows = rows.withColumn("clip_id", F.concat_ws("-", "start_ms", "end_ms"))
    return segment_window_text(segments, rows).where(F.length(F.trim("text")) >= least_chars)


#: Bands of window lengths in milliseconds, and the share of the window that a step takes.
BANDS = ((8_000, 12_000, 60), (12_000, 18_000, 60), (18_000, 28_000, 60), (28_000, 45_000, 50), (60_000, 90_000, 50))


def multiscale_windows(segments: DataFrame, bands=BANDS) -> DataFrame:
    """Windows of the middle length of each band, stepped by a share of it."""
    total = segments.groupBy("episode_id").agg(F.max("end_ms").alias("total"))
    table = F.array(*(F.struct(F.lit(i).alias("band"), F.lit((a + b) // 2).cast("long").alias("size"), F.lit((a + b) // 2 * p // 100).cast("long").alias("step")) for i, (a, b, p) in enumerate(bands)))
    rows = total.select("episode_id", "total", F.explode(table).alias("b")).select("episode_id", "total", "b.*")
    rows = rows.where("total >= size").select("episode_id", "band", "size", F.explode(F.expr("sequence(0L, total - size, step)")).alias("start_ms"))
    return rows.select("episode_id", "band", "start_ms", (F.col("start_ms") + F.col("size")).alias("end_ms"))


def split_mixed(segments: DataFrame, intros=("hi", "hello", "welcome", "hey"), markers=("so", "today", "now", "the")) -> DataFrame:
    """Segments that open with a greeting, cut at the first content marker; times by the share of words."""
    ws = F.split(F.trim("text"), r"\s+")
    bare = F.transform(ws, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}']", "")))
    rows = segments.withColumn("_ws", ws).withColumn("_bare", bare)
    first = F.array_min(F.array(*(F.when(F.array_position("_bare", m) > 1, F.array_position("_bare", m)) for m in markers)))
    at = F.when(F.element_at("_bare", 1).isin(*intros), first)
    rows = rows.withColumn("_at", at)
    cut = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (F.col("_at") - 1) / F.size("_ws"))
    part = lambda no, s, e, t: F.struct(F.lit(no).alias("part"), s.alias("s"), e.alias("e"), t.alias("t"))
    whole = F.array(part(0, F.col("start_ms"), F.col("end_ms"), F.col("text")))
    rest = F.array_join(F.slice("_ws", F.col("_at"), F.size("_ws")), " ")
    two = F.array(part(0, F.col("start_ms"), cut, F.array_join(F.slice("_ws", F.lit(1), F.col("_at") - 1), " ")), part(1, cut, F.col("end_ms"), rest))
    rows = rows.withColumn("_x", F.explode(F.when(F.col("_at").isNotNull(), two).otherwise(whole)))
    return rows.select("episode_id", "seg_idx", F.col("_x.part").alias("part"), F.col("_x.s").cast("long").alias("start_ms"), F.col("_x.e").cast("long").alias("end_ms"), F.col("_x.t").alias("text"))


GREETING = r"^(hi|hello|hey|welcome|good (morning|evening|afternoon)|what'?s up|thanks for (watching|listening))\b"


def repetitive(text: Column) -> Column:
    """Whether one word is over half of the words, or under three in ten words are different (10 words at least)."""
    ws = F.split(F.lower(F.trim(text)), r"\s+")
    sorted_ws = F.array_sort(ws)
    run = F.aggregate(
        sorted_ws, F.expr("named_struct('w', '', 'n', 0, 'most', 0)"),
        lambda s, w: F.struct(w.alias("w"), F.when(s["w"] == w, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["most"], F.when(s["w"] == w, s["n"] + 1).otherwise(1)).alias("most")),
    )
    n = F.size(ws)
    return (n >= 10) & ((run["most"] > n * 0.5) | (F.size(F.array_distinct(ws)) < n * 0.3))


def content_filter(segments: DataFrame) -> DataFrame:
    """Segments that neither greet nor repeat themselves."""
    return segments.where(~F.trim(F.lower("text")).rlike(GREETING) & ~repetitive(F.col("text")))


def keep_caps(segments: DataFrame, words=(5, 100), ms=(8_000, 60_000)) -> DataFrame:
    """Segments of 5 to 100 words and 8 to 60 seconds."""
    return segments.where(F.size(F.split(F.trim("text"), r"\s+")).between(*words) & (F.col("end_ms") - F.col("start_ms")).between(*ms))


ANSWER = r"\b(so|that means|here('s)? (how|why)|the (answer|takeaway) is|because)\b"


def stitch_answers(segments: DataFrame, most_ms: int = 8_000) -> DataFrame:
    """A question joined to the next segment if that answers; the end moves by 8 seconds at most."""
    order = _by("seg_idx")
    rows = segments.withColumn("_text", F.lead("text").over(order)).withColumn("_end", F.lead("end_ms").over(order))
    joins = F.coalesce(F.rtrim("text").endswith("?") & F.lower("_text").rlike(ANSWER), F.lit(False))
    return rows.select(
        "episode_id", "seg_idx", "start_ms",
        F.when(joins, F.least(F.col("end_ms") + most_ms, F.col("_end"))).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(joins, F.concat_ws(" ", "text", "_text")).otherwise(F.col("text")).alias("text"), joins.alias("has_answer"),
    )


def collapse_runs(clips: DataFrame, score: str = "final_score", least_payoff: float = 0.20) -> DataFrame:
    """Of each run of questions without payoff, the one with the best score; all other clips."""
    asks = F.rtrim("text").endswith("?") & (F.coalesce("payoff_score", F.lit(0.0)) < least_payoff)
    rows = clips.withColumn("_q", F.coalesce(asks, F.lit(False)))
    order = _by("start_ms", "clip_id")
    begins = ~F.col("_q") | ~F.coalesce(F.lag("_q").over(order), F.lit(False))
    rows = islands(rows, ["episode_id"], ["start_ms", "clip_id"], begins, "_run")
    pick = F.row_number().over(Window.partitionBy("episode_id", "_run").orderBy(F.desc(score), "start_ms", "clip_id"))
    return rows.withColumn("_pick", pick).where("_pick = 1").drop("_q", "_run", "_pick")


def vtt_cues(words: DataFrame, most_chars: int = 38, gap_ms: int = 350) -> DataFrame:
    """Caption cues: a new one where the line would pass `most_chars` or after a gap."""
    kind = "struct<start_ms: bigint, end_ms: bigint, text: string>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last["text"]) + 1 + F.length(x["w"]) <= most_chars) & (x["start_ms"] - last["end_ms"] <= gap_ms)
        one = F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["w"].alias("text"))
        both = F.struct(last["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.concat_ws(" ", last["text"], x["w"]).alias("text"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(one)))

    folded = ordered_fold(words, "episode_id", [F.col("word_idx")], ["start_ms", "end_ms", "w"], f"cast(array() as array<{kind}>)", step, "done")
    return folded.select("episode_id", F.posexplode("done").alias("cue", "x")).select("episode_id", F.col("cue").cast("long").alias("cue"), "x.*")


# --- hotness and windows -----------------------------------------------------------------------------------------


def hop_features(words: DataFrame, hop_ms: int = 500, half_ms: int = 2_000) -> DataFrame:
    """Light counts of the words that start within ±2 s of each half second: words are counted once where they touch the
    same hops, and their counts, not the words, go to each hop."""
    low = F.greatest(F.ceil((F.col("start_ms") - half_ms) / hop_ms), F.lit(0))
    high = F.floor((F.col("start_ms") + half_ms) / hop_ms)
    last = words.groupBy("episode_id").agg(F.floor(F.max("end_ms") / hop_ms).alias("last_hop"))
    word, names = F.col("w"), ("n_words", "chars", "shouts", "asks", "numbers", "capitals")
    alike = words.groupBy("episode_id", low.alias("low"), high.alias("high")).agg(
        F.count("*").alias("n_words"), F.sum(F.length(word)).alias("chars"), F.sum(F.regexp_count(word, F.lit(r"[!]"))).alias("shouts"),
        F.sum(F.regexp_count(word, F.lit(r"[?]"))).alias("asks"), F.sum(F.regexp_count(word, F.lit(r"\d+"))).alias("numbers"),
        F.sum(F.regexp_count(word, F.lit(r"\p{Lu}"))).alias("capitals"),
    )
    rows = alike.join(last, "episode_id").withColumn("high", F.least("high", "last_hop")).where("low <= high")
    rows = rows.select("episode_id", F.explode(F.sequence("low", "high")).alias("hop"), *names)
    counts = rows.groupBy("episode_id", "hop").agg(*(F.sum(c).alias(c) for c in names))
    info = F.least(F.lit(1.0), (F.col("n_words") / 20) * (F.col("chars") / F.col("n_words") / 5))
    arousal = F.least(F.lit(1.0), F.col("shouts") * 0.2 + F.col("capitals") / F.greatest(F.col("chars") + F.col("n_words") - 1, F.lit(1)) * 0.1)
    return counts.select(
        "episode_id", "hop", F.least(F.lit(1.0), F.col("asks") * 0.15).alias("hook"), arousal.alias("arousal"),
        F.least(F.lit(1.0), F.col("numbers") * 0.05).alias("payoff"), info.alias("info"), F.when(F.col("asks") > 0, 0.3).otherwise(0.0).alias("q_or_list"),
    )


# --- ends --------------------------------------------------------------------------------------------------------


def refine_grid(clips: DataFrame, segments: DataFrame, step_ms: int = 300) -> DataFrame:
    """The best of 25 shifts of both ends by up to ±0.6 s: most text for the time, near the middle length.

    A clip meets its segments once, in its widest shift; what moves of a segment is its number of words, not its text.
    """
    reach = 2 * step_ms
    text = F.coalesce("text", F.lit(""))
    edge = lambda at: F.when(F.trim(text) != "", at.cast("int"))
    counted = segments.select(
        "episode_id", "seg_idx", "start_ms", "end_ms", F.regexp_count(text, F.lit(r"\S+")).alias("_words"),
        edge(F.ltrim(text).rlike(r"\A\s")).alias("_head"), edge(F.rtrim(text).rlike(r"\s\z")).alias("_tail"),
    )
    wide = clips.select("episode_id", "clip_id", F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"))
    wide = wide.withColumn("_lo", F.greatest(F.col("clip_start") - reach, F.lit(0))).withColumn("_hi", F.col("clip_end") + reach)
    more = lambda a, b: F.least("end_ms", "_hi") - F.greatest("start_ms", "_lo") > 500
    met = range_join(counted, wide, "episode_id", ("start_ms", "end_ms"), ("_lo", "_hi"), more)
    segment = F.struct("seg_idx", "start_ms", "end_ms", "_words", "_head", "_tail")
    rows = met.groupBy("episode_id", "clip_id", "clip_start", "clip_end").agg(F.sort_array(F.collect_list(segment)).alias("_met"))
    shifts = [i * step_ms for i in range(-2, 3)]
    cells = F.array(*(F.struct(F.greatest(F.col("clip_start") + a, F.lit(0)).alias("a"), (F.col("clip_end") + b).alias("b")) for a in shifts for b in shifts))

    def filled(c: Column) -> Column:
        inside = F.filter("_met", lambda s: F.least(s["end_ms"], c["b"]) - F.greatest(s["start_ms"], c["a"]) > 500)
        return F.struct(c["a"].alias("a"), c["b"].alias("b"), inside.alias("inside"))

    def valued(c: Column) -> Column:
        # parts of the texts joined by spaces, trimmed and split at white space: an edge other than a space has an empty part beyond it
        known = lambda name: F.array_compact(F.transform(c["inside"], lambda s: s[name]))
        outer = F.coalesce(F.get(known("_head"), F.lit(0)), F.lit(0)) + F.coalesce(F.try_element_at(known("_tail"), F.lit(-1)), F.lit(0))
        n = F.greatest(F.aggregate(c["inside"], F.lit(0), lambda total, s: total + s["_words"]) + outer, F.lit(1))
        seconds = (c["b"] - c["a"]) / 1000
        return F.struct(F.round(n / seconds - F.abs(seconds - 18) / 18, 6).alias("value"), (-c["a"]).alias("start"), (-c["b"]).alias("end"))

    taken = F.filter(F.transform(F.filter(cells, lambda c: c["b"] > c["a"]), filled), lambda c: F.size(c["inside"]) > 0)
    rows = rows.select("episode_id", "clip_id", F.array_max(F.transform(taken, valued)).alias("_best")).where("_best is not null")
    return rows.select("episode_id", "clip_id", (-F.col("_best.start")).alias("start_ms"), (-F.col("_best.end")).alias("end_ms"), F.col("_best.value").alias("value"))


def extend_end(clips: DataFrame, eos: DataFrame, more_ms: int = 5_000, most_ms: int | None = None) -> DataFrame:
    """Ends moved on to the next mark within `more_ms`, unless the clip would pass `most_ms`; with the move's size."""
    rows = next_eos(clips, eos, "end_ms")
    fits = F.col("next_ms") - F.col("end_ms") <= more_ms
    if most_ms is not None:
        fits &= F.col("next_ms") - F.col("start_ms") <= most_ms
    moved = F.when(fits, F.col("next_ms")).otherwise(F.col("end_ms"))
    return rows.withColumn("moved_ms", moved - F.col("end_ms")).withColumn("end_ms", moved).drop("next_ms")


def extend_capped(clips: DataFrame, eos: DataFrame, more_ms: int = 8_000, most_ms: int = 30_000, least_ms: int = 50) -> DataFrame:
    """Ends moved on to the first mark from `least_ms` after them, within `more_ms`, in clips of `most_ms` at most."""
    rows = next_eos(clips.withColumn("_from", F.col("end_ms") + least_ms), eos, "_from")
    fits = F.col("next_ms") <= F.least(F.col("start_ms") + most_ms, F.col("end_ms") + more_ms)
    return rows.withColumn("end_ms", F.when(fits, F.col("next_ms")).otherwise(F.col("end_ms"))).drop("_from", "next_ms")


def coherent_end(clips: DataFrame, eos: DataFrame, segments: DataFrame, more_ms: int = 5_000) -> DataFrame:
    """Ends moved on to the next mark after them within `more_ms`, else to the next end of a segment at or after them."""
    ends = segments.select("episode_id", F.col("end_ms").alias("t_ms"))
    rows = next_eos(clips.withColumn("_from", F.col("end_ms") + 1), eos, "_from").withColumnRenamed("next_ms", "_ahead")
    rows = next_eos(rows, ends, "end_ms")
    near = lambda c: F.when(F.col(c) - F.col("end_ms") <= more_ms, F.col(c))
    return rows.withColumn("end_ms", F.coalesce(near("_ahead"), near("next_ms"), "end_ms")).drop("_from", "_ahead", "next_ms")


def natural_end(clips: DataFrame, words: DataFrame, more_ms: int = 3_000) -> DataFrame:
    """Ends moved on to the next word within `more_ms` that ends a sentence: a final mark, then a capital or nothing; with the move's size."""
    after = F.lead("w").over(Window.partitionBy("episode_id").orderBy("word_idx"))
    ends = words.withColumn("_after", after).where(F.rtrim("w").rlike(ENDS) & (F.col("_after").isNull() | F.ltrim("_after").rlike(r"^\p{Lu}")))
    rows = next_eos(clips.withColumn("_from", F.col("end_ms") + 1), ends.select("episode_id", F.col("end_ms").alias("t_ms")), "_from")
    moved = F.when(F.col("next_ms") - F.col("end_ms") <= more_ms, F.col("next_ms") - F.col("end_ms")).otherwise(F.lit(0))
    return rows.withColumn("moved_ms", moved.cast("long")).withColumn("end_ms", F.col("end_ms") + F.col("moved_ms")).drop("_from", "next_ms")


def micro_jitter(clips: DataFrame, words: DataFrame, slack_ms: int = 250) -> DataFrame:
    """Ends moved to the end of the first word inside ±`slack_ms` of them that finishes a sentence; keyed by clip_id.

    Only a clip's last moments meet words, so a clip meets few, however long it is.
    """
    heads = clips.select("episode_id", "clip_id", F.col("start_ms").alias("c_start"), (F.col("end_ms") - slack_ms).alias("c_from"), (F.col("end_ms") + slack_ms).alias("c_to")).distinct()
    closing = words.where(F.rtrim("w").rlike(CLOSED)).select("episode_id", "word_idx", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    inside = lambda a, b: (F.col("w_start") >= F.col("c_from")) & (F.col("w_end") <= F.col("c_to")) & (F.col("w_start") >= F.col("c_start"))
    met = range_join(heads, closing, "episode_id", ("c_from", "c_to"), ("w_start", "w_end"), inside)
    to = met.groupBy("episode_id", "clip_id", "c_start", "c_to").agg(F.min_by("w_end", "word_idx").alias("_to"))
    to = to.select(F.col("episode_id").alias("_e"), F.col("clip_id").alias("_c"), F.col("c_start").alias("_s"), (F.col("c_to") - slack_ms).alias("_end"), "_to")
    same = F.col("episode_id").eqNullSafe(F.col("_e")) & F.col("clip_id").eqNullSafe(F.col("_c")) & (F.col("start_ms") == F.col("_s")) & (F.col("end_ms") == F.col("_end"))
    return clips.join(to, same, "left").withColumn("end_ms", F.coalesce("_to", "end_ms")).drop("_e", "_c", "_s", "_end", "_to")


def finish_normalize(clips: DataFrame, eos: DataFrame, near_ms: int = 300, more_ms: int = 800, sparse: bool = False) -> DataFrame:
    """Ends on or near a mark are finished, those before one are moved to it; else the text decides."""
    rows = prev_eos(next_eos(clips, eos, "end_ms"), eos, "end_ms")
    gap = F.least(F.coalesce(F.col("next_ms") - F.col("end_ms"), F.lit(10**9)), F.coalesce(F.col("end_ms") - F.col("prev_ms"), F.lit(10**9)))
    extend = F.col("next_ms") - F.col("end_ms") <= more_ms
    ends = F.rtrim("text").rlike(ENDS)
    status = F.when(gap <= near_ms, "finished").when(extend, "finished").when(ends, "sparse_finished" if sparse else "finished").otherwise("unresolved")
    end = F.when((gap > near_ms) & extend, F.col("next_ms")).otherwise(F.col("end_ms"))
    return rows.withColumn("status", status).withColumn("end_ms", end).drop("next_ms", "prev_ms")


TARGETS = (8_000, 12_000, 18_000, 24_000, 30_000, 45_000, 60_000, 90_000)


def length_variants(clips: DataFrame, eos: DataFrame, targets=TARGETS, slack_ms: int = 2_000) -> DataFrame:
    """For each clip and target length, the end on a mark nearest to it, within ±2 s."""
    rows = clips.select("episode_id", "clip_id", "start_ms", F.explode(F.array(*(F.lit(t).cast("long") for t in targets))).alias("target"))
    rows = rows.withColumn("lo", F.col("start_ms") + F.col("target") - slack_ms).withColumn("hi", F.col("start_ms") + F.col("target") + slack_ms)
    near = lambda a, b: F.col("t_ms").between(F.col("lo"), F.col("hi"))
    found = range_join(eos.select("episode_id", "t_ms").distinct(), rows, "episode_id", ("t_ms", "t_ms"), ("lo", "hi"), near)
    off = F.abs(F.col("t_ms") - F.col("start_ms") - F.col("target"))
    return found.groupBy("episode_id", "clip_id", "start_ms", "target").agg(F.min_by("t_ms", F.struct(off, "t_ms")).alias("end_ms"))


def pick_variant(variants: DataFrame, score: str = "score", ms=(7_500, 90_000)) -> DataFrame:
    """One variant of each clip: in the limits, finished ones first, then by score, then shorter."""
    rows = variants.where((F.col("end_ms") - F.col("start_ms")).between(*ms))
    order = [F.desc("finished")] if "finished" in variants.columns else []
    rank = F.row_number().over(Window.partitionBy("episode_id", "clip_id").orderBy(*order, F.desc(score), "end_ms"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def hysteresis(current: DataFrame, candidates: DataFrame, least: float = 0.03, bonus: float = 0.005) -> DataFrame:
    """The current bounds, unless a candidate is better by more than least + bonus; of several, the best."""
    best = candidates.groupBy("clip_id").agg(F.max_by(F.struct("start_ms", "end_ms", "score"), F.struct("score", -F.col("start_ms"), -F.col("end_ms"))).alias("c"))
    rows = current.join(best, "clip_id", "left")
    better = F.coalesce(F.col("c.score") > F.col("score") + bonus + least, F.lit(False))
    pick = lambda n: F.when(better, F.col(f"c.{n}")).otherwise(F.col(n)).alias(n)
    return rows.select("clip_id", pick("start_ms"), pick("end_ms"), pick("score"), better.alias("moved"))


def find_moments(segments: DataFrame, markers: dict[str, str], least_ms: int = 8_000, most_ms: int = 60_000, grow: int = 4) -> DataFrame:
    """Windows that begin at a segment with a marker of some kind and grow over the next segments to a length in the
    limits; the shortest that ends a sentence, else the shortest."""
    spans = []
    for k in range(grow + 1):
        order = _by("seg_idx")
        end = F.lead("end_ms", k).over(order) if k else F.col("end_ms")
        text = F.lead("text", k).over(order) if k else F.col("text")
        spans.append(F.struct(F.lit(k).alias("k"), end.alias("e"), F.coalesce(text.rlike(ENDS), F.lit(False)).alias("ends")))
    lower = F.lower("text")
    kinds = F.array_compact(F.array(*(F.when(lower.rlike(p), F.lit(n)) for n, p in sorted(markers.items()))))
    rows = segments.select("episode_id", "seg_idx", "start_ms", kinds.alias("kinds"), F.array(*spans).alias("spans"))
    rows = rows.select("episode_id", "seg_idx", "start_ms", F.explode("kinds").alias("kind"), "spans").withColumn("s", F.explode("spans")).where("s.e is not null")
    rows = rows.where((F.col("s.e") - F.col("start_ms")).between(least_ms, most_ms))
    best = F.min_by(F.struct(F.col("s.e").alias("e"), F.col("s.k").alias("k")), F.struct((~F.col("s.ends")).cast("int"), F.col("s.k")))
    return rows.groupBy("episode_id", "seg_idx", "kind", "start_ms").agg(best.alias("b")).select("episode_id", "seg_idx", "kind", "start_ms", F.col("b.e").alias("end_ms"), (F.col("b.k") + 1).cast("long").alias("n_segments"))


def trim_fillers(clips: DataFrame, words: DataFrame, fillers=("uh", "um", "er", "ah", "like", "so", "well", "okay", "ok"), most_ms: int = 2_000) -> DataFrame:
    """Starts moved on to the first word that is no filler, by `most_ms` at most."""
    spans = clips.select("episode_id", "clip_id", F.col("start_ms").alias("lo"), (F.col("start_ms") + most_ms).alias("hi"))
    solid = words.where(~F.lower(F.regexp_replace("w", r"[^\p{L}]", "")).isin(*fillers))
    near = lambda a, b: F.col("start_ms").between(F.col("lo"), F.col("hi"))
    first = range_join(solid, spans, "episode_id", ("start_ms", "end_ms"), ("lo", "hi"), near).groupBy("episode_id", "clip_id").agg(F.min("start_ms").alias("_first"))
    return clips.join(first, ["episode_id", "clip_id"], "left").withColumn("start_ms", F.coalesce("_first", "start_ms")).drop("_first")
