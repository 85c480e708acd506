"""Joins of words, segments, marks, clips, lexicons and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.patterns import asof_join, gather, iou, jaccard, range_join
from cliploom.operators.phrases import few, phrase_hits, substring_hits
from cliploom.operators.vectors import distinct_vectors, similar_pairs
from cliploom.operators.written import written

FILLERS = ("uh", "um")


def _clips(clips: DataFrame) -> DataFrame:
    return clips.select("episode_id", "clip_id", F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"))


def _padded(clips: DataFrame, pad_ms: int) -> DataFrame:
    return _clips(clips).withColumn("lo", F.greatest(F.col("clip_start") - pad_ms, F.lit(0))).withColumn("hi", F.col("clip_end") + pad_ms)


def words_overlap_clips(words: DataFrame, clips: DataFrame, pad_ms: int = 250) -> DataFrame:
    """Words that overlap [start - pad, end + pad] of a clip."""
    touch = lambda a, b: (F.col("start_ms") < F.col("hi")) & (F.col("end_ms") > F.col("lo"))
    return range_join(words, _padded(clips, pad_ms), "episode_id", ("start_ms", "end_ms"), ("lo", "hi"), touch).drop("lo", "hi")


def words_contained_in(words: DataFrame, clips: DataFrame, tolerance_ms: int = 80, drop_fillers: bool = True) -> DataFrame:
    """Words that lie in a clip but for `tolerance_ms` at either end; "uh" and "um" may be left out."""
    if drop_fillers:
        words = words.where(~F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).isin(*FILLERS))
    inside = lambda a, b: (F.col("start_ms") >= F.col("lo")) & (F.col("end_ms") <= F.col("hi"))
    return range_join(words, _padded(clips, tolerance_ms), "episode_id", ("start_ms", "end_ms"), ("lo", "hi"), inside).drop("lo", "hi")


def words_clamped_to_clip(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Words of each clip on the clip's own clock (t, d in seconds, two decimals), cut at its ends, slivers gone.

    A clip finds its words in the array of its stretch of the episode, so no word moves for each clip that holds it.
    """
    others = [c for c in words.columns if c not in ("episode_id", "word_idx")]
    rows = gather(words, _clips(clips), "episode_id", ("start_ms", "end_ms"), ("clip_start", "clip_end"), ["word_idx", *others])
    cut = lambda start, end: F.least(end, "clip_end") - F.greatest(start, "clip_start")
    # More than a sliver of the word lies in the clip; plain comparisons, as they are interpreted for each word near the clip.
    rows = rows.where("clip_end - clip_start > 1").withColumn("_low", F.col("clip_start") + 1).withColumn("_high", F.col("clip_end") - 1)
    inside = F.filter("_near", lambda x: (x["end_ms"] > F.col("_low")) & (x["start_ms"] < F.col("_high")) & (x["end_ms"] - x["start_ms"] > 1))
    found = F.flatten(F.transform(F.array(inside), lambda own: F.transform(own, lambda x, i: F.struct(x.alias("x"), (i + 1 == F.size(own)).alias("last")))))
    rows = rows.select("episode_id", "clip_id", "clip_start", "clip_end", F.explode(found).alias("_w"))
    rows = rows.select("episode_id", *(F.col(f"_w.x.{c}").alias(c) for c in words.columns if c != "episode_id"), "clip_id", "clip_start", "clip_end", F.col("_w.last").alias("_last"))
    # Hundredths of whole milliseconds, none below 0: F.round on doubles goes through decimals, three times for each row.
    hundredths = lambda ms: F.floor((ms + 5) / 10) / 100
    rows = rows.withColumn("t", hundredths(F.greatest("start_ms", "clip_start") - F.col("clip_start"))).withColumn("d", hundredths(cut("start_ms", "end_ms")))
    room = hundredths(F.col("clip_end") - F.col("clip_start")) - F.col("t")
    return rows.withColumn("d", F.when(F.col("_last"), F.least(F.col("d"), F.round(room, 2))).otherwise(F.col("d"))).drop("_last")


def ordered_text(order: str, text: str) -> Column:
    """Texts of a group in order, joined by spaces."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")


def clip_transcript(clips: DataFrame, words: DataFrame, segments: DataFrame, tolerance_ms: int = 80) -> DataFrame:
    """Each clip's text from its words, else from segments it overlaps, else its own; with the source and coverage.

    Words come from the array of the clip's stretch of the episode. Segments and own texts are read for clips without words only.
    """
    near = gather(words, _padded(clips, tolerance_ms), "episode_id", ("start_ms", "end_ms"), ("lo", "hi"), ["word_idx", "w", "start_ms", "end_ms"])
    inside = F.filter("_near", lambda x: (x["start_ms"] >= F.col("lo")) & (x["end_ms"] <= F.col("hi")))
    spoken = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["end_ms"] - x["start_ms"])
    said = lambda own: F.struct(F.array_join(F.transform(own, lambda x: x["w"]), " ").alias("text"), F.size(own).cast("long").alias("n"), spoken(own).alias("ms"))
    one = near.select("episode_id", "clip_id", F.col("clip_start").alias("start_ms"), F.col("clip_end").alias("end_ms"), F.transform(F.array(inside), said)[0].alias("_own"))
    count, ms = F.coalesce("_own.n", F.lit(0)).cast("long"), F.coalesce("_own.ms", F.lit(0))
    coverage = F.round(F.least(ms / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)), F.lit(1.0)), 6)
    spaced = lambda t: F.regexp_replace(t, r"\s+([,.!?;:])", "$1")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = one.select("episode_id", "clip_id", spaced(F.nullif("_own.text", F.lit(""))).alias("word_text"), count.alias("n_words"), coverage.alias("coverage"), "start_ms", "end_ms")
    rows = written(rows, "spoken")
    done = rows.where("word_text is not null").select("episode_id", "clip_id", F.col("word_text").alias("transcript"), F.lit("words").alias("source"), "n_words", "coverage")
    silent = rows.where("word_text is null").drop("word_text")
    if silent.isEmpty():
        return done
    ids = silent.select("episode_id", "clip_id").distinct()
    told = range_join(
        segments.select("episode_id", "seg_idx", "start_ms", "end_ms", "text"), _clips(silent), "episode_id", ("start_ms", "end_ms"), ("clip_start", "clip_end"),
        lambda a, b: (F.col("start_ms") < F.col("clip_end")) & (F.col("end_ms") > F.col("clip_start")),
    ).groupBy("episode_id", "clip_id").agg(ordered_text("seg_idx", "text").alias("segment_text"))
    own = clips.select("episode_id", "clip_id", "start_ms", "end_ms", "text").join(ids, ["episode_id", "clip_id"], "left_semi")
    same = [silent[c].eqNullSafe(own[c]) for c in ("episode_id", "clip_id", "start_ms", "end_ms")]
    rest = silent.join(own.distinct(), same, "left").select(silent["*"], own["text"]).join(told, ["episode_id", "clip_id"], "left")
    text = F.when(has("segment_text"), F.col("segment_text")).otherwise(F.coalesce("text", F.lit("")))
    source = F.when(has("segment_text"), "segments").otherwise("clip")
    return done.unionByName(rest.select("episode_id", "clip_id", spaced(text).alias("transcript"), source.alias("source"), "n_words", "coverage"))


def segment_window_text(segments: DataFrame, windows: DataFrame, least_ms: int = 500) -> DataFrame:
    """Text of the segments that overlap a window (episode_id, clip_id, start_ms, end_ms) by more than `least_ms`.

    Equal windows are one row, which holds its segments once for each. Texts move by stretches of an episode, not by windows.
    """
    once = _clips(windows).groupBy("episode_id", "clip_id", "clip_start", "clip_end").agg(F.count("*").cast("int").alias("_times"))
    near = gather(segments, once, "episode_id", ("start_ms", "end_ms"), ("clip_start", "clip_end"), ["seg_idx", "text", "start_ms", "end_ms"])
    more = F.filter("_near", lambda x: F.least(x["end_ms"], "clip_end") - F.greatest(x["start_ms"], "clip_start") > least_ms)
    told = lambda own: F.struct(F.array_join(F.flatten(F.transform(own, lambda x: F.array_repeat(x["text"], F.col("_times")))), " ").alias("text"), (F.size(own) * F.col("_times")).cast("long").alias("n"))
    rows = near.select("episode_id", "clip_id", F.col("clip_start").alias("start_ms"), F.col("clip_end").alias("end_ms"), F.explode(F.transform(F.filter(F.array(more), lambda own: F.size(own) > 0), told)).alias("_own"))
    return rows.select("episode_id", "clip_id", "start_ms", "end_ms", "_own.text", F.col("_own.n").alias("n_segments"))


def attach_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with the words that touch them."""
    spans = segments.select("episode_id", "seg_idx", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    touch = lambda a, b: (F.col("end_ms") > F.col("seg_start")) & (F.col("start_ms") < F.col("seg_end"))
    rows = range_join(words.drop("seg_idx"), spans, "episode_id", ("start_ms", "end_ms"), ("seg_start", "seg_end"), touch)
    return rows.groupBy("episode_id", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "w", "start_ms", "end_ms"))).alias("words"))


# --- as-of -------------------------------------------------------------------------------------------------------


def next_eos(left: DataFrame, marks: DataFrame, time: str = "end_ms") -> DataFrame:
    """First mark at or after each time."""
    return asof_join(left, marks, "episode_id", time, "t_ms", forward=True, out="next_ms")


def prev_eos(left: DataFrame, marks: DataFrame, time: str = "end_ms") -> DataFrame:
    """Last mark before each time."""
    return asof_join(left, marks, "episode_id", time, "t_ms", forward=False, strict=True, out="prev_ms")


def near_eos(left: DataFrame, marks: DataFrame, tolerance_ms: int = 250, time: str = "end_ms") -> DataFrame:
    """Whether a mark lies within the tolerance."""
    rows = prev_eos(next_eos(left, marks, time), marks, time)
    gap = F.least(F.col("next_ms") - F.col(time), F.col(time) - F.col("prev_ms"))
    return rows.withColumn("near", F.coalesce(gap <= tolerance_ms, F.lit(False))).drop("next_ms", "prev_ms")


def snap_to_word_end(left: DataFrame, words: DataFrame, time: str = "end_ms") -> DataFrame:
    """The last word end before each time; where there is none, the first one."""
    ends = words.select("episode_id", F.col("end_ms").alias("t_ms"))
    rows = prev_eos(left, ends, time).join(ends.groupBy("episode_id").agg(F.min("t_ms").alias("first_ms")), "episode_id", "left")
    return rows.withColumn("snapped_ms", F.coalesce("prev_ms", "first_ms", time)).drop("prev_ms", "first_ms")


def snap_nearest(left: DataFrame, marks: DataFrame, window_ms: int = 250, time: str = "end_ms") -> DataFrame:
    """The nearest mark within the window (the earlier of two equally near), else the time itself."""
    rows = prev_eos(next_eos(left, marks, time), marks, time)
    ahead, behind = F.col("next_ms") - F.col(time), F.col(time) - F.col("prev_ms")
    use_prev = F.coalesce(behind <= window_ms, F.lit(False)) & (F.col("next_ms").isNull() | (behind <= ahead))
    use_next = F.coalesce(ahead <= window_ms, F.lit(False))
    return rows.withColumn("snapped_ms", F.when(use_prev, F.col("prev_ms")).when(use_next, F.col("next_ms")).otherwise(F.col(time))).drop("next_ms", "prev_ms")


# --- lexicons ----------------------------------------------------------------------------------------------------


def token_hits(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lexicon, term, n) of single-word terms; words are runs of letters, digits and apostrophes, lower case."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9']+"), 0)).alias("term"))
    counted = words.groupBy(key, "term").agg(F.count("*").alias("n"))
    return counted.join(lexicon.select("lexicon", "term", "weight"), "term")


def lexicon_match(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lexicon, n_terms, score): terms present in each text and their summed weight.

    `token` terms are matched by an equi-join on the words. `substring` terms are expressions over the text while they
    are few, and automata beyond that. `regex` terms are a list that a programmer writes: one expression each.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    names = ["lexicon", "term", "weight"]
    parts = lexicon.where("match_mode = 'substring'").select(*names, "match_mode")
    listed = few(parts)
    terms = (listed or []) + lexicon.where("match_mode not in ('token', 'substring')").select(*names, "match_mode").collect()
    tests = [
        F.when(lower.contains(r.term) if r.match_mode == "substring" else lower.rlike(r.term), F.struct(F.lit(r.lexicon).alias("lexicon"), F.lit(r.term).alias("term"), F.lit(r.weight).cast("double").alias("weight")))
        for r in terms
    ]
    single = token_hits(docs, lexicon.where("match_mode = 'token'"), key, text).select(key, "lexicon", "term", F.col("weight").cast("double").alias("weight"))
    if tests:
        rows = docs.select(key, F.explode(F.array_compact(F.array(*tests))).alias("x"))
        single = single.unionByName(rows.select(key, "x.lexicon", "x.term", "x.weight"))
    if listed is None:
        single = single.unionByName(substring_hits(docs, parts.select("lexicon", "term", F.col("weight").cast("double").alias("weight")), key, text))
    return single.groupBy(key, "lexicon").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("score"))


def trend_hits(docs: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, category, term, weight) where the term or one of its aliases is among the text's words, or, for phrases,
    stands in them side by side. Words and, once they are more than a few, phrases are matched by joins."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9']+"), 0)
    spelled = terms.select("category", "term", "weight", F.explode(F.array_union(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    spelled = spelled.withColumn("form", F.lower("form"))
    single = docs.select(key, F.explode(F.array_distinct(ws)).alias("form")).join(spelled.where(~F.contains("form", F.lit(" "))), "form")
    hits = single.select(key, "category", "term", "weight")
    several = spelled.where(F.contains("form", F.lit(" ")))
    phrases = few(several)
    if phrases is None:
        hits = hits.unionByName(phrase_hits(docs, several, key, text).select(key, "category", "term", "weight"))
    elif phrases:
        whole = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
        row = lambda r: F.struct(F.lit(r.category).alias("category"), F.lit(r.term).alias("term"), F.lit(r.weight).cast("double").alias("weight"))
        rows = docs.select(key, whole.alias("whole"))
        found = F.array_compact(F.array(*(F.when(F.contains("whole", F.lit(f" {r.form} ")), row(r)) for r in phrases)))
        hits = hits.unionByName(rows.select(key, found.alias("x")).select(key, F.explode("x").alias("x")).select(key, "x.category", "x.term", "x.weight"))
    return hits.distinct()


NEGATIONS = ("not", "no", "never", "isn't", "wasn't", "don't", "didn't", "can't", "won't")


def emotion_hits(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text", least: float = 0.20, most: float = 1.50, words: int = 300) -> DataFrame:
    """(key, family, score) over the first `words` words: a word's weight, turned round where one of the three words
    before is a negation; weights under `least` are dropped and those over `most` cut."""
    listed = docs.select(key, F.posexplode(F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9']+"), 0), 1, words)).alias("pos", "term"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(-3, -1)
    negated = F.max(F.col("term").isin(*NEGATIONS).cast("int")).over(before)
    hits = listed.withColumn("negated", F.coalesce(negated, F.lit(0))).join(lexicon.select("term", F.col("lexicon").alias("family"), "weight"), "term")
    weight = F.least(F.abs("weight"), F.lit(most))
    hits = hits.where(F.abs("weight") >= least).withColumn("w", F.when(F.col("negated") == 1, -weight).otherwise(weight))
    return hits.groupBy(key, "family").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("n"))


def clip_lookup(clips: DataFrame, titles: DataFrame) -> DataFrame:
    """Clips with their titles by platform."""
    return clips.select("clip_id", "episode_id").join(titles, "clip_id", "left")


def untitled(clips: DataFrame, titles: DataFrame) -> DataFrame:
    return clips.join(titles.select("clip_id").distinct(), "clip_id", "left_anti")


def remove_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the flagged ones."""
    return df.join(flagged.select(key).distinct(), key, "left_anti")


# --- pairs -------------------------------------------------------------------------------------------------------


def interval_pairs(clips: DataFrame, least: float = 0.0, hull: bool = False) -> DataFrame:
    """(episode_id, a, b, iou) of clips of an episode that overlap; a < b."""
    low, high = F.least("start_ms", "end_ms"), F.greatest("start_ms", "end_ms")
    one = clips.select("episode_id", F.col("clip_id").alias("a"), low.alias("a_start"), high.alias("a_end")).where("a_start < a_end")
    two = clips.select("episode_id", F.col("clip_id").alias("b"), low.alias("b_start"), high.alias("b_end")).where("b_start < b_end")
    touch = lambda x, y: (F.col("a") < F.col("b")) & (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    pairs = range_join(one, two, "episode_id", ("a_start", "a_end"), ("b_start", "b_end"), touch)
    share = iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"), hull)
    return pairs.select("episode_id", "a", "b", share.alias("iou")).where(F.col("iou") >= least)


def jaccard_pairs(docs: DataFrame, key: str, by: str, least: float = 0.6, text: str = "text") -> DataFrame:
    """(by, a, b, similarity) of texts of a group with word sets of similarity `least` or more.

    Prefix filter: similar sets share one of their rarest words, so only pairs that do are compared.
    """
    sets = docs.select(by, key, F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+")).alias("ws"))
    words = sets.select(by, key, F.size("ws").alias("size"), F.explode("ws").alias("w"))
    rare = words.groupBy(by, "w").agg(F.count("*").alias("df"))
    order = Window.partitionBy(by, key).orderBy("df", "w")
    kept = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    prefix = words.join(rare, [by, "w"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    one = prefix.select(by, "w", F.col(key).alias("a"))
    two = prefix.select(by, "w", F.col(key).alias("b"))
    pairs = one.join(two, [by, "w"]).where("a < b").select(by, "a", "b").distinct()
    left = sets.select(by, F.col(key).alias("a"), F.col("ws").alias("x"))
    right = sets.select(by, F.col(key).alias("b"), F.col("ws").alias("y"))
    return pairs.join(left, [by, "a"]).join(right, [by, "b"]).select(by, "a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two numeric arrays, in double precision."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def cosine_pairs(embeddings: DataFrame, key: str, block: str, vector: str, least: float = 0.92) -> DataFrame:
    """(block, a, b, similarity) of all vectors of one block with cosine `least` or more; a < b. See operators.vectors.

    Copies of a vector are compared once and joined in afterwards, so the result has as many rows as there are pairs.
    """
    once = distinct_vectors(embeddings, key, block, vector)
    unit = written(once, "distinct")
    pairs = similar_pairs(unit, least)
    rows = embeddings.select(F.col(block).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    first = rows.groupBy("g", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copied = first.where("n > 1").select(F.col("g").alias("_g"), F.col("v").alias("_v"), "first")
    copies = rows.join(copied, rows.g.eqNullSafe(F.col("_g")) & (rows.v == F.col("_v"))).select("g", "first", "id")
    copies = written(copies.join(unit.select(F.col("g").alias("_g"), F.col("id").alias("_id")), F.col("g").eqNullSafe(F.col("_g")) & (F.col("first") == F.col("_id")), "left_semi"), "copies")

    def members(df: DataFrame, column: str) -> DataFrame:
        other = copies.select(F.col("g").alias("_g"), F.col("first").alias("_first"), F.col("id").alias("_id"))
        joined = df.join(other, df.g.eqNullSafe(F.col("_g")) & (df[column] == F.col("_first")), "left")
        return joined.withColumn(column, F.coalesce("_id", column)).drop("_g", "_first", "_id")

    between = members(members(pairs, "a"), "b")
    between = between.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    two = copies.select(F.col("g").alias("_g"), F.col("first").alias("_first"), F.col("id").alias("b"))
    inside = copies.join(two, copies.g.eqNullSafe(F.col("_g")) & (copies["first"] == F.col("_first")) & (copies["id"] < F.col("b")))
    inside = inside.select("g", F.col("id").alias("a"), "b", F.lit(1.0).alias("similarity")).where(F.lit(least <= 1))
    return between.unionByName(inside).withColumnRenamed("g", block)


def payoff_guard(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Score cut at its genre's cap where the text after its first 100 characters shows no payoff."""
    rows = df.join(caps.select("genre", "cap"), "genre", "left")
    rest = F.substring(F.lower("text"), F.lit(101), F.length("text"))
    shown = rest.rlike(r"\b(so|that means|because|the (answer|takeaway|key) is|here'?s (how|why))\b")
    return rows.withColumn("score", F.when(shown | F.col("cap").isNull(), F.col("score")).otherwise(F.least("score", "cap"))).drop("cap")
