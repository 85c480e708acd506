"""The wide table of text features: one projection over segments (text, start_ms, end_ms), no Python functions.

Columns are built from whole-text expressions, so a table of any size is one scan. Lexicons that users change are
tables (see lexicons.py and joins.lexicon_match); the short cue lists of a formula stand beside it as fixed values.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- pieces ------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Whitespace tokens; none of an empty text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def n_capitals(text: Column, least: int) -> Column:
    """How many words are all capitals A to Z, of `least` letters or more; a line separator may end such a word."""
    return F.regexp_count(text, F.lit(rf"(?<!\S)[A-Z]{{{least},}}(?=[\u0085\u2028\u2029]?(?!\S))"))


def n_words(text: Column) -> Column:
    return F.size(words(text))


def hits(text: Column, phrases) -> Column:
    """How many of the phrases occur somewhere in the text."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(p)).cast("int") for p in phrases))


def any_hit(text: Column, phrases) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tent(x: Column, peak: float, width: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(x - peak) / width)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def saturate(parts: list[Column]) -> Column:
    """1 - (1 - a)(1 - b)..."""
    return 1 - reduce(lambda a, b: a * b, ((1 - p) for p in parts))


def seconds() -> Column:
    return (F.col("end_ms") - F.col("start_ms")) / 1000


# --- fixed values ------------------------------------------------------------------------------------------------

#: Cue phrases of the hook, arousal, payoff, information and emotion formulas.
HOOK_CUES = (
    "you", "imagine", "what if", "did you know", "here's why", "the secret", "shocking", "amazing", "incredible", "unbelievable",
    "mind-blowing", "here's what", "the truth is", "the key", "the trick", "the secret", "what happens when", "why do", "how did", "here's how",
)
CONTRA_OPEN = r"\b(most|many|people|everyone|they)\s+(think|say|assume)\b"
CONTRA_FLIP = r"\bbut\s+actually\b|\bhowever\b|\bbut\s+(it|this)\s+isn'?t\b"
COMPARISONS = ("vs", "versus", "more than", "less than", "better than", "worse than")
HOOK_STARTS = (
    r"^(how|why|what|top\s?\d+|the secret|3 ways|you won.t believe)", r"^(here.s|let me|i.m going to|the thing is)",
    r"^(did you know|here.s the thing|the secret to)", r"^(listen|look|wait|hold on)",
)
PRERANK_ADS = (
    "sponsored by", "brought to you by", "use code", "promo code", "check out", "visit our", "subscribe", "my course", "my book",
    "link in bio", "special offer", "limited time",
)
AD_PHRASES = (
    "brought to you by", "sponsored by", "use code", "limited time", "shop now", "link in bio", "link in description", "free shipping",
    "visit", "learn more", "order today", "act now", "save", "discount",
)
AD_CALLS = ("shop", "buy", "save", "order", "visit", "subscribe", "download", "sign", "sign up")
LIKE_PHRASES = (
    "this episode is sponsored by", "sponsored by", "use code", "promo code", "limited time offer", "free shipping", "visit our website",
    "visit ", "order now", "call now", "call today", "learn more", "shop now", "click the link", "link in the description", "terms apply",
    "see site for details",
)
FILLERS = ("you know", "like", "um", "uh", "right", "so")
STRONG_EMOTIONS = ("amazing", "incredible", "unbelievable", "love", "hate", "terrified", "furious", "heartbroken")
EMOTIONS = ("happy", "sad", "angry", "excited", "scared", "surprised", "proud", "worried")
INTENSE = ("insane", "crazy", "wild", "shocking", "unreal", "literally", "never", "ever")
URGENT = ("now", "today", "immediately", "right away", "before it's too late")
UNSURE = ("maybe", "i guess", "not sure", "kind of", "sort of", "perhaps")
CAUSES = ("because", "therefore", "so that", "which means", "as a result", "that's why")
INSIGHTS = {"contrast": 0.8, "number": 0.7, "comparison": 0.6, "causal": 0.5, "imperative": 0.6}
DOMAIN = r"\b(?:https?://|www\.)?[a-z0-9-]+\.(?:com|net|org|io|co)\b"
#: Four letters, each with a space, dash or dot after it or nothing, and a domain's ending. Letters before the fourth from
#: the end matter only back to the start of their word, so the rule "three letters or more" needs no open repetition.
SPELLED = r"\b[a-z]*(?:[a-z](?:\s*-\s*|\.?\s*)){3}[a-z]\s*(?:dot|\.)\s*(?:com|net|org|io|co)\b"
PHONE = r"\b(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}\b"
LINK = r"\b(?:(?:https?://|www\.)\S+|(?:bit\.ly|t\.co|tinyurl\.com|linktr\.ee|lnk\.to|amzn\.to|geni\.us|kit\.co)/\S+)"


# --- columns -----------------------------------------------------------------------------------------------------


def basics(text: Column) -> dict[str, Column]:
    ws = words(text)
    n = F.size(ws)
    chars = F.length(F.array_join(ws, ""))
    return {
        "word_count": n.cast("long"), "sentence_count": F.regexp_count(text, F.lit(r"[.!?]+")).cast("long"),
        "ends_sentence": F.rtrim(text).rlike("[.!?]$"), "caps_words": n_capitals(text, 2).cast("long"),
        "digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"), "shouts": F.regexp_count(text, F.lit("!")).cast("long"),
        "asks": F.regexp_count(text, F.lit(r"\?")).cast("long"), "mean_word": F.when(n > 0, F.round(chars / n, 6)).otherwise(0.0),
    }


def hook_v4(text: Column) -> Column:
    t, n = F.lower(text), n_words(text)
    flip = t.rlike(CONTRA_OPEN) & t.rlike(CONTRA_FLIP)
    score = flip.cast("int") * 0.15 + hits(t, HOOK_CUES) * 0.15 + text.contains("?").cast("int") * 0.25
    score += F.when(n < 8, 0.2).when(n < 15, 0.1).otherwise(0.0)
    score += F.least(F.regexp_count(text, F.lit("!")) * 0.1, F.lit(0.3))
    score += text.rlike("[0-9]").cast("int") * 0.1 + any_hit(t, COMPARISONS).cast("int") * 0.1
    return F.least(score, F.lit(1.0))


def hook_proxy(text: Column) -> Column:
    return F.trim(F.lower(text)).rlike("|".join(f"(?:{p})" for p in HOOK_STARTS)).cast("double")


def arousal_proxy(text: Column) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p))
    one = lambda c, w: F.least(F.lit(1.0), c * w)
    score = one(count("!"), 0.2) + one(count(r"\?"), 0.15) + one(count("wow"), 0.3) + one(count("crazy"), 0.3) + one(count("amazing"), 0.3)
    return F.least(F.lit(1.0), score + (text.contains("?") & (F.length(text) < 160)).cast("int") * 0.2)


def info_proxy(per_second: Column) -> Column:
    return F.when(per_second > 0, tent(per_second, 3.5, 3.5)).otherwise(0.0)


def duration_fit(s: Column, low: float = 8.0, high: float = 90.0) -> Column:
    return F.when(s < low, s / low).when(s > high, F.greatest(F.lit(0.0), 1 - (s - high) / high)).otherwise(1.0)


#: Weights of the cheap first score.
PRERANK = {"hook": 0.35, "arousal": 0.25, "info": 0.20, "duration": 0.15, "numbers": 0.05}


def prerank_score(text: Column, s: Column) -> Column:
    per_second = F.when(s > 0, n_words(text) / s).otherwise(0.0)
    numbers = text.rlike("[0-9]").cast("int")
    w = PRERANK
    return w["hook"] * hook_proxy(text) + w["arousal"] * arousal_proxy(text) + w["info"] * info_proxy(per_second) + w["duration"] * duration_fit(s) + w["numbers"] * numbers


def arousal(text: Column) -> Column:
    t, shouts = F.lower(text), F.regexp_count(text, F.lit("!"))
    caps = n_capitals(text, 3)
    score = F.when(shouts >= 3, 0.35).when(shouts >= 1, 0.2).otherwise(0.0) + F.least(caps * 0.1, F.lit(0.3))
    score += F.least(hits(t, INTENSE) * 0.1, F.lit(0.3)) + text.contains("?").cast("int") * 0.1 + F.least(hits(t, URGENT) * 0.05, F.lit(0.15))
    return clamp(score)


def info_density(text: Column) -> Column:
    """0.012 a word (0.3 at most), less 0.08 a filler (0.4), plus numbers and capitalised words (0.6)."""
    t = F.lower(text)
    base = F.least(F.lit(0.3), n_words(text) * 0.012)
    penalty = F.least(hits(t, FILLERS) * 0.08, F.lit(0.4))
    numbers = F.regexp_count(text, F.lit(r"\b\d+\b|[\$\d,]+|\d+%|\d+\.\d+"))
    proper = F.regexp_count(text, F.lit(r"(?<!\S)\p{Lu}\S{2,}"))
    return F.when(F.length(F.trim(text)) < 8, 0.1).otherwise(clamp(base - penalty + F.least(numbers * 0.15 + proper * 0.12, F.lit(0.6)), 0.1))


def info_density_v2(text: Column, s: Column) -> Column:
    """Content share, variety, pace and detail, each taking its part of what is left; repeated pairs take away."""
    # Words hold no spaces, so all are cleaned at once and cut again; the cut words are read as a lambda's variable.
    cleaned = F.lower(F.regexp_replace(F.array_join(words(text), " "), r"[^\p{L}0-9' ]", ""))
    names = F.regexp_count(text, F.lit(r"(?<!\S)\p{Lu}\p{Ll}{2,}"))
    detail = F.tanh((F.regexp_count(text, F.lit(r"\d+")) + names) / 6.0)

    def score(ws: Column) -> Column:
        n = F.size(ws)
        content = F.size(F.filter(ws, lambda w: F.length(w) > 3)) / F.greatest(n, F.lit(1))
        variety = F.size(F.array_distinct(ws)) / (n + 10.0)
        pace = info_proxy(F.when(s > 0, n / s).otherwise(0.0))
        pairs = F.zip_with(F.slice(ws, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        again = F.transform(F.array(pairs), lambda p: 1 - F.size(F.array_distinct(p)) / F.greatest(F.size(p), F.lit(1)))[0]
        whole = saturate([0.45 * content, 0.35 * variety, 0.35 * pace, 0.40 * detail]) - F.least(0.3 * F.when(n > 1, again).otherwise(0.0), F.lit(0.25))
        return F.when(n < 3, 0.1).otherwise(clamp(whole))

    return F.transform(F.array(F.split(cleaned, " ")), score)[0]


def aha_density(text: Column, s: Column) -> Column:
    causes = hits(F.lower(text), CAUSES)
    names = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), 0)))
    return (causes + names + F.regexp_count(text, F.lit(r"\b\d+\b"))) / F.greatest(s, F.lit(1.0))


def emotion(text: Column) -> Column:
    t = F.lower(text)
    return F.least(F.lit(1.0), (hits(t, STRONG_EMOTIONS) * 2 + hits(t, EMOTIONS)) / 5)


def question_or_list(text: Column) -> Column:
    t = F.trim(F.lower(text))
    asks = t.endswith("?").cast("int") * 0.5 + (F.regexp_count(t, F.lit(r"\?")) > 1).cast("int") * 0.1
    compares = t.rlike(r"\b(which|or|vs|versus|better|worse)\b.*\?").cast("int") * 0.15
    items = F.regexp_count(t, F.lit(r"\b(first|second|third|fourth|fifth|finally|number (one|two|three)|\d+[.)])"))
    return clamp(asks + compares + F.when(items.between(3, 7), 0.4).when(items > 0, 0.15).otherwise(0.0) - t.rlike(r"\b(like if|comment below|agree\?)").cast("int") * 0.2)


def loopability(text: Column) -> Column:
    """The first and last three words alike, short and quotable, ending curious."""
    ws = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}0-9']", ""))
    n = F.size(ws)
    same = (n >= 6) & (F.slice(ws, F.lit(1), F.lit(3)) == F.slice(ws, F.greatest(n - 2, F.lit(1)), F.lit(3)))
    curious = F.rtrim(text).rlike(r"(\?|\.\.\.|…)$")
    return clamp(F.coalesce(same, F.lit(False)).cast("int") * 0.4 + n.between(6, 14).cast("int") * 0.2 + curious.cast("int") * 0.3 + (n < 9).cast("int") * 0.1)


def insight(text: Column) -> tuple[Column, Column]:
    """Score from kinds of evidence, and the kinds found."""
    t = F.lower(text)
    found = {
        "contrast": t.rlike(r"\b(but|however|instead|actually|most people)\b"), "number": t.rlike(r"\d"), "comparison": t.rlike(r"\b(than|versus|vs)\b"),
        "causal": any_hit(t, CAUSES), "imperative": t.rlike(r"(^|[.!?]\s+)(try|stop|start|remember|never|always|focus|think)\b"),
    }
    parts = [F.when(c, INSIGHTS[k] * 0.5).otherwise(0.0) for k, c in found.items()]
    score = saturate(parts) - any_hit(t, UNSURE).cast("int") * 0.2 - (hits(t, FILLERS) >= 3).cast("int") * 0.4
    return clamp(score), F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))


def repetition_ratio(text: Column, chars: int = 200) -> Column:
    """Share of words that come again, in the text's opening."""
    ws = F.regexp_extract_all(F.lower(F.substring(text, 1, chars)), F.lit("[a-z']+"), 0)
    return F.when(F.size(ws) > 0, 1 - F.size(F.array_distinct(ws)) / F.size(ws)).otherwise(0.0)


def most_common(array: Column) -> Column:
    """How often the most frequent element of an array occurs."""
    state = F.aggregate(
        F.array_sort(array), F.expr("named_struct('w', '', 'n', 0, 'most', 0)"),
        lambda s, w: F.struct(w.alias("w"), F.when(s["w"] == w, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["most"], F.when(s["w"] == w, s["n"] + 1).otherwise(1)).alias("most")),
    )
    return state["most"]


def ad_likelihood(text: Column) -> Column:
    t = F.lower(text)
    rep = most_common(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z]{2,})\b"), 1))
    score = t.rlike(DOMAIN).cast("int") * 0.45 + t.rlike(SPELLED).cast("int") * 0.45 + any_hit(t, AD_PHRASES).cast("int") * 0.25
    score += (hits(t, AD_CALLS) >= 2).cast("int") * 0.15 + F.when(rep >= 3, 0.20).when(rep == 2, 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def ad_like_score(text: Column, sponsors=()) -> Column:
    t = F.trim(F.lower(text))
    brand = any_hit(t, sponsors) if sponsors else F.lit(False)
    return F.when(any_hit(t, LIKE_PHRASES), 0.8).when(brand, 0.7).when(t.rlike(PHONE) | t.rlike(LINK), 0.6).otherwise(0.0)


#: Target seconds and the share of the bell and of density, by platform.
PLATFORMS = {"tiktok": (22, 0.65), "instagram": (24, 0.65), "youtube": (28, 0.55), "linkedin": (30, 0.55)}


def platform_length(s: Column, density: Column, platform: str) -> Column:
    target, share = PLATFORMS.get(platform, (24, 0.6))
    width = F.greatest(F.lit(6.0), 12.0 - 4.0 * density)
    bell = F.greatest(F.lit(0.0), 1 - F.pow(F.abs(s - target) / width, 2))
    return clamp(share * bell + (1 - share) * density)


def finish_flags(text: Column) -> dict[str, Column]:
    t = F.rtrim(text)
    low = F.lower(t)
    return {
        "terminal": t.rlike("[.!?…]$"), "unfinished_tail": low.rlike(r"\b(and|but|so|because|or|the|a|to|of|with|that)$"),
        "cliffhanger": low.rlike(r"(\.\.\.|…|wait for it[.!]?|you won't believe[^.]*)$"), "continues": low.rlike(r"^(and|but|so|because|which)\b"),
    }


def finish_confidence(text: Column, next_word: Column, next_gap_ms: Column, next_mark_gap_ms: Column) -> Column:
    t, low = F.trim(text), F.lower(text)
    ends = t.rlike("[.!?]$")
    closers = ("and that's why", "so we", "that's why", "which is why", "this is why", "that's it", "that's right", "all set", "we're done")
    score = ends.cast("int") * 0.6 + (ends & F.coalesce(next_word.rlike(r"^\p{Lu}"), F.lit(False))).cast("int") * 0.2
    score += any_hit(low, closers).cast("int") * 0.4 + F.coalesce(next_gap_ms > 500, F.lit(False)).cast("int") * 0.2 + t.rlike("[,;:]$").cast("int") * 0.1
    near = F.when(next_mark_gap_ms.between(0, 1200), 0.10 * (1200 - next_mark_gap_ms) / 1200).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), score + F.coalesce(near, F.lit(0.0))))


def finish_threshold(genre: Column, conversational: Column, interview: Column) -> Column:
    t = 0.60 - (conversational > 0.7).cast("int") * 0.15 + genre.isin("educational", "technical").cast("int") * 0.10 - interview.cast("int") * 0.10
    return clamp(t, 0.30, 0.80)


def safety_penalty(text: Column, words_: tuple[str, ...], weight: float = 1.0) -> Column:
    return F.least(hits(F.lower(text), words_) * 0.1, F.lit(0.3)) * weight


def self_contained(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return (n_words(text) >= 8) & F.rtrim(text).rlike("[.!?]$") & ~low.rlike(r"^(and|but|so|because|which|that|it|he|she|they)\b")


def noun_burst(text: Column) -> Column:
    """Whether a sentence has two capitalised words or more that do not begin it."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    inner = lambda s: F.filter(F.split(s, r"\s+"), lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}\p{Ll}+"))
    return F.exists(sentences, lambda s: F.size(inner(s)) >= 2)


def cluster_cues(cues: DataFrame, families: list[tuple[str, str]]) -> DataFrame:
    """(cue, family): the first family whose pattern a cue matches, else 'general'."""
    family = reduce(lambda rest, p: F.when(F.lower("cue").rlike(p[1]), F.lit(p[0])).otherwise(rest), reversed(families), F.lit("general"))
    return cues.select("cue", family.alias("family"))


def hook_v5(text: Column, position: Column, families: list[tuple[str, str, float]], decay: float = 12.0, mu: float = 0.40, sigma: float = 0.18, a: float = 1.6) -> tuple[Column, Column]:
    """Raw and calibrated hook score: pattern families saturate; weaker without evidence and later in the episode."""
    t = F.lower(text)
    raw = saturate([F.when(t.rlike(p), w).otherwise(0.0) for _, p, w in families])
    evidence = t.rlike(r"\d|\b(because|proof|study|data|example)\b")
    raw = raw * F.when(evidence, 1.0).otherwise(0.80) * F.exp(-position / (decay * 4))
    raw = clamp(raw - t.rlike(r"^(hi|hello|welcome|thanks for|that's all)").cast("int") * 0.25)
    return raw, sigmoid(a * (raw - mu) / sigma)


def asr_quality(segments: DataFrame) -> DataFrame:
    """Mean word probability, else the recogniser's own confidence, else 0.5; and the share of sentences that end."""
    probs = F.filter(F.transform("words", lambda w: w["prob"].try_cast("double")), lambda p: p.isNotNull())
    mean = F.when(F.size(probs) > 0, F.aggregate(probs, F.lit(0.0), lambda s, p: s + p) / F.size(probs))
    sure = F.coalesce(mean, "confidence", F.lit(0.5))
    return segments.select("episode_id", "seg_idx", F.round(clamp(sure), 6).alias("asr_confidence"), F.rtrim("text").rlike("[.!?]$").alias("punctuated"))


def categories(docs: DataFrame, lexicon: DataFrame, key: str, top: int = 2) -> DataFrame:
    """(key, categories): the categories with most words in a text, two at most; 'general' where there is none."""
    ws = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']+"), 0))).alias("term"))
    counts = ws.join(lexicon.select("term", F.col("lexicon").alias("category")), "term").groupBy(key, "category").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "category"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]).alias("categories"))
    return docs.select(key).distinct().join(best, key, "left").withColumn("categories", F.coalesce("categories", F.array(F.lit("general"))))


def archetypes(docs: DataFrame, cues: list[tuple[str, str, float]], key: str, least: float = 35.0, second: float = 30.0, near: float = 10.0) -> DataFrame:
    """(key, archetype, score, other): weighted cues that no negation stands before; early ones count 1.25 times."""
    t = F.lower("text")
    by: dict[str, list[Column]] = {}
    for kind, cue, weight in cues:
        at = F.instr(t, cue)
        before = F.substring(t, F.greatest(at - 50, F.lit(1)), F.least(at - 1, F.lit(50)))
        fresh = (at > 0) & ~before.rlike(r"\b(not|never|no|isn't|wasn't|don't)\b[^.]*$")
        by.setdefault(kind, []).append(F.when(fresh, weight * F.when(at <= 60, 1.25).otherwise(1.0)).otherwise(0.0))
    scored = F.array(*(F.struct(F.round(reduce(lambda a, b: a + b, v), 6).alias("score"), F.lit(k).alias("kind")) for k, v in sorted(by.items())))
    rows = docs.select(key, F.sort_array(scored, asc=False).alias("s"))
    first, other = F.element_at("s", 1), F.get("s", F.lit(1))
    good = first["score"] >= least
    return rows.select(
        key, F.when(good, first["kind"]).otherwise("general").alias("archetype"), first["score"].alias("score"),
        F.when(good & (other["score"] >= second) & (first["score"] - other["score"] <= near), other["kind"]).alias("other"),
    )


def clean_title(title: Column) -> Column:
    """Stutters, leading fillers and spaces gone; first letters up."""
    t = F.regexp_replace(F.trim(title), r"(?i)\b(\w+)(\s+\1\b)+", "$1")
    t = F.regexp_replace(t, r"(?i)^(so|well|um|uh|okay|ok|like|and|but)[, ]+", "")
    return F.initcap(F.regexp_replace(F.trim(t), r"\s+", " "))


def arousal_blend(df: DataFrame, text_share: float = 0.6) -> DataFrame:
    """Text arousal mixed with the z score of the audio measure against its episode, through tanh."""
    by = Window.partitionBy("episode_id")
    z = (F.col("rms_var") - F.avg("rms_var").over(by)) / F.nullif(F.stddev_pop("rms_var").over(by), F.lit(0.0))
    audio = 0.5 + 0.5 * F.tanh(F.coalesce(z, F.lit(0.0)))
    return df.withColumn("arousal_mix", F.round(text_share * F.col("arousal") + (1 - text_share) * audio, 6))


def segment_features(segments: DataFrame, platform: str = "tiktok") -> DataFrame:
    """The wide table: the segment's keys and about 25 feature columns, doubles rounded to 6 places."""
    from cliploom.operators.evidence import payoff_v2

    text, s = F.col("text"), seconds()
    score, reasons = insight(text)
    segments = segments.withColumn("_paid", payoff_v2(text))
    density = info_density(text)
    doubles = {
        "hook_v4": hook_v4(text), "hook_proxy": hook_proxy(text), "arousal": arousal(text), "arousal_proxy": arousal_proxy(text), "payoff": F.col("_paid.score"),
        "info_density": density, "info_density_v2": info_density_v2(text, s), "aha_density": aha_density(text, s), "emotion": emotion(text),
        "q_list": question_or_list(text), "loopability": loopability(text), "insight": score, "repetition": repetition_ratio(text),
        "ad_likelihood": ad_likelihood(text), "ad_like": ad_like_score(text), "platform_length": platform_length(s, density, platform),
        "prerank": prerank_score(text, s), "seconds": s,
    }
    flags = {**finish_flags(text), "self_contained": self_contained(text), "noun_burst": noun_burst(text)}
    keys = [c for c in ("episode_id", "seg_idx", "clip_id", "start_ms", "end_ms") if c in segments.columns]
    return segments.select(
        *keys, "text", *(c.alias(n) for n, c in basics(text).items()), *(F.round(c, 6).alias(n) for n, c in doubles.items()),
        *(c.alias(n) for n, c in flags.items()), reasons.alias("insight_reasons"),
        F.col("_paid.label").alias("payoff_label"),
    )


LOG2 = math.log(2)
