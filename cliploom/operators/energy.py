"""Arousal by genre and with sound, loops, speech rates, and verdicts on ads: columns of one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.features import LIKE_PHRASES, LINK, PHONE, clamp, hits, words
from cliploom.operators.quantiles import quantiles

#: Words (weight each, at most), and those of a genre.
INTENSITY = (
    (0.15, 0.4, ("insane", "shocking", "unbelievable", "mind-blowing", "incredible", "crazy", "wild", "epic", "amazing")),
    (0.08, 0.2, ("awesome", "great", "fantastic", "wonderful", "exciting", "thrilling", "intense", "powerful")),
    (0.03, 0.1, ("good", "nice", "cool", "interesting", "fun", "enjoyable")),
    (0.08, 0.2, ("now", "immediately", "urgent", "critical", "important", "must", "need", "quickly")),
)
BY_GENRE = {
    "fantasy_sports": (0.1, 0.2, ("fire", "draft", "start", "bench", "target", "sleeper", "bust", "league-winner")),
    "comedy": (0.12, 0.25, ("hilarious", "funny", "lol", "haha", "rofl", "joke", "punchline")),
    "true_crime": (0.1, 0.2, ("murder", "killer", "victim", "evidence", "mystery", "suspicious", "alibi")),
}
#: Share of sound in the mix, by genre; of text with measures of its own.
SOUND_SHARE = {"fantasy_sports": 0.6, "comedy": 0.8}
QUOTABLE = r"here's the thing|the truth is|what i learned|the key is|here's why|the secret|the trick"
PUNCHY = "insane|crazy|wild|epic|amazing"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_arousal(text: Column, genre: Column) -> Column:
    """Shouts by tiers, words in capitals, words by intensity, a genre's own words, questions and urgency; 0 to 1."""
    t = F.lower(whole(text))
    listed = lambda w, most, ps: F.least(hits(t, ps) * w, F.lit(most))
    shouts, asks = F.regexp_count(whole(text), F.lit("!")), F.regexp_count(whole(text), F.lit(r"\?"))
    caps = F.size(F.filter(words(whole(text)), lambda w: (F.length(w) >= 2) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    score = F.when(shouts >= 3, 0.4).when(shouts == 2, 0.25).when(shouts == 1, 0.15).otherwise(0.0) + F.least(caps * 0.12, F.lit(0.25))
    own = reduce(lambda rest, g: F.when(genre == g, listed(*BY_GENRE[g])).otherwise(rest), BY_GENRE, F.lit(0.0))
    return clamp(reduce(lambda a, b: a + b, (listed(*row) for row in INTENSITY), score) + own + F.least(asks * 0.05, F.lit(0.15)))


def sound_mix(text: Column, sound: Column, genre: Column) -> Column:
    """Arousal of sound and text: more sound in comedy, less in sports, 0.7 elsewhere."""
    share = reduce(lambda rest, g: F.when(genre == g, SOUND_SHARE[g]).otherwise(rest), SOUND_SHARE, F.lit(0.7))
    return share * sound + (1 - share) * text


def measured_mix(text: Column, loudness: Column, crossings: Column, pitch: Column) -> Column:
    """Half the text, the rest loudness (0.25), zero crossings (0.15) and the spread of pitch (0.10), each held to 0..1."""
    return clamp(0.5 * text + 0.25 * clamp(loudness) + 0.15 * clamp(crossings) + 0.10 * clamp(pitch))


def prosody_mix(df: DataFrame, text: str, loudness: str, pitch: str, by: str = "episode_id", text_share: float = 0.6) -> DataFrame:
    """`arousal_v2`: text and the squashed z scores of two measures against their episode. Null measures count as the mean.

    The episode's means are aggregated and joined, so an episode's rows are not gathered in one task.
    """
    stats = df.groupBy(by).agg(*(f(c).alias(f"_{n}_{c}") for c in (loudness, pitch) for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    stats = stats.withColumnRenamed(by, "_by")
    rows = df.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left")
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_mean_{c}")) / F.greatest(F.lit(1e-6), F.col(f"_std_{c}")), F.lit(0.0))
    sound = 0.5 * (0.5 * (F.tanh(0.75 * z(loudness)) + F.tanh(0.75 * z(pitch))) + 1.0)
    mixed = clamp(text_share * F.coalesce(F.col(text), F.lit(0.0)) + (1 - text_share) * sound)
    return rows.withColumn("arousal_v2", F.round(mixed, 6)).drop("_by", *(f"_{n}_{c}" for c in (loudness, pitch) for n in ("mean", "std")))


def loopability_v4(text: Column) -> Column:
    """The first and last three words alike, quotable, an open or curious end, short and punchy; 0 to 1."""
    t = F.lower(whole(text))
    ws = words(t)
    n = F.size(ws)
    same = (n >= 3) & (F.slice(ws, F.lit(1), F.lit(3)) == F.slice(ws, F.greatest(n - 2, F.lit(1)), F.lit(3)))
    trimmed = F.regexp_replace(t, r"^\s+|\s+$", "")
    curious = F.right(trimmed, F.lit(80)).rlike("but|however|what you don't|here's why|the catch") | trimmed.rlike(r"(\?|\.\.\.)\z")
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return clamp(one(same, 0.4) + one(t.rlike(QUOTABLE), 0.2) + one(t.rlike(r"(\?|\.\.\.|but)\z"), 0.15) + one(curious, 0.15) + one((n <= 8) & t.rlike(PUNCHY), 0.1))


def resolution_delta(payoff: Column, s: Column) -> Column:
    """Half the payoff of clips of 8 seconds or more that have one, 0.25 at most."""
    return F.when((payoff >= 0.25) & (s >= 8.0), F.least(F.lit(0.25), payoff * 0.5)).otherwise(0.0)


def rates_pass(s: Column, fillers: Column, ums: Column, silent_ms: Column, finished: Column, resolved: Column) -> Column:
    """Fillers, ums and silence a second within their limits; a quarter more for finished or resolved clips."""
    length = F.greatest(s, F.lit(0.001))
    more = F.when(finished | (resolved > 0.12), 1.25).otherwise(1.0)
    return (fillers / length <= 0.18 * more) & (ums / length <= 0.12 * more) & (silent_ms / (length * 1000.0) <= 0.18 * more)


def ad_verdict(text: Column, sponsors: tuple[str, ...] = ()) -> dict[str, Column]:
    """ad_penalty, is_advertisement, confidence and reasons: the first phrase and sponsor found, telephone numbers, links."""
    t = F.trim(F.lower(whole(text)))
    first = lambda names: F.coalesce(*(F.when(F.contains(t, F.lit(n)), F.lit(n)) for n in names)) if names else F.lit(None).cast("string")
    phrase, sponsor, phone, link = first(LIKE_PHRASES), first(sponsors), t.rlike(PHONE), t.rlike(LINK)
    grade = lambda a, b, c: F.when(phrase.isNotNull(), a).when(sponsor.isNotNull(), b).when(phone | link, c).otherwise(0.0)
    reasons = F.array_compact(F.array(
        F.concat(F.lit("ad_phrase: "), phrase), F.concat(F.lit("sponsor: "), sponsor), F.when(phone, F.lit("phone_number")), F.when(link, F.lit("url")),
    ))
    penalty = grade(0.8, 0.7, 0.6)
    return {"ad_penalty": penalty, "is_advertisement": penalty >= 0.3, "confidence": grade(0.9, 0.8, 0.7), "reasons": reasons}


def adaptive_floor(df: DataFrame, by: str, column: str = "final_score", key: str = "clip_id") -> DataFrame:
    """Rows that pass their group's `floor`: 0.04 below its base, which is 0.80 at most.

    The base is the 60 % quantile of the group or, where clips under 14 s and clips up to 28 s both occur, the greater of
    the 70 % quantile of the first and the 60 % quantile of the second. The highest tenth is left out of a quantile over more than
    ten. Quantiles are exact in groups of any size. No group is left empty, as its best row is never below the base, so
    the rule's second, lower floor is not needed. Null scores count as 0, ties go by `key`.
    """
    s = (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = df.withColumn("_v", F.coalesce(F.col(column).cast("double"), F.lit(0.0))).withColumn("_size", F.when(s < 14.0, 0).when(s <= 28.0, 1).otherwise(2))
    kinds = rows.groupBy(by).agg((F.count_if(F.col("_size") == 0) > 0).alias("_a"), (F.count_if(F.col("_size") == 1) > 0).alias("_b"))
    parts = rows.join(kinds, by).withColumn("_part", F.when(F.col("_a") & F.col("_b"), F.col("_size")).otherwise(3)).where("_part <> 2")
    part = Window.partitionBy(by, "_part")
    n, place = F.count("*").over(part), F.row_number().over(part.orderBy(F.desc("_v"), key))
    used = parts.withColumn("_n", n).withColumn("_place", place).where((F.col("_n") <= 10) | (F.col("_place") > F.floor(F.col("_n") * 0.1)))
    cuts = quantiles(used, [by, "_part"], "_v", (0.70, 0.60), ("_p70", "_p60"))
    best = F.max(F.when(F.col("_part") == 0, F.col("_p70")).otherwise(F.col("_p60")))
    floors = cuts.groupBy(by).agg(F.round(F.least(F.lit(0.80), best) - 0.04, 9).alias("floor"))
    return rows.join(floors, by).where(F.col("_v") >= F.col("floor")).drop("_v", "_size")
