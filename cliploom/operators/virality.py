"""Virality of clips: the core that selection ranks by, the full score, and the worth of an end.

Rows need start_ms and end_ms; feature columns that are missing or null count as 0, flags as false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators.features import clamp
from cliploom.operators.scores import feature

#: Weights of the features, of the same after rebalancing with and without a payoff, and of the core.
WEIGHTS = {"hook": 0.35, "arousal": 0.20, "payoff": 0.10, "info_density": 0.05, "question": 0.10}
REBALANCED = {"hook": 0.40, "arousal": 0.22, "payoff": 0.32, "info_density": 0.06}
PAYOFF_UNPAID = 0.20
CORE = {"hook": 0.26, "arousal": 0.20, "payoff": 0.17, "info_density": 0.11, "question": 0.09}
REASONS = r"\b(because|so that|which means|so you can|therefore|as a result|that's why)\b"


def flagged(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def optional(df: DataFrame, name: str) -> Column:
    return feature(name) if name in df.columns else F.lit(0.0)


def clip_seconds() -> Column:
    return F.greatest(F.lit(0.1), (F.col("end_ms") - F.col("start_ms")) / 1000)


def length_prior(s: Column) -> Column:
    """0 from 8 to 45 seconds; outside, -1/2 at the edge and towards -1 further away."""
    over = F.when(s < 8.0, 8.0 - s).when(s > 45.0, s - 45.0)
    return F.coalesce(-1.0 / (1.0 + F.exp(-over)), F.lit(0.0))


def shape(df: DataFrame) -> Column:
    """What length and end add: less for long clips without payoff, more for finished ones, much less for weak short ones."""
    s, finished = clip_seconds(), flagged(df, "finished")
    hook, payoff = optional(df, "hook"), optional(df, "payoff")
    unpaid = F.when((s >= 16.0) & (payoff < 0.30), 0.15 * (0.30 - payoff)).otherwise(0.0)
    end = F.when(finished & (s >= 20.0), 0.12).when(finished, 0.08).otherwise(0.0)
    short = F.when((s <= 10.0) & ((hook < 0.92) | (payoff < 0.60)), 0.50).otherwise(0.0)
    return end - unpaid - short


def listed(df: DataFrame, paid: float, loop: float) -> Column:
    """Lists count only where there is a payoff, loops only where the thought is finished."""
    lists = optional(df, "q_list") * F.when(flagged(df, "payoff_ok"), paid).otherwise(-0.01)
    return lists + F.when(flagged(df, "finished"), loop * optional(df, "loopability")).otherwise(0.0)


def core_virality(df: DataFrame) -> DataFrame:
    """`v_core`: without length prior and platform, for ranking; never below 0."""
    value = sum((w * optional(df, n) for n, w in CORE.items()), F.lit(0.0)) + listed(df, 0.04, 0.05) + shape(df)
    return df.withColumn("v_core", F.round(F.greatest(F.lit(0.0), value - optional(df, "penalty")), 6))


def virality_value(df: DataFrame, weights: dict[str, float], rebalanced: bool) -> Column:
    main = ("hook", "arousal", "payoff", "info_density")
    if rebalanced:
        pay = F.when(flagged(df, "payoff_ok"), REBALANCED["payoff"]).otherwise(PAYOFF_UNPAID)
        shares = {n: pay if n == "payoff" else F.lit(REBALANCED[n]) for n in main}
        whole = sum(shares.values(), F.lit(0.0))
        content = sum((shares[n] / whole * optional(df, n) for n in main), F.lit(0.0))
    else:
        whole = math.fsum(weights[n] for n in main)
        content = sum((weights[n] / whole * optional(df, n) for n in main), F.lit(0.0))
    value = content + weights["question"] * optional(df, "question") + listed(df, 0.03, 0.02) + shape(df) + 0.40 * length_prior(clip_seconds())
    return F.greatest(F.lit(0.0), value - optional(df, "penalty"))


def virality(df: DataFrame, weights: dict[str, float] = WEIGHTS, rebalanced: bool = False) -> DataFrame:
    """`virality`: content by weight (the first four summing to 1), shape, length prior and penalties; never below 0.

    rebalanced: fixed weights with less hook and more payoff, and less of the payoff's share where nothing is paid off.
    """
    return df.withColumn("virality", F.round(virality_value(df, weights, rebalanced), 6))


def end_utility(df: DataFrame, weights: dict[str, float] = WEIGHTS, rebalanced: bool = False) -> DataFrame:
    """`utility` of ending here: virality, the finish, a claim with its reason (`text`), less ads (`ad_flag`)."""
    finished, s = flagged(df, "finished"), clip_seconds()
    finish = F.when(finished, 0.4 + 0.15).when(s >= 18.0, 0.4 * 0.6 - 0.12).otherwise(0.4 * 0.6)
    reason = F.when(F.lower(F.coalesce("text", F.lit(""))).rlike(REASONS), 0.08).otherwise(0.0) if "text" in df.columns else F.lit(0.0)
    ad = F.when(flagged(df, "ad_flag"), 0.60).otherwise(0.0)
    return df.withColumn("utility", F.round(virality_value(df, weights, rebalanced) + finish + reason - ad, 6))


def finish_adjusted(value: Column, s: Column, finished: Column, sparse: bool = False) -> Column:
    """A candidate's worth with its finish: +0.15, or less for unfinished ones from 18 seconds on (half where marks are sparse)."""
    return value + F.when(finished, 0.15).when(s >= 18.0, -0.06 if sparse else -0.12).otherwise(0.0)


def confidence_band(score: Column) -> tuple[Column, Column]:
    """Points (45 at 0.1, 95 at 0.8, at most 100; 40 below) and the name of their band."""
    points = F.when(score < 0.1, 40).otherwise(F.least(F.floor(F.round((score - 0.1) / 0.7 * 50 + 45, 9)), F.lit(100))).cast("long")
    name = F.when(points >= 90, "Exceptional").when(points >= 80, "Premium").when(points >= 70, "Strong").when(points >= 60, "Good").otherwise("Fair")
    return points, name


def calibrate_v2(x: Column) -> Column:
    """Low scores a little lower, middle ones brighter, high ones below 0.95."""
    return F.when(x <= 0.35, x * 0.95).when(x <= 0.55, x * 1.12).when(x <= 0.75, x * 1.05).otherwise(F.least(F.lit(0.95), x * 0.98))


# --- length for a platform ---------------------------------------------------------------------------------------

#: The best, fitting and least spans of seconds, by platform.
LENGTH_SPANS = {
    "tiktok": ((15, 30), (5, 45), (3, 60)), "instagram": ((15, 30), (5, 45), (3, 60)), "instagram_reels": ((15, 30), (5, 45), (3, 60)),
    "youtube_shorts": ((20, 45), (5, 60), (3, 90)), "linkedin": ((30, 60), (10, 90), (5, 120)),
}
#: Centre, spread, cap and words a second of the bell.
BELL = {"mu": 22.0, "sigma": 7.0, "cap": 60.0, "wps": (2.8, 4.5)}
OUTRO = r"(?i)(thanks for watching|subscribe|follow|like and subscribe|link in bio|see you next time)"


def length_trapezoid(s: Column, platform: str) -> Column:
    """1 in the best span, down to 0.5 at the ends of the fitting one and 0.2 at those of the least, 0 outside."""
    best, fits, least = LENGTH_SPANS.get(platform, LENGTH_SPANS["tiktok"])
    inside = lambda span: (s >= span[0]) & (s <= span[1])
    near = F.when(s < best[0], 0.5 + 0.5 * (s - fits[0]) / (best[0] - fits[0])).otherwise(0.5 + 0.5 * (fits[1] - s) / (fits[1] - best[1]))
    far = F.when(s < fits[0], 0.2 + 0.3 * (s - least[0]) / (fits[0] - least[0])).otherwise(0.2 + 0.3 * (least[1] - s) / (least[1] - fits[1]))
    return F.when(inside(best), 1.0).when(inside(fits), near).when(inside(least), far).otherwise(0.0)


def clean_bound(s: Column, platform: str, kind: Column, sureness: Column) -> Column:
    """The trapezoid with 0.1 more at a sure end of a sentence or insight, 1 at most."""
    sure = kind.isin("sentence_end", "insight_marker") & (sureness > 0.8)
    return F.least(F.lit(1.0), length_trapezoid(s, platform) + F.when(sure, 0.1).otherwise(0.0))


def length_bell(s: Column, words_a_second: Column, loop: Column, kind: Column, sureness: Column, tail: Column, bell: dict = BELL) -> Column:
    """A bell around the best length, tighter and earlier for loops, mixed with pace, moved by the bound and the outro."""
    looped = F.coalesce(loop >= 0.60, F.lit(False))
    mu = F.when(looped, bell["mu"] - 2.0).otherwise(bell["mu"])
    sigma = F.when(looped, max(5.0, bell["sigma"] - 1.5)).otherwise(bell["sigma"])
    low, high = bell["wps"]
    mid = 0.5 * (low + high)
    base = F.exp(-0.5 * F.pow((s - mu) / sigma, 2)) * F.when(s >= bell["cap"] - 1.0, 0.85).otherwise(1.0)
    pace = F.when((words_a_second <= low) | (words_a_second >= high), 0.0).when(words_a_second < mid, (words_a_second - low) / (mid - low)).otherwise((high - words_a_second) / (high - mid))
    base = F.when(words_a_second > 0, 0.85 * base + 0.15 * pace).otherwise(base)
    bonus = F.when((kind == "sentence_end") & (sureness >= 0.90), 0.10).when(kind.isin("sentence_end", "insight_marker") & (sureness >= 0.75), 0.05).otherwise(0.0)
    base = F.when(bonus > 0, F.least(F.lit(1.0), base + bonus)).when(kind == "mid_word", base * 0.85).otherwise(base)
    outro = F.when(F.coalesce(tail, F.lit("")).rlike(OUTRO), 0.15).otherwise(0.0)
    return F.when((s <= 0) | (s > bell["cap"]), 0.0).otherwise(clamp(base - outro))


# --- niche and opening -------------------------------------------------------------------------------------------


def niche_penalty(text: Column, genre: Column) -> Column:
    """0.10 for words that point at what the clip does not hold; none in sports."""
    points = F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(like that|that's|this is)\b")
    return F.when(~F.coalesce(genre, F.lit("general")).isin("sports", "fantasy_sports") & points, 0.10).otherwise(0.0)


def clamped_hook(hook: Column, ad: Column, repetition: Column) -> Column:
    """The hook of an ad is 0.30 at most; an opening that repeats itself takes 30 % away."""
    held = F.when(ad >= 0.40, F.least(hook, F.lit(0.30))).otherwise(hook)
    return F.when(repetition >= 0.30, held * 0.70).otherwise(held)
