"""Genre profiles: patterns of two more genres, paths by genre, adjustments and gates, all as columns of one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators.scores import feature, linear

#: Genre, feature, weight of a pattern, cap, patterns tried on the lower-case text. One comedy trigger has
#: a capital, so that it never matches; it stays as the rule has it.
PATTERNS = (
    ("fantasy_sports", "urgency_score", 0.2, 1.0, ("this week", "tonight", "tomorrow", "immediately", "now", "before", "deadline", "last chance")),
    ("fantasy_sports", "confidence_score", 0.25, 1.0, ("trust me", "i'm telling you", "mark my words", "guarantee", "100%", "definitely", "absolutely")),
    ("fantasy_sports", "viral_trigger_boost", 0.1, 0.3, (
        "sleeper (pick|candidate|alert)", "league winner", "waiver (wire|pickup|add)", r"must[\s-]?start", r"sit[\s/]start", "buy low", "sell high",
        "(dfs|draft) (play|pick)", "chalk play", "gpp (play|leverage)", "value play", "(trade|roster) advice",
    )),
    ("comedy", "timing_score", 0.3, 1.0, ("so.*then", "first.*then", "started.*ended", "thought.*turns out", "expected.*got")),
    ("comedy", "surprise_score", 0.25, 1.0, ("plot twist", "unexpected", "shocking", "out of nowhere", "didn't see that coming")),
    ("comedy", "viral_trigger_boost", 0.15, 0.4, ("I can't believe", "the (funniest|craziest|weirdest)", "you won't believe", "this actually happened", "caught (me|him|her) off guard")),
)

#: The paths of each genre, as shares of feature columns.
HOOK = {"hook": 0.50, "arousal": 0.20, "payoff": 0.15, "info_density": 0.10, "loopability": 0.05}
HOOK_GENERAL = {"hook": 0.45, "arousal": 0.25, "payoff": 0.15, "info_density": 0.10, "loopability": 0.05}
PAYOFF = {"payoff": 0.40, "info_density": 0.30, "emotion": 0.15, "hook": 0.10, "arousal": 0.05}
PATHS = {
    "general": {
        "hook": HOOK_GENERAL, "payoff": PAYOFF, "energy": {"arousal": 0.40, "emotion": 0.25, "hook": 0.20, "loopability": 0.10, "question": 0.05},
        "structured": {"question": 0.25, "info_density": 0.25, "payoff": 0.20, "hook": 0.20, "arousal": 0.10},
    },
    "true_crime": {
        "hook": HOOK, "payoff": PAYOFF, "mystery": {"hook": 0.40, "mystery_score": 0.30, "emotion": 0.20, "info_density": 0.10},
        "resolution": {"payoff": 0.40, "resolution_score": 0.30, "mystery_score": 0.20, "emotion": 0.10},
    },
    "business": {
        "hook": HOOK, "payoff": PAYOFF, "authority": {"payoff": 0.40, "authority_score": 0.30, "info_density": 0.20, "hook": 0.10},
        "specificity": {"info_density": 0.40, "specificity_score": 0.30, "payoff": 0.20, "hook": 0.10},
    },
    "educational": {
        "hook": HOOK, "payoff": PAYOFF, "curiosity": {"hook": 0.40, "curiosity_score": 0.30, "info_density": 0.20, "arousal": 0.10},
        "clarity": {"payoff": 0.40, "clarity_score": 0.30, "info_density": 0.20, "hook": 0.10},
    },
    "health_wellness": {
        "hook": HOOK, "payoff": PAYOFF, "credibility": {"payoff": 0.40, "credibility_score": 0.30, "info_density": 0.20, "hook": 0.10},
        "transformation": {"emotion": 0.40, "transformation_score": 0.30, "payoff": 0.20, "hook": 0.10},
    },
    "news_politics": {
        "hook": HOOK, "payoff": PAYOFF, "urgency": {"hook": 0.40, "urgency_score": 0.30, "arousal": 0.20, "info_density": 0.10},
        "controversy": {"arousal": 0.40, "controversy_score": 0.30, "hook": 0.20, "payoff": 0.10},
    },
    "fantasy_sports": {
        "hook": HOOK, "payoff": {"payoff": 0.45, "info_density": 0.25, "confidence_score": 0.15, "hook": 0.10, "arousal": 0.05},
        "actionable": {"payoff": 0.40, "info_density": 0.30, "confidence_score": 0.20, "urgency_score": 0.10},
        "hot_take": {"confidence_score": 0.25, "hook": 0.50, "viral_trigger_boost": 0.25},
    },
    "comedy": {
        "hook": HOOK_GENERAL, "payoff": PAYOFF, "setup_punchline": {"hook": 0.45, "payoff": 0.35, "timing_score": 0.20},
        "energy": {"arousal": 0.50, "emotion": 0.30, "surprise_score": 0.20},
    },
}
USED = tuple(sorted({n for paths in PATHS.values() for shares in paths.values() for n in shares} | {"insight"}))


def more_patterns(text: Column) -> dict[str, Column]:
    """Scores of fantasy sports and comedy, named <genre>_<feature>."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return {f"{g}_{n}": F.least(reduce(lambda a, b: a + b, (t.rlike(p).cast("int") for p in ps)) * w, F.lit(most)) for g, n, w, most, ps in PATTERNS}


def adjusted(df: DataFrame) -> DataFrame:
    """Features as the row's genre weighs them: sports lift payoff, weak hooks and detail, comedy lifts arousal and emotion."""
    sports, comedy = F.col("genre") == "fantasy_sports", F.col("genre") == "comedy"
    lifted = lambda genre, n, above, by: F.when(genre & (feature(n) > above), F.least(feature(n) * by, F.lit(1.0))).otherwise(feature(n))
    return df.withColumns({
        "payoff": lifted(sports, "payoff", 0.6, 1.2), "info_density": lifted(sports, "info_density", 0.4, 1.15),
        "hook": F.when(sports & (feature("hook") < 0.3), feature("hook") * 1.3).otherwise(feature("hook")),
        "arousal": lifted(comedy, "arousal", 0.5, 1.25), "emotion": lifted(comedy, "emotion", 0.3, 1.2),
    })


def gate(genre: Column) -> Column:
    """The factor that a genre's quality rule puts on a row: 1 where it holds, less where it does not."""
    shown = (feature("payoff") >= 0.3) | (feature("insight") >= 0.7) | (feature("question") >= 0.5)
    low = lambda a, x, b, y: (feature(a) < x) & (feature(b) < y)
    return (
        F.when(genre == "true_crime", F.when(low("mystery_score", 0.2, "resolution_score", 0.2), 0.80).otherwise(1.0))
        .when(genre == "business", F.when(shown, 1.0).otherwise(0.80))
        .when(genre == "fantasy_sports", F.when(shown, 1.0).otherwise(0.85))
        .when(genre == "health_wellness", F.when(low("payoff", 0.3, "credibility_score", 0.2), 0.80).otherwise(1.0))
        .when(genre == "news_politics", F.when(low("hook", 0.4, "urgency_score", 0.2), 0.75).otherwise(1.0))
        .otherwise(F.when(shown, 1.0).when(feature("hook") >= 0.4, 0.95).otherwise(0.85))
    )


def genre_verdict(df: DataFrame) -> DataFrame:
    """Rows (with a `genre`) with their genre's best path, its score, the gate's factor and the gated score.

    Feature columns that are missing count as 0; unknown and null genres are general. The first of equal paths wins, in the
    order of their names. Every path is a sum over the row, so nothing is joined or shuffled.
    """
    missing = {n: F.lit(0.0) for n in USED if n not in df.columns}
    known = F.when(F.col("genre").isin(*PATHS), F.col("genre")).otherwise("general")
    rows = adjusted(df.withColumns(missing).withColumn("genre", known))
    best = lambda paths: F.array_min(F.array(*(F.struct((-F.round(linear(s), 6)).alias("m"), F.lit(n).alias("n")) for n, s in paths.items())))
    choice = reduce(lambda rest, g: F.when(F.col("genre") == g, best(PATHS[g])).otherwise(rest), (g for g in PATHS if g != "general"), best(PATHS["general"]))
    rows = rows.withColumn("_best", choice).withColumn("gate", gate(F.col("genre")))
    out = rows.withColumn("path", F.col("_best.n")).withColumn("path_score", -F.col("_best.m")).withColumn("genre_score", F.round(-F.col("_best.m") * F.col("gate"), 6))
    return out.drop("_best", *missing)
