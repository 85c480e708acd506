"""Scores that combine feature columns: paths, bonuses, caps, calibrations, platforms and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.features import clamp
from cliploom.operators.phrases import few, substring_hits

#: The four general paths, as shares of feature columns.
PATHS = {
    "hook": {"hook": 0.42, "arousal": 0.15, "payoff": 0.10, "info_density": 0.12, "platform_length": 0.18, "loopability": 0.03, "insight": 0.02, "q_list": 0.02},
    "payoff": {"payoff": 0.30, "info_density": 0.25, "emotion": 0.15, "hook": 0.10, "platform_length": 0.10, "arousal": 0.05, "insight": 0.05},
    "energy": {"arousal": 0.30, "emotion": 0.20, "hook": 0.20, "loopability": 0.10, "platform_length": 0.10, "question": 0.05, "insight": 0.05},
    "structured": {"question": 0.25, "info_density": 0.25, "payoff": 0.20, "hook": 0.20, "platform_length": 0.10},
}


def weights_normalised(weights: DataFrame) -> DataFrame:
    """Weights (name, weight) that sum to 1; all 0 stay as they are. A handful of rows, summed in one task."""
    total = weights.agg(F.sum("weight").alias("total"))
    return weights.crossJoin(F.broadcast(total)).select("name", F.when(F.col("total") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("total")).alias("weight"))


def preset_weights(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Base weights with a platform's and a tone's deltas added, none below 0, summing to 1 again."""
    both = reduce(DataFrame.unionByName, deltas, base)
    return weights_normalised(both.groupBy("name").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("weight")))


def feature(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def linear(shares: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (feature(n) * w for n, w in shares.items()))


def path_scores(df: DataFrame, paths=PATHS) -> DataFrame:
    """path_<name> columns, the best one's value and the first that has it."""
    rows = df.withColumns({f"path_{n}": F.round(linear(shares), 6) for n, shares in paths.items()})
    names = [f"path_{n}" for n in paths]
    best = F.greatest(*names)
    winner = F.coalesce(*(F.when(F.col(n) == best, F.lit(n[5:])) for n in names))
    return rows.withColumn("base_score", best).withColumn("winning_path", winner)


def synergy_step(hook: Column, arousal: Column, payoff: Column) -> Column:
    return F.when((hook >= 0.6) & (arousal >= 0.5) & (payoff >= 0.4), 0.12).when((hook >= 0.4) & ((arousal >= 0.4) | (payoff >= 0.3)), 0.06).otherwise(0.0)


def synergy_unified() -> Column:
    """-0.10 to 0.15: hook, payoff and arousal together; bait (high hook or arousal without payoff) takes away."""
    core = (feature("hook") + feature("payoff") + feature("arousal")) / 3
    structure = (feature("info_density") + feature("q_list") + feature("loopability")) / 3
    bait = ((feature("hook") > 0.8) & ((feature("payoff") < 0.3) | (feature("info_density") < 0.3))).cast("int") * 0.08
    loud = ((feature("arousal") > 0.8) & (feature("payoff") < 0.3)).cast("int") * 0.05
    return clamp(0.10 * core + 0.05 * structure - bait - loud, -0.10, 0.15)


def score_v4(df: DataFrame, trend_weight: float = 0.10) -> DataFrame:
    """final_score and score_100: the best path, less the ad penalty, plus synergy (the triad capped at 1.25 times its
    best part) and bonuses for insight, questions, length fit and trend."""
    rows = path_scores(df)
    hook, aro, pay = feature("hook"), feature("arousal"), feature("payoff")
    triad = hook + aro + pay
    lift = F.least(triad + synergy_step(hook, aro, pay), 1.25 * F.greatest(hook, aro, pay)) - triad
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    bonus = when(feature("insight") >= 0.7, 0.15) + when(feature("question") >= 0.6, 0.10) + when(feature("platform_length") >= 0.8, 0.05)
    bonus += F.least(F.lit(0.10), trend_weight * feature("trend")) if "trend" in df.columns else F.lit(0.0)
    ad = feature("ad_penalty") if "ad_penalty" in df.columns else F.lit(0.0)
    total = F.col("base_score") - F.greatest(ad, F.lit(0.0)) + lift + bonus + when(feature("platform_length") >= 0.90, 0.02)
    final = F.round(clamp(total), 6)
    return rows.withColumn("final_score", final).withColumn("score_100", F.floor(F.col("final_score") * 100 + 1e-9).cast("long"))


def genre_score(df: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, genre, path, score, first): scores by a table (genre, path, feature, weight), joined on genre."""
    names = [r.feature for r in weights.select("feature").distinct().collect()]
    long = df.select(key, "genre", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(feature(n) for n in names)))).alias("feature", "x"))
    scored = long.join(weights, ["genre", "feature"]).groupBy(key, "genre", "path").agg(F.round(F.sum(F.col("x") * F.col("weight")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "path"))
    return scored.withColumn("first", rank == 1)


def detect_genre(docs: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, genre, hits, confidence): a word counts 1 and a phrase 2; the best from 2 on, else 'general'.

    confidence = (best - second) / best. Words are matched by a join, phrases in the text itself (by automata once they are
    more than a few).
    """
    several = lexicon.where(F.contains("term", F.lit(" "))).select("lexicon", "term")
    phrases = few(several)
    lower = F.lower("text")
    found = [F.when(F.contains(lower, F.lit(r.term)), F.struct(F.lit(r.lexicon).alias("genre"), F.lit(2).cast("long").alias("n"))) for r in phrases or ()]
    ws = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[\p{L}']+"), 0))).alias("term"))
    single = ws.join(lexicon.select("term", F.col("lexicon").alias("genre")), "term").select(key, "genre", F.lit(1).cast("long").alias("n"))
    if found:
        single = single.union(docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.genre", "x.n"))
    if phrases is None:
        single = single.union(substring_hits(docs, several, key).select(key, F.col("lexicon").alias("genre"), F.lit(2).cast("long").alias("n")))
    totals = single.groupBy(key, "genre").agg(F.sum("n").alias("n"))
    ranked = totals.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "genre"))), 1, 2).alias("top"))
    best, second = -F.col("top")[0]["m"], -F.coalesce(F.get("top", F.lit(1))["m"], F.lit(0))
    rows = docs.select(key).join(ranked, key, "left")
    good = F.coalesce(best >= 2, F.lit(False))
    return rows.select(
        key, F.when(good, F.col("top")[0]["genre"]).otherwise("general").alias("genre"), F.when(good, best).otherwise(0).cast("long").alias("hits"),
        F.when(good, F.round((best - second) / best, 6)).otherwise(0.0).alias("confidence"),
    )


def blend_weights(confidences: DataFrame, weights: DataFrame, key: str, least: float = 0.20) -> DataFrame:
    """(key, name, weight): weights of the two surest genres (from `least` on) mixed by confidence, summing to 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "genre"))
    top = confidences.where(F.col("confidence") >= least).withColumn("rank", rank).where("rank <= 2")
    top = top.withColumn("share", F.col("confidence") / F.sum("confidence").over(Window.partitionBy(key)))
    mixed = top.join(weights, "genre").groupBy(key, "name").agg(F.sum(F.col("share") * F.col("weight")).alias("w"))
    return mixed.select(key, "name", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(key)), 6).alias("weight"))


def whiten(df: DataFrame, columns: list[str]) -> DataFrame:
    """Path columns less their mean, by their L2 norm, around 0.5."""
    values = [clamp(feature(c)) for c in columns]
    mean = reduce(lambda a, b: a + b, values) / len(columns)
    norm = F.sqrt(reduce(lambda a, b: a + b, (F.pow(v - mean, 2) for v in values)))
    scale = F.when(norm == 0, 1.0).otherwise(norm)
    return df.withColumns({f"white_{c}": F.round(clamp((v - mean) / scale * 0.5 + 0.5), 6) for c, v in zip(columns, values)})


def calibrate_piecewise(x: Column) -> Column:
    return F.when(x < 0.2, x * 0.8).when(x < 0.5, 0.16 + (x - 0.2) * 0.9).when(x < 0.8, 0.43 + (x - 0.5) * 0.8).otherwise(0.67 + (x - 0.8) * 0.6)


def grade(score_100: Column) -> Column:
    return F.when(score_100 >= 90, "A+").when(score_100 >= 80, "A").when(score_100 >= 70, "B").when(score_100 >= 60, "C").when(score_100 >= 50, "D").otherwise("F")


def ui_band(x: Column) -> Column:
    """45 to 100."""
    return F.round(45 + 55 * clamp(x)).cast("long")


QUESTION = r"^(what|why|how|when|where|who|whom|whose|which|do|does|did|can|could|should|would|is|are|was|were|will|won't|isn't|aren't|didn't)\b"


def asks(text: Column) -> Column:
    t = F.trim(F.lower(text))
    return t.endswith("?") | t.rlike(QUESTION)


def anti_bait_cap(df: DataFrame) -> DataFrame:
    """Caps after all bonuses: short questions and ads without payoff 0.55, long hooks without payoff 0.72; a little
    more for payoff, 0.98 at most, two places; with the caps that were applied."""
    hook, pay, n, ad = feature("hook"), feature("payoff"), F.col("n_words"), feature("ad_penalty") if "ad_penalty" in df.columns else F.lit(0.0)
    q, micro = asks(F.col("text")), n < 12
    caps = {
        "anti_bait_micro": (micro & (pay < 0.20) & (q | (ad >= 0.3)), 0.55), "no_payoff_ceiling": ((n >= 18) & (hook >= 0.90) & (pay < 0.12), 0.72),
        "question_cap": (q & micro & (pay < 0.20), 0.55),
    }
    capped = F.least(F.col("final_score"), *(F.when(c, v).otherwise(1.0) for c, v in caps.values()))
    lifted = F.bround(F.least(capped + F.when(pay >= 0.30, 0.02).otherwise(0.0), F.lit(0.98)), 2)
    applied = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, (c, _) in caps.items())))
    return df.withColumn("caps_applied", applied).withColumn("final_score", lifted)


#: Half-open bands of seconds and the platforms they suit, best first.
PLATFORM_BANDS = ((0, 15, ("tiktok", "instagram", "youtube")), (15, 30, ("instagram", "tiktok", "youtube")), (30, 60, ("youtube", "instagram", "tiktok")), (60, 90, ("youtube", "linkedin")), (90, 10**9, ("youtube",)))


def recommend_platforms(clips: DataFrame) -> DataFrame:
    """(clip_id, platform, rank): platforms of the clip's length band, moved up by payoff and down by its place."""
    s = (F.col("end_ms") - F.col("start_ms")) / 1000
    lists = reduce(lambda rest, b: F.when((s >= b[0]) & (s < b[1]), F.array(*map(F.lit, b[2]))).otherwise(rest), reversed(PLATFORM_BANDS), F.array(F.lit("youtube")))
    rows = clips.select("clip_id", F.posexplode(lists).alias("at", "platform"), feature("payoff_score").alias("payoff") if "payoff_score" in clips.columns else F.lit(0.0).alias("payoff"))
    fit = 1.0 - 0.2 * F.col("at") + F.when((F.col("platform") == "linkedin") & (F.col("payoff") >= 0.5), 0.15).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("fit"), "platform"))
    return rows.withColumn("fit", F.round(fit, 6)).select("clip_id", "platform", "fit", rank.cast("long").alias("rank"))


def trend_score(hits: DataFrame, docs: DataFrame, key: str, as_of: Column, half_life_days: float = 7.0) -> DataFrame:
    """(key, trend): 0.4 of the global and 0.6 of the best category's decayed hits, each 1 at most.

    hits: (key, category, term, weight, decay_start); `as_of` is a parameter so that results repeat.
    """
    days = F.greatest(F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp("decay_start")) / 86_400, F.lit(0.0)), F.lit(0.0))
    decayed = F.col("weight") * F.exp(-F.log(F.lit(2.0)) * days / half_life_days)
    by = hits.groupBy(key, "category").agg(F.least(F.sum(decayed), F.lit(1.0)).alias("s"))
    whole = by.groupBy(key).agg(F.max(F.when(F.col("category") == "global", F.col("s"))).alias("g"), F.max(F.when(F.col("category") != "global", F.col("s"))).alias("c"))
    rows = docs.select(key).join(whole, key, "left")
    return rows.select(key, F.round(F.least(F.lit(1.0), 0.4 * F.coalesce("g", F.lit(0.0)) + 0.6 * F.coalesce("c", F.lit(0.0))), 6).alias("trend"))


def what_if(df: DataFrame, weight_sets: DataFrame, key: str) -> DataFrame:
    """(set_id, key, score): the rows scored under several weight sets (set_id, feature, weight); one join on feature."""
    names = [r.feature for r in weight_sets.select("feature").distinct().collect()]
    long = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(feature(n) for n in names)))).alias("feature", "x"))
    return long.join(weight_sets, "feature").groupBy("set_id", key).agg(F.round(F.sum(F.col("x") * F.col("weight")), 6).alias("score"))


def explain(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Rows with the strong features named, best first, and a map of all."""
    parts = F.sort_array(F.array(*(F.struct((-feature(c)).alias("m"), F.lit(c).alias("n")) for c in columns)))
    strong = F.transform(F.filter(parts, lambda x: -x["m"] >= least), lambda x: x["n"])
    return df.withColumn("strengths", F.array_join(strong, ", ")).withColumn("breakdown", F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(feature(c) for c in columns))))


def viability(df: DataFrame) -> DataFrame:
    """Rows with the first reason against them, or null."""
    reason = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(feature("ad_likelihood") >= 0.60, "ad")
        .when(~F.col("finished") | (feature("coverage") < 0.66), "unfinished").when(feature("safety") >= 0.3, "safety")
    )
    return df.withColumn("gate_reason", reason)
