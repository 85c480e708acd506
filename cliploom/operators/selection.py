"""Ranking, top-k, diversity and greedy de-duplication of clips and titles.

Greedy rules share patterns.greedy_keep: one ordered fold for each episode, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.features import any_hit, arousal_proxy, duration_fit, hook_proxy, info_proxy, n_words, prerank_score, PRERANK_ADS
from cliploom.operators.large import LARGE_GROUP, Alike, AnyOf, Near, Overlap, Shared, Touch
from cliploom.operators.patterns import greedy_keep, jaccard, ordered_fold
from cliploom.operators.vectors import distinct_vectors, dot, first_kept, similar_pairs
from cliploom.operators.written import written


def rank_by(by: str | list[str], *order) -> Column:
    keys = [by] if isinstance(by, str) else by
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


# --- ranking -----------------------------------------------------------------------------------------------------


def prerank(segments: DataFrame, by: str = "episode_id", key: str = "seg_idx", least: int = 30, share: float = 0.6, explore: float = 0.15) -> DataFrame:
    """Segments without ads kept by the cheap score: max(least, share n) of them, and the densest of the rest."""
    s = (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = segments.where(~any_hit(F.lower("text"), PRERANK_ADS))
    rows = rows.withColumn("prerank", F.round(prerank_score(F.col("text"), s), 6)).withColumn("info", F.round(info_proxy(F.when(s > 0, n_words(F.col("text")) / s)), 6))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(by))).withColumn("place", rank_by(by, F.desc("prerank"), key))
    k = F.greatest(F.lit(least), F.ceil(F.col("n") * share - 1e-9))
    rows = rows.withColumn("top", F.col("place") <= k)
    rest = rank_by([by, "top"], F.desc("info"), key)
    more = F.greatest(F.lit(1), F.floor(explore * k + 1e-9))
    rows = rows.withColumn("rest_place", rest).withColumn("why", F.when(F.col("top"), "top").when(F.col("rest_place") <= more, "explore"))
    return rows.where("why is not null").drop("n", "top", "rest_place")


def safety_keep(segments: DataFrame) -> DataFrame:
    """Segments that any of four rules calls an obvious find."""
    text, s = F.col("text"), (F.col("end_ms") - F.col("start_ms")) / 1000
    info = info_proxy(F.when(s > 0, n_words(text) / s))
    asks = text.contains("?")
    rule = ((hook_proxy(text) >= 0.8) & (arousal_proxy(text) >= 0.6)) | (asks & text.rlike("[0-9]") & (info >= 0.6)) | ((duration_fit(s) >= 0.9) & (info >= 0.7))
    return segments.where(rule | (asks & (F.instr(text, "?") - 1 < F.length(text) * 0.3)))


def stratified(df: DataFrame, n: int, by: str = "episode_id", key: str = "clip_id", score: str = "final_score") -> DataFrame:
    """Two of each time third and of each length class, then the best others, up to `n`; ties by sha1 of the key."""
    tie = F.sha1(F.col(key).cast("string"))
    whole = Window.partitionBy(by)
    span = F.greatest(F.max("end_ms").over(whole) - F.min("start_ms").over(whole), F.lit(1))
    third = F.least(F.floor((F.col("start_ms") - F.min("start_ms").over(whole)) * 3 / span), F.lit(2))
    ms = F.col("end_ms") - F.col("start_ms")
    rows = df.withColumn("_third", third).withColumn("_class", F.when(ms < 15_000, 0).when(ms < 30_000, 1).otherwise(2)).withColumn("_tie", tie)
    a, b = rank_by([by, "_third"], F.desc(score), "_tie"), rank_by([by, "_class"], F.desc(score), "_tie")
    rows = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_first", F.when(F.least("_a", "_b") <= 2, 0).otherwise(1))
    rows = rows.withColumn("place", rank_by(by, "_first", F.desc(score), "_tie")).where(F.col("place") <= n)
    return rows.drop("_third", "_class", "_tie", "_a", "_b", "_first")


def first_words(text: Column, n: int = 10) -> Column:
    return F.slice(F.split(F.lower(F.trim(text)), r"\s+"), 1, n)


def select_moments(clips: DataFrame, n: int = 5, gap_ms: int = 45_000, overlap: int = 5, ms=(12_000, 30_000)) -> DataFrame:
    """The best clips of 12 to 30 seconds whose starts are 45 seconds apart and whose openings differ."""
    rows = clips.where((F.col("end_ms") - F.col("start_ms")).between(*ms)).withColumn("opening", first_words(F.col("text")))
    rule = AnyOf((Near(("start_ms",), gap_ms - 1), Shared("opening", overlap)))
    fields = ["clip_id", "start_ms", "end_ms", "final_score", "opening"]
    return greedy_keep(rows, "episode_id", [-F.col("final_score"), F.col("clip_id")], fields, rule, limit=n).drop("opening")


def rank_clips(clips: DataFrame, seeds_first: bool = True) -> DataFrame:
    order = ([F.desc("is_seed")] if seeds_first and "is_seed" in clips.columns else []) + [F.desc("final_score"), F.col("start_ms"), F.col("clip_id")]
    return clips.withColumn("place", rank_by("episode_id", *order).cast("long"))


def mmr(items: DataFrame, k: int, share: float = 0.7, by: str = "episode_id", key: str = "clip_id", score: str = "final_score", text: str = "text") -> DataFrame:
    """(by, key, pick): k times the item with the most of share * score - (1 - share) * similarity to those picked
    (word-set Jaccard); ties by key. A fold of k rounds over each group's array."""
    row = F.struct(F.col(key).alias("id"), F.col(score).alias("s"), F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+")).alias("ws"))
    arrays = items.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("all"))

    def pick(done: Column, _: Column) -> Column:
        open_ = F.filter("all", lambda x: ~F.exists(done, lambda d: d["id"] == x["id"]))
        near = lambda x: F.aggregate(done, F.lit(0.0), lambda m, d: F.greatest(m, jaccard(d["ws"], x["ws"])))
        scored = F.transform(open_, lambda x: F.struct((-F.round(share * x["s"] - (1 - share) * near(x), 9)).alias("v"), x["id"].alias("id"), x["ws"].alias("ws")))
        best = F.array_min(F.transform(scored, lambda x: F.struct(x["v"].alias("v"), x["id"].alias("id"), x["ws"].alias("ws"))))
        return F.when(F.size(open_) > 0, F.concat(done, F.array(F.struct(best["id"].alias("id"), best["ws"].alias("ws"))))).otherwise(done)

    empty = F.transform(F.filter("all", lambda x: F.lit(False)), lambda x: F.struct(x["id"].alias("id"), x["ws"].alias("ws")))
    rows = arrays.select(by, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, pick)).alias("at", "x"))
    return rows.select(by, F.col("x.id").alias(key), (F.col("at") + 1).cast("long").alias("pick"))


def duration_mix(clips: DataFrame, n: int = 10) -> DataFrame:
    """The best clip of each of four length classes first, then the others by score."""
    ms = F.col("end_ms") - F.col("start_ms")
    rows = clips.withColumn("_class", F.when(ms < 15_000, 0).when(ms < 30_000, 1).when(ms < 45_000, 2).otherwise(3))
    rows = rows.withColumn("_rest", (rank_by(["episode_id", "_class"], F.desc("final_score"), "clip_id") > 1).cast("int"))
    return rows.withColumn("place", rank_by("episode_id", "_rest", F.desc("final_score"), "clip_id").cast("long")).where(F.col("place") <= n).drop("_class", "_rest")


def diversity_swap(chosen: DataFrame, reserve: DataFrame, near_ms: int = 1_000, slack: float = 0.03) -> DataFrame:
    """Where half of an episode's clips are within a second of the middle length, the worst of these gives way to the
    best reserve clip of another length that is not worse by more than `slack`."""
    ms = F.col("end_ms") - F.col("start_ms")
    mid = chosen.groupBy("episode_id").agg(F.percentile(ms, 0.5).alias("mid"))
    rows = chosen.join(mid, "episode_id").withColumn("_near", F.abs(ms - F.col("mid")) <= near_ms)
    uniform = rows.groupBy("episode_id", "mid").agg((F.count_if("_near") * 2 >= F.count("*")).alias("uniform"))
    worst = rows.where("_near").groupBy("episode_id").agg(F.min_by(F.struct("clip_id", "final_score"), F.struct("final_score", "clip_id")).alias("w"))
    outside = reserve.join(uniform.where("uniform"), "episode_id").where(F.abs(ms - F.col("mid")) > near_ms)
    outside = outside.join(chosen.select("clip_id"), "clip_id", "left_anti")
    best = outside.withColumn("_r", rank_by("episode_id", F.desc("final_score"), "clip_id")).where("_r = 1").join(worst, "episode_id")
    best = best.where(F.col("final_score") >= F.col("w.final_score") - slack)
    gone = best.select(F.col("w.clip_id").alias("clip_id"))
    return chosen.join(gone, "clip_id", "left_anti").select(chosen.columns).unionByName(best.select(chosen.columns))


def replace_weakest(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """One clip for each episode of `best` in place of the weakest chosen one."""
    weak = chosen.withColumn("_r", rank_by("episode_id", "final_score", F.desc("clip_id"))).where("_r = 1").select("episode_id", "clip_id")
    gone = weak.join(best.select("episode_id"), "episode_id", "left_semi").select("clip_id")
    return chosen.join(gone, "clip_id", "left_anti").select(chosen.columns).unionByName(best.select(chosen.columns))


def length_mix(chosen: DataFrame, pool: DataFrame, least_ms: int = 30_000, share: float = 0.8) -> DataFrame:
    """An episode without a long clip gets the best long one of the pool that has 80 % of its best score."""
    ms = F.col("end_ms") - F.col("start_ms")
    state = chosen.groupBy("episode_id").agg(F.max("final_score").alias("top"), F.bool_or(ms >= least_ms).alias("has"))
    long_ = pool.where(ms >= least_ms).join(state.where("not has"), "episode_id").where(F.col("final_score") >= share * F.col("top"))
    best = long_.withColumn("_r", rank_by("episode_id", F.desc("final_score"), "clip_id")).where("_r = 1")
    return replace_weakest(chosen, best)


def finished_backstop(chosen: DataFrame, pool: DataFrame, slack: float = 0.05) -> DataFrame:
    """An episode without a finished clip gets the best finished one that is within `slack` of its weakest."""
    state = chosen.groupBy("episode_id").agg(F.min("final_score").alias("low"), F.bool_or("finished").alias("has"))
    good = pool.where("finished").join(state.where("not has"), "episode_id").where(F.col("final_score") >= F.col("low") - slack)
    best = good.withColumn("_r", rank_by("episode_id", F.desc("final_score"), "clip_id")).where("_r = 1")
    return replace_weakest(chosen, best)


#: Fixed values of the payoff rescue.
BUMP_HIGH, BUMP_LOW, MARGIN, SURE, INSIGHT, HARD = 0.05, 0.03, 0.02, 0.6, 0.7, 0.08


def payoff_rescue(clips: DataFrame, by: str = "episode_id") -> DataFrame:
    """(by, clip_id, calibrated, rescued): clips with payoff or insight raised by 3 or 5 %, not past the clip before
    them less a margin, and by 0.08 at most. A fold, as each bound is the raised value before."""
    sure = (F.col("payoff_label").isNotNull() | (F.coalesce("insight_score", F.lit(0.0)) >= INSIGHT)) & (F.coalesce("insight_conf", F.lit(0.0)) >= SURE)
    bump = F.when(F.greatest(F.coalesce("payoff_score", F.lit(0.0)), F.coalesce("insight_score", F.lit(0.0))) >= 0.35, BUMP_HIGH).otherwise(BUMP_LOW)
    rows = clips.withColumn("bump", F.when(F.coalesce(sure, F.lit(False)), bump).otherwise(0.0))
    kind = "array<struct<clip_id: string, calibrated: double, rescued: double>>"

    def step(done: Column, x: Column) -> Column:
        proposed = x["calibrated"] * (1 + x["bump"])
        upper = F.when(F.size(done) > 0, F.greatest(F.get(done, F.size(done) - 1)["rescued"] - MARGIN, x["calibrated"])).otherwise(proposed)
        value = F.when(x["bump"] > 0, F.least(proposed, upper, x["calibrated"] + HARD)).otherwise(x["calibrated"])
        return F.concat(done, F.array(F.struct(x["clip_id"].alias("clip_id"), x["calibrated"].alias("calibrated"), value.alias("rescued"))))

    folded = ordered_fold(rows, by, [-F.col("calibrated"), F.col("clip_id")], ["clip_id", "calibrated", "bump"], f"cast(array() as {kind})", step, "done")
    return folded.select(by, F.explode("done").alias("x")).select(by, "x.clip_id", "x.calibrated", F.round("x.rescued", 6).alias("rescued"))


def soft_floor(kept: DataFrame, reserve: DataFrame, n: int) -> DataFrame:
    """Episodes with fewer than `n` clips are filled up from the reserve by score."""
    more = reserve.join(kept.select("clip_id"), "clip_id", "left_anti").select(kept.columns)
    rows = kept.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    place = rank_by("episode_id", "_late", F.desc("final_score"), "clip_id")
    return rows.withColumn("_place", place).where((F.col("_late") == 0) | (F.col("_place") <= n)).drop("_late", "_place")


def final_order(clips: DataFrame) -> DataFrame:
    columns = [F.desc(c) for c in ("finished", "coverage", "novelty") if c in clips.columns]
    fit = F.abs(F.col("end_ms") - F.col("start_ms") - 18_000)
    return clips.withColumn("place", rank_by("episode_id", *columns, fit, F.desc("final_score"), "start_ms", "clip_id").cast("long"))


def default_clip(clips: DataFrame) -> DataFrame:
    """(episode_id, clip_id): the best clip of each episode."""
    return clips.groupBy("episode_id").agg(F.max_by("clip_id", F.struct("final_score", F.col("start_ms") * -1, "clip_id")).alias("clip_id"))


def reserve_pool(clips: DataFrame, n: int = 50) -> DataFrame:
    return clips.withColumn("place", rank_by("episode_id", F.desc("final_score"), "clip_id").cast("long")).where(F.col("place") <= n)


def bucket_cap(clips: DataFrame, ms: int = 30_000, most: int = 1) -> DataFrame:
    """At most one clip of over 30 seconds in an episode."""
    rows = clips.withColumn("_long", F.col("end_ms") - F.col("start_ms") > ms)
    return rows.withColumn("_r", rank_by(["episode_id", "_long"], F.desc("final_score"), "clip_id")).where(~F.col("_long") | (F.col("_r") <= most)).drop("_long", "_r")


def rank_titles(titles: DataFrame, clips: DataFrame) -> DataFrame:
    """Titles (clip_id, title) of each clip by words shared with its text, length and punch."""
    rows = titles.join(clips.select("clip_id", "text"), "clip_id")
    shared = jaccard(F.split(F.lower("title"), r"\s+"), F.split(F.lower(F.trim("text")), r"\s+"))
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.length("title") - 45) / 45)
    score = F.round(0.5 * shared + 0.4 * fit + 0.1 * F.col("title").rlike(r"[0-9?!]").cast("int"), 6)
    rows = rows.withColumn("score", score)
    return rows.withColumn("place", rank_by("clip_id", F.desc("score"), "title").cast("long")).drop("text")


def hashtag_pack(keywords: DataFrame, by: str, most: int = 3, chars: int = 45) -> DataFrame:
    """(by, tags): keywords in order as tags, those passed over that would go past the length."""

    def step(done: Column, x: Column) -> Column:
        tag = F.concat(F.lit("#"), F.regexp_replace(x["term"], r"[^\p{L}0-9]", ""))
        room = F.length(F.array_join(done, " ")) + 1 + F.length(tag) <= chars
        return F.when((F.size(done) < most) & room, F.concat(done, F.array(tag))).otherwise(done)

    return ordered_fold(keywords, by, [F.col("rank")], ["term"], "cast(array() as array<string>)", step, "tags")


def fail_reason(df: DataFrame) -> DataFrame:
    """The first soft rejection that holds, or null."""
    hook, pay, aro, q = (F.coalesce(c, F.lit(0.0)) for c in ("hook", "payoff", "arousal", "question"))
    limit = F.when((pay >= 0.6) & (aro >= 0.45), 0.06).when((pay >= 0.4) & (aro >= 0.35), 0.10).otherwise(0.15)
    ad, none = F.coalesce("ad_penalty", F.lit(0.0)) >= 0.3, pay < 0.25
    reason = (
        F.when((hook < 0.08) & ad & none, "ad_like;weak_hook;no_payoff").when((hook < 0.08) & ad, "ad_like;weak_hook").when((hook < 0.08) & none, "weak_hook;no_payoff")
        .when(hook < 0.08, "weak_hook_very_soft").when(hook < limit, "weak_hook_mild_soft").when(none & (q < 0.50), "no_payoff").when(aro < 0.20, "low_energy")
    )
    return df.withColumn("fail_reason", reason)


def family_pick(variants: DataFrame) -> DataFrame:
    """Of each family: finished first, then longer, then better."""
    order = [F.desc("finished"), F.desc(F.col("end_ms") - F.col("start_ms")), F.desc("final_score"), F.col("clip_id")]
    return variants.withColumn("_r", rank_by(["episode_id", "family"], *order)).where("_r = 1").drop("_r")


def delivery_view(clips: DataFrame, n: int = 10) -> DataFrame:
    """Clips without ads in order, n for each episode, scores on 0 to 100 whichever scale they came in."""
    score = F.when(F.col("final_score") <= 1, F.col("final_score") * 100).otherwise(F.col("final_score"))
    rows = clips.where(~F.coalesce("is_ad", F.lit(False))) if "is_ad" in clips.columns else clips
    rows = rows.withColumn("score_100", F.round(score, 4))
    return rows.withColumn("place", rank_by("episode_id", F.desc("score_100"), "clip_id").cast("long")).where(F.col("place") <= n)


# --- de-duplication ----------------------------------------------------------------------------------------------

CLIP = ["clip_id", "start_ms", "end_ms", "final_score"]


def best_first() -> list[Column]:
    return [-F.col("final_score"), F.col("start_ms"), F.col("clip_id")]


def nms(clips: DataFrame, least: float = 0.55, hull: bool = False, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips in order of score, those dropped that overlap a kept one by `least` or more. Clips without a span stay."""
    return greedy_keep(clips, "episode_id", best_first(), CLIP, Overlap(least, hull), large_group=large_group)


def drop_overlaps(clips: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips in order of score that touch no kept one."""
    return greedy_keep(clips, "episode_id", best_first(), CLIP, Touch(), large_group=large_group)


def dedup_iou(clips: DataFrame, least: float = 0.85, large_group: int = LARGE_GROUP) -> DataFrame:
    """As nms, finished clips and those nearer to 18 seconds first among equal scores."""
    order = [-F.col("final_score"), (~F.col("finished")).cast("int"), F.abs(F.col("end_ms") - F.col("start_ms") - 18_000), F.col("clip_id")]
    return greedy_keep(clips, "episode_id", order, CLIP, Overlap(least), large_group=large_group)


def dedup_timing(clips: DataFrame, tolerance_ms: int = 150, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips dropped of which both ends are within the tolerance of a kept one's."""
    return greedy_keep(clips, "episode_id", best_first(), CLIP, Near(("start_ms", "end_ms"), tolerance_ms), large_group=large_group)


def with_words(clips: DataFrame) -> DataFrame:
    return clips.withColumn("ws", F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+")))


def dedup_text(clips: DataFrame, least: float = 0.90, near_ms: int | None = None, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips dropped whose words are like a kept one's; with `near_ms`, only if their middles are as near."""
    return greedy_keep(with_words(clips), "episode_id", best_first(), [*CLIP, "ws"], Alike("ws", least, near_ms), large_group=large_group).drop("ws")


def dedupe_candidates(clips: DataFrame, overlap: float = 0.6, alike: float = 0.85, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips dropped that overlap a kept one or have its words."""
    rule = AnyOf((Overlap(overlap), Alike("ws", alike)))
    return greedy_keep(with_words(clips), "episode_id", best_first(), [*CLIP, "ws"], rule, large_group=large_group).drop("ws")


def semantic_dedupe(embeddings: DataFrame, key: str, block: str, vector: str, least: float = 0.92) -> DataFrame:
    """(block, key): rows of which no kept row of their block with a smaller key has cosine `least` or more.

    Copies of a vector go with the first of them, which either stays or is itself like a kept row. The others are settled
    link by link (operators.vectors); no block is gathered.
    """
    once = written(distinct_vectors(embeddings, key, block, vector), "distinct")
    gone = first_kept(similar_pairs(once, least))
    rows = embeddings.select(F.col(block).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(dot(F.col("v"), F.col("v")) > 0, F.lit(False)) & ~F.coalesce(F.isnan(dot(F.col("v"), F.col("v"))), F.lit(False)) & F.col("id").isNotNull()
    same = once.g.eqNullSafe(gone.g) & (once.id == gone.id)
    kept = once.join(gone, same, "left_anti").select("g", "id").unionByName(rows.where(~usable).select("g", "id"))
    return kept.select(F.col("g").alias(block), F.col("id").alias(key))


def unique_texts(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """The first row of each text, whatever its case and punctuation."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]+", " "))
    return df.withColumn("_plain", plain).withColumn("_r", rank_by([*by, "_plain"], order)).where("_r = 1").drop("_plain", "_r")


def union_candidates(seeds: DataFrame, others: DataFrame) -> DataFrame:
    return seeds.withColumn("source", F.lit("seed")).withColumn("is_seed", F.lit(True)).unionByName(
        others.withColumn("source", F.lit("other")).withColumn("is_seed", F.lit(False)), allowMissingColumns=True
    )


def remaining(every: DataFrame, chosen: DataFrame, key: str = "clip_id") -> DataFrame:
    return every.join(chosen.select(key).distinct(), key, "left_anti")
