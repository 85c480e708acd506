"""Queries of virality, genre verdicts, lengths by platform and moved ends. The SQL states every rule again.

Text rules run on every segment with a cue sentence before it; feature values are fractions made from the segment's
keys, so that every branch is met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import genres, sequence, virality
from cliploom.plans import sql as S
from cliploom.plans.queries import MARKS, clips, marks, query, segments, words

CUES = (
    "Trust me, this week he's a league winner; start him now. ", "So we waited, then it was out of nowhere. That's why it works. ", "This is it, because you won't believe the funniest plot twist. ",
    "Sleeper pick tonight: buy low, sell high, must-start before the deadline. ", "I thought it was over; turns out the investigation found evidence of mystery. ",
    "I can't believe this actually happened, which means a shocking, unexpected end. ", "Thanks for watching, subscribe! ", "I guarantee it 100%, absolutely, definitely: GPP leverage and value play. ", "",
)
#: Columns made from the keys: multiplier of each key and modulus.
MADE = {
    "hook": (7, 13, 101), "arousal": (11, 17, 97), "payoff": (5, 29, 89), "info_density": (3, 31, 83), "question": (1, 37, 79), "q_list": (2, 41, 73), "loopability": (19, 43, 71),
    "emotion": (23, 47, 67), "insight": (29, 53, 61), "mystery_score": (3, 5, 59), "resolution_score": (7, 11, 53), "authority_score": (13, 3, 47), "specificity_score": (5, 7, 43),
    "curiosity_score": (11, 2, 41), "clarity_score": (17, 19, 37), "credibility_score": (2, 23, 31), "transformation_score": (29, 3, 29), "urgency_score": (31, 5, 23), "controversy_score": (37, 7, 19),
    "confidence_score": (41, 11, 17), "viral_trigger_boost": (43, 13, 13), "timing_score": (47, 17, 11), "surprise_score": (53, 19, 7),
}
GENRES = ("general", "true_crime", "business", "educational", "health_wellness", "news_politics", "fantasy_sports", "comedy", "unheard")
X = f"""{S.SEGMENTS}, cue as (select unnest([{", ".join(f"'{S.quoted(c)}'" for c in CUES)}]) as cue, unnest(range({len(CUES)})) as no),
x as (select episode_id, seg_idx, start_ms, end_ms, cue || text as text, lower(cue || text) as t, greatest(0.1, (end_ms - start_ms) / 1000)::double as s, n_words, regexp_matches(text, '[.!?]\\s*$') as finished,
    (episode_id + seg_idx) % 3 = 0 as payoff_ok, (episode_id + seg_idx) % 7 = 0 as ad_flag, ((episode_id + seg_idx) % 5) / 50::double as penalty, {", ".join(f"((episode_id * {a} + seg_idx * {b}) % {m}) / {m - 1}::double as {n}" for n, (a, b, m) in MADE.items())},
    [{", ".join(f"'{g}'" for g in GENRES)}][(episode_id * 5 + seg_idx) % {len(GENRES)} + 1] as genre from segments join cue on no = (episode_id + seg_idx) % {len(CUES)})"""


def made(spark, d):
    e, s = F.col("episode_id"), F.col("seg_idx")
    cue = F.get(F.array(*map(F.lit, CUES)), ((e + s) % len(CUES)).cast("int"))
    rows = segments(spark, d).select(
        e, s, "start_ms", "end_ms", F.concat(cue, "text").alias("text"), F.col("text").rlike(r"[.!?]\s*$").alias("finished"), ((e + s) % 3 == 0).alias("payoff_ok"), ((e + s) % 7 == 0).alias("ad_flag"),
        ((e + s) % 5 / 50).alias("penalty"), F.get(F.array(*map(F.lit, GENRES)), ((e * 5 + s) % len(GENRES)).cast("int")).alias("genre"), F.size(F.split(F.trim("text"), r"\s+")).alias("n_words"),
    )
    return rows.withColumns({n: (e * a + s * b) % m / (m - 1) for n, (a, b, m) in MADE.items()})


SHAPE = """(case when finished and s >= 20 then 0.12 when finished then 0.08 else 0 end)::double - (case when s >= 16 and payoff < 0.3::double then 0.15::double * (0.3::double - payoff) else 0 end)::double
    - (case when s <= 10 and (hook < 0.92::double or payoff < 0.6::double) then 0.5 else 0 end)::double"""
PRIOR = "(case when s < 8 then -1 / (1 + exp(-(8 - s))) when s > 45 then -1 / (1 + exp(-(s - 45))) else 0 end)::double"
REST = f"""0.1::double * question + q_list * (case when payoff_ok then 0.03 else -0.01 end)::double + (case when finished then 0.02::double * loopability else 0 end)::double + {SHAPE} + 0.4::double * {PRIOR} - penalty"""
PLAIN = f"greatest(0.0::double, (0.35::double * hook + 0.2::double * arousal + 0.1::double * payoff + 0.05::double * info_density) / 0.7::double + {REST})"
WEIGHED = f"""greatest(0.0::double, case when payoff_ok then 0.4::double * hook + 0.22::double * arousal + 0.32::double * payoff + 0.06::double * info_density
    else (0.4::double * hook + 0.22::double * arousal + 0.2::double * payoff + 0.06::double * info_density) / 0.88::double end + {REST})"""


@query("e11_v_core", f"""with {X} select episode_id, seg_idx, round(greatest(0.0::double, 0.26::double * hook + 0.2::double * arousal + 0.17::double * payoff + 0.11::double * info_density + 0.09::double * question
    + q_list * (case when payoff_ok then 0.04 else -0.01 end)::double + (case when finished then 0.05::double * loopability else 0 end)::double + {SHAPE} - penalty), 6) as v_core from x""")
def v_core(spark, d):
    return virality.core_virality(made(spark, d)).select("episode_id", "seg_idx", "v_core")


@query("e11_virality", f"with {X} select episode_id, seg_idx, round({PLAIN}, 6) as virality, round({WEIGHED}, 6) as rebalanced from x")
def e11_virality(spark, d):
    rows = virality.virality(made(spark, d), rebalanced=True).withColumnRenamed("virality", "rebalanced")
    return virality.virality(rows).select("episode_id", "seg_idx", "virality", "rebalanced")


@query("e11_utility", rf"""with {X} select episode_id, seg_idx, round({PLAIN} + (case when finished then 0.55 when s >= 18 then 0.12 else 0.24 end)::double
    + regexp_matches(t, '\b(because|so that|which means|so you can|therefore|as a result|that''s why)\b')::int * 0.08::double - ad_flag::int * 0.6::double, 6) as utility,
    round(hook + (case when finished then 0.15 when s >= 18 then -0.06 else 0 end)::double, 6) as sparse_utility from x""")
def e11_utility(spark, d):
    rows = virality.end_utility(made(spark, d))
    return rows.select("episode_id", "seg_idx", "utility", F.round(virality.finish_adjusted(F.col("hook"), virality.clip_seconds(), F.col("finished"), True), 6).alias("sparse_utility"))


def each(weight: str, most: str, *patterns: str) -> str:
    return f"round(least({most}, {weight} * ({' + '.join(f'''regexp_matches(t, '{S.quoted(p)}')::int''' for p in patterns)}))::double, 6)"


@query("d27_sports_comedy", rf"""with {X} select episode_id, seg_idx,
    {each("0.2", "1.0", "this week", "tonight", "tomorrow", "immediately", "now", "before", "deadline", "last chance")} as fantasy_sports_urgency_score,
    {each("0.25", "1.0", "trust me", "i'm telling you", "mark my words", "guarantee", "100%", "definitely", "absolutely")} as fantasy_sports_confidence_score,
    {each("0.1", "0.3", "sleeper (pick|candidate|alert)", "league winner", "waiver (wire|pickup|add)", "must[ -]?start", "sit[ /]start", "buy low", "sell high", "(dfs|draft) (play|pick)", "chalk play", "gpp (play|leverage)", "value play", "(trade|roster) advice")} as fantasy_sports_viral_trigger_boost,
    {each("0.3", "1.0", "so.*then", "first.*then", "started.*ended", "thought.*turns out", "expected.*got")} as comedy_timing_score,
    {each("0.25", "1.0", "plot twist", "unexpected", "shocking", "out of nowhere", "didn't see that coming")} as comedy_surprise_score,
    {each("0.15", "0.4", "the (funniest|craziest|weirdest)", "you won't believe", "this actually happened", "caught (me|him|her) off guard")} as comedy_viral_trigger_boost from x""")
def d27_more(spark, d):
    found = genres.more_patterns(F.col("text"))
    return made(spark, d).select("episode_id", "seg_idx", *(F.round(c, 6).alias(n) for n, c in found.items()))


HOOK = "0.5 hook 0.2 arousal 0.15 payoff 0.1 info_density 0.05 loopability"
PAY = "0.4 payoff 0.3 info_density 0.15 emotion 0.1 hook 0.05 arousal"
BASE = "0.45 hook 0.25 arousal 0.15 payoff 0.1 info_density 0.05 loopability"
#: genre, path, then weights and features.
ROUTES = f"""general|hook|{BASE}
general|payoff|{PAY}
general|energy|0.4 arousal 0.25 emotion 0.2 hook 0.1 loopability 0.05 question
general|structured|0.25 question 0.25 info_density 0.2 payoff 0.2 hook 0.1 arousal
true_crime|hook|{HOOK}
true_crime|payoff|{PAY}
true_crime|mystery|0.4 hook 0.3 mystery_score 0.2 emotion 0.1 info_density
true_crime|resolution|0.4 payoff 0.3 resolution_score 0.2 mystery_score 0.1 emotion
business|hook|{HOOK}
business|payoff|{PAY}
business|authority|0.4 payoff 0.3 authority_score 0.2 info_density 0.1 hook
business|specificity|0.4 info_density 0.3 specificity_score 0.2 payoff 0.1 hook
educational|hook|{HOOK}
educational|payoff|{PAY}
educational|curiosity|0.4 hook 0.3 curiosity_score 0.2 info_density 0.1 arousal
educational|clarity|0.4 payoff 0.3 clarity_score 0.2 info_density 0.1 hook
health_wellness|hook|{HOOK}
health_wellness|payoff|{PAY}
health_wellness|credibility|0.4 payoff 0.3 credibility_score 0.2 info_density 0.1 hook
health_wellness|transformation|0.4 emotion 0.3 transformation_score 0.2 payoff 0.1 hook
news_politics|hook|{HOOK}
news_politics|payoff|{PAY}
news_politics|urgency|0.4 hook 0.3 urgency_score 0.2 arousal 0.1 info_density
news_politics|controversy|0.4 arousal 0.3 controversy_score 0.2 hook 0.1 payoff
fantasy_sports|hook|{HOOK}
fantasy_sports|payoff|0.45 payoff 0.25 info_density 0.15 confidence_score 0.1 hook 0.05 arousal
fantasy_sports|actionable|0.4 payoff 0.3 info_density 0.2 confidence_score 0.1 urgency_score
fantasy_sports|hot_take|0.25 confidence_score 0.5 hook 0.25 viral_trigger_boost
comedy|hook|{BASE}
comedy|payoff|{PAY}
comedy|setup_punchline|0.45 hook 0.35 payoff 0.2 timing_score
comedy|energy|0.5 arousal 0.3 emotion 0.2 surprise_score"""


def route(line: str) -> str:
    genre, path, shares = line.split("|")
    parts = shares.split()
    value = " + ".join(f"{w}::double * {n}" for w, n in zip(parts[::2], parts[1::2]))
    return f"select episode_id, seg_idx, genre, gate, '{path}' as path, round({value}, 6) as path_score from gated where genre = '{genre}'"


@query("e04_genre_verdict", f"""with {X}, known as (select * replace (case when genre = 'unheard' then 'general' else genre end as genre) from x), fit as (select * replace (
    case when genre = 'fantasy_sports' and payoff > 0.6::double then least(payoff * 1.2::double, 1.0::double) else payoff end as payoff, case when genre = 'fantasy_sports' and info_density > 0.4::double then least(info_density * 1.15::double, 1.0::double) else info_density end as info_density,
    case when genre = 'fantasy_sports' and hook < 0.3::double then hook * 1.3::double else hook end as hook, case when genre = 'comedy' and arousal > 0.5::double then least(arousal * 1.25::double, 1.0::double) else arousal end as arousal,
    case when genre = 'comedy' and emotion > 0.3::double then least(emotion * 1.2::double, 1.0::double) else emotion end as emotion) from known),
    gated as (select *, (case when genre = 'true_crime' then case when mystery_score < 0.2::double and resolution_score < 0.2::double then 0.8 else 1 end
        when genre = 'health_wellness' then case when payoff < 0.3::double and credibility_score < 0.2::double then 0.8 else 1 end
        when genre = 'news_politics' then case when hook < 0.4::double and urgency_score < 0.2::double then 0.75 else 1 end
        when payoff >= 0.3::double or insight >= 0.7::double or question >= 0.5::double then 1
        when genre = 'business' then 0.8 when genre = 'fantasy_sports' then 0.85 when hook >= 0.4::double then 0.95 else 0.85 end)::double as gate from fit),
    routes as ({" union all ".join(map(route, ROUTES.splitlines()))})
    select episode_id, seg_idx, genre, gate, path, path_score, round(path_score * gate, 6) as genre_score from (select *, row_number() over (partition by episode_id, seg_idx order by path_score desc, path) as place from routes) where place = 1""")
def e04_verdict(spark, d):
    return genres.genre_verdict(made(spark, d)).select("episode_id", "seg_idx", "genre", "gate", "path", "path_score", "genre_score")


@query("e09_calibrate_v2", f"""with {X} select episode_id, seg_idx, round(case when hook <= 0.35::double then hook * 0.95::double when hook <= 0.55::double then hook * 1.12::double when hook <= 0.75::double then hook * 1.05::double else least(0.95::double, hook * 0.98::double) end, 6) as calibrated,
    points, case when points >= 90 then 'Exceptional' when points >= 80 then 'Premium' when points >= 70 then 'Strong' when points >= 60 then 'Good' else 'Fair' end as band
    from (select *, (case when arousal < 0.1::double then 40 else least(floor(round((arousal - 0.1::double) / 0.7::double * 50 + 45, 9)), 100) end)::bigint as points from x)""")
def e09_v2(spark, d):
    points, band = virality.confidence_band(F.col("arousal"))
    return made(spark, d).select("episode_id", "seg_idx", F.round(virality.calibrate_v2(F.col("hook")), 6).alias("calibrated"), points.alias("points"), band.alias("band"))


@query("d20_niche_hook", rf"""with {X} select episode_id, seg_idx, (case when genre <> 'fantasy_sports' and regexp_matches(t, '\b(like that|that''s|this is)\b') then 0.1 else 0 end)::double as niche,
    round((case when arousal >= 0.4::double then least(hook, 0.3::double) else hook end) * (case when emotion >= 0.3::double then 0.7 else 1 end)::double, 6) as held_hook from x""")
def d20_niche(spark, d):
    held = virality.clamped_hook(F.col("hook"), F.col("arousal"), F.col("emotion"))
    return made(spark, d).select("episode_id", "seg_idx", virality.niche_penalty(F.col("text"), F.col("genre")).alias("niche"), F.round(held, 6).alias("held_hook"))


KIND = "['sentence_end', 'insight_marker', 'mid_word', 'other'][(episode_id + seg_idx) % 4 + 1]"
TRAPEZOID = """case when s between b0 and b1 then 1 when s between f0 and f1 then 0.5 + 0.5 * (case when s < b0 then (s - f0) / (b0 - f0) else (f1 - s) / (f1 - b1) end)
    when s between l0 and l1 then 0.2 + 0.3 * (case when s < f0 then (s - l0) / (f0 - l0) else (l1 - s) / (l1 - f1) end) else 0 end"""


@query("d23_length_trapezoid", f"""with {X}, p(platform, b0, b1, f0, f1, l0, l1) as (values ('tiktok', 15::double, 30::double, 5::double, 45::double, 3::double, 60::double), ('instagram', 15, 30, 5, 45, 3, 60), ('instagram_reels', 15, 30, 5, 45, 3, 60), ('youtube_shorts', 20, 45, 5, 60, 3, 90), ('linkedin', 30, 60, 10, 90, 5, 120))
    select episode_id, seg_idx, platform, round(({TRAPEZOID})::double, 6) as fit, round(least(1, ({TRAPEZOID}) + (case when (episode_id + seg_idx) % 4 < 2 and hook > 0.8::double then 0.1 else 0 end))::double, 6) as bounded from x, p""")
def d23_trapezoid(spark, d):
    """Seconds of whole segments; the five platforms are fixed."""
    rows = made(spark, d).withColumn("s", virality.clip_seconds()).withColumn("kind", kind())
    s = F.col("s")
    fits = [F.struct(F.lit(p).alias("platform"), F.round(virality.length_trapezoid(s, p), 6).alias("fit"), F.round(virality.clean_bound(s, p, F.col("kind"), F.col("hook")), 6).alias("bounded")) for p in virality.LENGTH_SPANS]
    return rows.select("episode_id", "seg_idx", F.inline(F.array(*fits)))


def kind():
    return F.get(F.array(*map(F.lit, ("sentence_end", "insight_marker", "mid_word", "other"))), ((F.col("episode_id") + F.col("seg_idx")) % 4).cast("int"))


@query("d23_length_bell", f"""with {X}, y as (select *, {KIND} as kind, case when loopability >= 0.6::double then 20 else 22 end as mu, case when loopability >= 0.6::double then 5.5 else 7 end as sigma, n_words / s as wps from x),
    z as (select *, exp(-0.5::double * pow((s - mu) / sigma, 2)) * (case when s >= 59 then 0.85 else 1 end)::double as g,
        (case when wps <= 2.8::double or wps >= 4.5::double then 0 when wps < 3.65::double then (wps - 2.8::double) / 0.85::double else (4.5::double - wps) / 0.85::double end)::double as pace from y),
    m as (select *, case when wps > 0 then 0.85::double * g + 0.15::double * pace else g end as b, (case when kind = 'sentence_end' and hook >= 0.9::double then 0.1 when kind in ('sentence_end', 'insight_marker') and hook >= 0.75::double then 0.05 else 0 end)::double as bonus from z)
    select episode_id, seg_idx, round(case when s > 60 then 0 else greatest(0.0::double, least(1.0::double, case when bonus > 0 then least(1.0::double, b + bonus) when kind = 'mid_word' then b * 0.85::double else b end
        - regexp_matches(t, 'thanks for watching|subscribe|follow|like and subscribe|link in bio|see you next time')::int * 0.15::double)) end::double, 6) as bell from m""")
def d23_bell(spark, d):
    s = virality.clip_seconds()
    bell = virality.length_bell(s, F.col("n_words") / s, F.col("loopability"), kind(), F.col("hook"), F.col("text"))
    return made(spark, d).select("episode_id", "seg_idx", F.round(bell, 6).alias("bell"))


# --- ends --------------------------------------------------------------------------------------------------------

ENDS = f"""{S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, {MARKS}, c as (select episode_id, clip_id, start_ms, end_ms - (start_ms // 50) % 90 * 50 as e from clips)"""


def early(spark, d):
    """Clips whose ends come up to 4.45 s too soon."""
    cut = F.col("end_ms") - F.floor(F.col("start_ms") / 50) % 90 * 50
    return clips(spark, d).select("episode_id", "clip_id", "start_ms", cut.alias("end_ms"))


@query("c32_capped_end", f"""with {ENDS}, n as (select *, (select min(t_ms) from marks m where m.episode_id = c.episode_id and t_ms >= e + 50) as nx from c)
    select episode_id, clip_id, start_ms, (case when nx <= least(start_ms + 30000, e + 8000) then nx else e end)::bigint as end_ms from n""")
def c32_capped(spark, d):
    return sequence.extend_capped(early(spark, d), marks(spark, d))


@query("c32_coherent_end", f"""with {ENDS}, n as (select *, (select min(t_ms) from marks m where m.episode_id = c.episode_id and t_ms > e and t_ms <= e + 5000) as nx, (select min(end_ms) from segments m where m.episode_id = c.episode_id and end_ms >= e and end_ms <= e + 5000) as sx from c)
    select episode_id, clip_id, start_ms, coalesce(nx, sx, e)::bigint as end_ms from n""")
def c32_coherent(spark, d):
    return sequence.coherent_end(early(spark, d), marks(spark, d), segments(spark, d))


@query("c32_natural_end", rf"""with {ENDS}, l as (select *, lead(w) over (partition by episode_id order by word_idx) as nw from words), f as (select episode_id, end_ms as t_ms from l where regexp_matches(w, '[.!?]$') and (nw is null or regexp_matches(nw, '^\p{{Lu}}'))),
    n as (select *, (select min(t_ms) from f m where m.episode_id = c.episode_id and t_ms > e and t_ms <= e + 3000) as nx from c) select episode_id, clip_id, start_ms, coalesce(nx, e)::bigint as end_ms, coalesce(nx - e, 0)::bigint as moved_ms from n""")
def c32_natural(spark, d):
    return sequence.natural_end(early(spark, d), words(spark, d))


@query("c32_micro_jitter", rf"""with {ENDS}, j as (select *, e + (start_ms // 50) % 90 * 50 - (start_ms // 50) % 7 * 50 as f from c),
    n as (select j.episode_id, clip_id, j.start_ms, f, arg_min(w.end_ms, w.word_idx) as nx from j left join words w on w.episode_id = j.episode_id and w.start_ms >= f - 250 and w.end_ms <= f + 250 and w.start_ms >= j.start_ms and regexp_matches(w.w, '[.!?]["'')\]”’»›]*\s*$') group by 1, 2, 3, 4)
    select episode_id, clip_id, start_ms, coalesce(nx, f)::bigint as end_ms from n""")
def c32_jitter(spark, d):
    near = F.col("end_ms") - F.floor(F.col("start_ms") / 50) % 7 * 50
    return sequence.micro_jitter(clips(spark, d).select("episode_id", "clip_id", "start_ms", near.alias("end_ms")), words(spark, d))
