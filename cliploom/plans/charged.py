"""Queries of arousal by genre and with sound, loops, speech rates, ad verdicts and floors. The SQL states every rule again."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import energy
from cliploom.plans import sql as S
from cliploom.plans.queries import clips, query, segments

CUES = (
    "WOW! This is INSANE!!! We must start him now. ", "It was good, nice and interesting; a funny joke with a punchline, haha! ", "The killer left evidence: what a mystery!! Why? Who? ", "Crazy. ",
    "Here's the thing, use code TEN at squarespace, call 555 123 4567 or see https://x.example/a. ", "Sponsored by nordvpn, visit www.x.example/b today. ", "Great, awesome, powerful and OK; urgent and important. ", "",
)
TAILS = (" but", " That's it.", " Why?", " wait...", " However, it goes on. ", "")
GENRES = ("fantasy_sports", "comedy", "true_crime", "general")
X = f"""{S.SEGMENTS}, cue as (select unnest([{", ".join(f"'{S.quoted(c)}'" for c in CUES)}]) as cue, unnest(range({len(CUES)})) as no),
x as (select *, lower(text) as t from (select episode_id, seg_idx, start_ms, end_ms, (end_ms - start_ms) / 1000::double as s, case when seg_idx % 3 = 0 then cue else cue || text end || ['{"', '".join(S.quoted(c) for c in TAILS)}'][(episode_id + seg_idx * 5) % {len(TAILS)} + 1] as text, n_words,
    ['{"', '".join(GENRES)}'][(episode_id * 3 + seg_idx) % 4 + 1] as genre, regexp_matches(text, '[.!?]\\s*$') as finished,
    ((episode_id * 7 + seg_idx * 13) % 101) / 100::double as a, ((episode_id * 11 + seg_idx * 17) % 97) / 60::double as b, ((episode_id * 5 + seg_idx * 29) % 89) / 88::double as c from segments join cue on no = (episode_id + seg_idx) % {len(CUES)}))"""


def made(spark, d):
    e, s = F.col("episode_id"), F.col("seg_idx")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    cue = pick(CUES, (e + s) % len(CUES))
    rows = segments(spark, d).select(
        e, s, "start_ms", "end_ms", F.concat(F.when(s % 3 == 0, cue).otherwise(F.concat(cue, "text")), pick(TAILS, (e + s * 5) % len(TAILS))).alias("text"), F.col("text").rlike(r"[.!?]\s*$").alias("finished"),
        pick(GENRES, (e * 3 + s) % 4).alias("genre"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), 0)).alias("n_words"),
    )
    made_of = {"a": (7, 13, 101, 100), "b": (11, 17, 97, 60), "c": (5, 29, 89, 88)}
    return rows.withColumns({n: (e * p + s * q) % m / k for n, (p, q, m, k) in made_of.items()} | {"s": (F.col("end_ms") - F.col("start_ms")) / 1000})


def some(weight: str, most: str, words: str) -> str:
    return f"least({most}::double, ({' + '.join(f'''contains(t, '{w}')::int''' for w in words.split())}) * {weight}::double)"


AROUSAL = rf"""least(1.0::double, (case when n >= 3 then 0.4 when n = 2 then 0.25 when n = 1 then 0.15 else 0 end)::double + least(0.25::double, caps * 0.12::double)
    + {some("0.15", "0.4", "insane shocking unbelievable mind-blowing incredible crazy wild epic amazing")} + {some("0.08", "0.2", "awesome great fantastic wonderful exciting thrilling intense powerful")}
    + {some("0.03", "0.1", "good nice cool interesting fun enjoyable")} + {some("0.08", "0.2", "now immediately urgent critical important must need quickly")} + least(0.15::double, q * 0.05::double)
    + case genre when 'fantasy_sports' then {some("0.1", "0.2", "fire draft start bench target sleeper bust league-winner")} when 'comedy' then {some("0.12", "0.25", "hilarious funny lol haha rofl joke punchline")}
        when 'true_crime' then {some("0.1", "0.2", "murder killer victim evidence mystery suspicious alibi")} else 0.0::double end)"""


@query("d06_text_arousal", rf"""with {X}, y as (select *, {S.count("text", "!")} as n, {S.count("text", "?")} as q, len(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) >= 2 and regexp_matches(w, '\p{{Lu}}') and not regexp_matches(w, '\p{{Ll}}'))) as caps from x), z as (select *, {AROUSAL} as v from y)
    select episode_id, seg_idx, round(v, 6) as arousal, round(case genre when 'fantasy_sports' then 0.6::double * a + 0.4::double * v when 'comedy' then 0.8::double * a + 0.2::double * v else 0.7::double * a + 0.3::double * v end, 6) as mixed,
    round(greatest(0.0, least(1.0::double, 0.5::double * v + 0.25::double * least(1.0, b) + 0.15::double * c + 0.1::double * a)), 6) as measured from z""")
def d06(spark, d):
    rows = made(spark, d).withColumn("v", energy.text_arousal(F.col("text"), F.col("genre")))
    v, a = F.col("v"), F.col("a")
    mixes = {"arousal": v, "mixed": energy.sound_mix(v, a, F.col("genre")), "measured": energy.measured_mix(v, F.col("b"), F.col("c"), a)}
    return rows.select("episode_id", "seg_idx", *(F.round(c, 6).alias(n) for n, c in mixes.items()))


@query("d31_prosody_mix", f"""with {X}, m as (select *, avg(b) over w as mb, stddev_pop(b) over w as sb, avg(c) over w as mc, stddev_pop(c) over w as sc from x window w as (partition by episode_id))
    select episode_id, seg_idx, round(0.6::double * a + 0.4::double * (0.5::double * (0.5::double * (tanh(0.75::double * (b - mb) / greatest(0.000001, sb)) + tanh(0.75::double * (c - mc) / greatest(0.000001, sc))) + 1)), 6) as arousal_v2 from m""")
def d31(spark, d):
    return energy.prosody_mix(made(spark, d), "a", "b", "c").select("episode_id", "seg_idx", "arousal_v2")


@query("d17_loopability_v4", rf"""with {X}, y as (select *, list_filter(string_split_regex(t, '\s+'), lambda w: w <> '') as ws, regexp_replace(t, '^\s+|\s+$', '', 'g') as tr from x)
    select episode_id, seg_idx, round(least(1.0, (len(ws) >= 3 and ws[1:3] = ws[len(ws) - 2:len(ws)])::int * 0.4 + regexp_matches(t, 'here''s the thing|the truth is|what i learned|the key is|here''s why|the secret|the trick')::int * 0.2
        + (ends_with(t, '?') or ends_with(t, '...') or ends_with(t, 'but'))::int * 0.15 + (regexp_matches(right(tr, 80), 'but|however|what you don''t|here''s why|the catch') or ends_with(tr, '?') or ends_with(tr, '...'))::int * 0.15
        + (len(ws) <= 8 and regexp_matches(t, 'insane|crazy|wild|epic|amazing'))::int * 0.1)::double, 6) as loopability from y""")
def d17(spark, d):
    return made(spark, d).select("episode_id", "seg_idx", F.round(energy.loopability_v4(F.col("text")), 6).alias("loopability"))


@query("f23_rate_gate", f"""with {X}, y as (select *, case when c >= 0.25::double and s >= 8 then least(0.25::double, c * 0.5::double) else 0.0::double end as delta, (seg_idx % 4) as um, (episode_id + seg_idx) % 7 as fill, a * 3000 as hush from x),
    z as (select *, case when finished or delta > 0.12::double then 1.25::double else 1.0::double end as more from y)
    select episode_id, seg_idx, round(delta, 6) as resolution_delta, fill / greatest(s, 0.001::double) <= 0.18::double * more and um / greatest(s, 0.001::double) <= 0.12::double * more and hush / (greatest(s, 0.001::double) * 1000) <= 0.18::double * more as passes from z""")
def f23(spark, d):
    s, e, i = F.col("s"), F.col("episode_id"), F.col("seg_idx")
    delta = energy.resolution_delta(F.col("c"), s)
    passes = energy.rates_pass(s, (e + i) % 7, i % 4, F.col("a") * 3000, F.col("finished"), delta)
    return made(spark, d).select("episode_id", "seg_idx", F.round(delta, 6).alias("resolution_delta"), passes.alias("passes"))


PHRASES = (
    "this episode is sponsored by", "sponsored by", "use code", "promo code", "limited time offer", "free shipping", "visit our website", "visit ", "order now", "call now", "call today", "learn more",
    "shop now", "click the link", "link in the description", "terms apply", "see site for details",
)


@query("d22_ad_verdict", rf"""with {X}, y as (select *, (case {" ".join(f"when contains(t, '{p}') then '{p}'" for p in PHRASES)} end) as phrase, case when contains(t, 'squarespace') then 'squarespace' when contains(t, 'nordvpn') then 'nordvpn' end as sponsor,
    regexp_matches(t, '\b(?:\+?1[\s\-.]?)?(?:\(?\d{{3}}\)?[\s\-.]?)\d{{3}}[\s\-.]?\d{{4}}\b') as phone, regexp_matches(t, '\b(?:(?:https?://|www\.)\S+|(?:bit\.ly|t\.co|tinyurl\.com|linktr\.ee|lnk\.to|amzn\.to|geni\.us|kit\.co)/\S+)') as link from x)
    select episode_id, seg_idx, (case when phrase is not null then 0.8 when sponsor is not null then 0.7 when phone or link then 0.6 else 0 end)::double as ad_penalty, phrase is not null or sponsor is not null or phone or link as is_advertisement,
    (case when phrase is not null then 0.9 when sponsor is not null then 0.8 when phone or link then 0.7 else 0 end)::double as confidence, concat_ws('; ', 'ad_phrase: ' || phrase, 'sponsor: ' || sponsor, case when phone then 'phone_number' end, case when link then 'url' end) as reasons from y""")
def d22_verdict(spark, d):
    """Sponsors are a parameter; here two of them."""
    found = energy.ad_verdict(F.col("text"), ("squarespace", "nordvpn"))
    return made(spark, d).select("episode_id", "seg_idx", *(F.array_join(c, "; ").alias(n) if n == "reasons" else c.alias(n) for n, c in found.items()))


@query("f07_adaptive_floor", f"""with {S.CLIPS}, sized as (select *, case when end_ms - start_ms < 14000 then 0 when end_ms - start_ms <= 28000 then 1 else 2 end as size from clips), k as (select episode_id, bool_or(size = 0) and bool_or(size = 1) as both_kinds from sized group by 1),
    p as (select s.*, case when both_kinds then size else 3 end as part from sized s join k using (episode_id)), r as (select *, count(*) over (partition by episode_id, part) as n, row_number() over (partition by episode_id, part order by final_score desc, clip_id) as place from p where part <> 2),
    c as (select episode_id, part, quantile_cont(final_score, 0.7) as p70, quantile_cont(final_score, 0.6) as p60 from r where n <= 10 or place > floor(n * 0.1) group by 1, 2), f as (select episode_id, round(least(0.8::double, max(case when part = 0 then p70 else p60 end)) - 0.04::double, 9) as floor from c group by 1)
    select episode_id, clip_id, floor from clips join f using (episode_id) where final_score >= floor""")
def f07_floor(spark, d):
    return energy.adaptive_floor(clips(spark, d), "episode_id").select("episode_id", "clip_id", "floor")
