"""Queries of the evidence columns and of rules that need cue words.

The tables hold no English cue words, so these queries run on every segment of `conversations` with one of a few cue
sentences put before its text, by the segment's number. Their SQL spells each rule out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import evidence as E
from cliploom.operators import features
from cliploom.plans import sql as S
from cliploom.plans.queries import query, segments

CUES = (
    "Most people think so, but actually the answer is 42%. ", "Maybe I think it could work? Because the key is that we won. Therefore stop. ",
    "What if you had to choose? 1. Buy low. 2. Sell high. 3. Hold on. ", "In 1999 investigators discovered evidence of the case; it turns out the truth was here. ",
    "I built my company with $100 and 20% profit after 3 years. ", "Did you know? Here's why, in other words: doctors improve and transform your better life. ",
    "Breaking: just in, a scandal and outrage right now, according to reports. ", "Um hello there, nobody knows, you won't believe it. What do you think? Subscribe and follow! ",
    "Hi everyone. Today the bottom line is: do this, don't do that, and here's how. ", "Here's the thing. ", "Why? ", "",
)
CUED = f"""{S.SEGMENTS}, cue as (select unnest([{", ".join(f"'{S.quoted(c)}'" for c in CUES)}]) as cue, unnest(range({len(CUES)})) as no),
x as (select episode_id, seg_idx, start_ms::bigint as start_ms, end_ms::bigint as end_ms, cue || text as text, lower(cue || text) as t from segments join cue on no = (episode_id + seg_idx) % {len(CUES)})"""
KEYS = ("episode_id", "seg_idx")


def cued(spark: SparkSession, d: str) -> DataFrame:
    cues = F.array(*map(F.lit, CUES))
    at = ((F.col("episode_id") + F.col("seg_idx")) % len(CUES)).cast("int")
    return segments(spark, d).select(*KEYS, "start_ms", "end_ms", F.concat(F.get(cues, at), "text").alias("text"))


def columns(spark: SparkSession, d: str, **wanted) -> DataFrame:
    return cued(spark, d).select(*KEYS, *((F.round(c, 6) if n not in FLAGS else c).alias(n) for n, c in wanted.items()))


FLAGS = ("payoff_label", "has_evidence", "curious")
WS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


def unsure(part: str) -> str:
    cues = ("maybe", "might", "could", "kinda", "sort of", "somewhat", "probably", "possibly", "perhaps", "i think", "i guess", "i feel like")
    count = " + ".join(f"len(regexp_extract_all({part}, '{c}'))" for c in cues)
    return f"(({count})::double / greatest(len(regexp_extract_all({part}, '[a-z0-9'']+')), 1))"


NO_ANSWER = "(contains(t, '?') and not (contains(t, 'answer') or contains(t, 'solution') or contains(t, 'here''s') or contains(t, 'the key')))::int * 0.1"
VALUE = r"regexp_matches(t, 'here''s what|the key|the secret|the trick|you should|you need to|you must|you have to|this will|this can|this helps|this makes|the benefit|the advantage|the upside')::int * 0.15"


@query("d08_payoff_v1", rf"""with {CUED}, p as (select *, {WS} as ws from x), q as (select *, len(ws) as n, lower(array_to_string(ws[1:floor(len(ws) * 0.4::double)::int], ' ')) as a, lower(array_to_string(ws[floor(len(ws) * 0.4::double)::int + 1:floor(len(ws) * 0.7::double)::int], ' ')) as b from p)
    select episode_id, seg_idx, round((case when length(trim(text)) < 8 then 0.0 else greatest(0.0, least(1.0, (case when n >= 12 and {unsure("a")} - {unsure("b")} <= 0.02::double then -0.2 else 0.0 end)
        + regexp_matches(t, 'so|therefore|thus|as a result|consequently|the answer is|the solution is|here''s how|that''s why|which explains|this means|in conclusion|to sum up|the bottom line')::int * 0.2 + {VALUE} - {NO_ANSWER})) end)::double, 6) as payoff_v1 from q""")
def d08(spark, d):
    return columns(spark, d, payoff_v1=E.payoff_v1(F.col("text")))


LEADS = (
    r"\bthe (?:bottom|top) line\b", r"\btl;?dr\b", r"\bhere''?s (?:the|what)\b", r"\bso (?:the|what this) (?:means|is)\b", r"\bnet[-\s]?net\b", r"\bkey takeaway\b",
    r"\bin (?:short|summary)\b", r"\bthe answer is\b", r"\bthe play (?:here|now) is\b", r"\bmy advice\b", r"\bpro tip\b", r"\bdo this\b", r"\byou should\b",
    r"\bthe trick is\b", r"\bhere''?s how\b", r"\bsteps? to\b", r"\bstop doing\b", r"\bstart doing\b", r"\btherefore\b", r"\bbecause\b",
)


@query("d09_payoff_v2", rf"""with {CUED}, p as (select *, array_to_string({WS}, ' ') as u from (select * replace (case when length(text) > 1800 then left(text, 900) || ' ... ' || right(text, 900) else text end as text) from x)),
    pat(re, w, more, kind) as (values {", ".join(f"('(?i){p}', 0.25::double, 0.15::double, 'lead')" for p in LEADS)}, ('\b\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?\b|\b\d+%|\$\d+(?:\.\d+)?', 0.12::double, 0.08::double, 'numeric')),
    f as (select episode_id, seg_idx, u, w, more, kind, string_split_regex(u, re) as gaps, regexp_extract_all(u, re) as found from p, pat), g as (select *, unnest(range(1, least(len(found), 5) + 1)) as i from f),
    h as (select episode_id, seg_idx, kind, w + case when list_sum(list_transform(gaps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda v: length(v))), 0) >= floor(length(u) * 0.65::double) then more else 0 end as v from g),
    k as (select episode_id, seg_idx, sum(v) as v, max((kind = 'lead')::int) as lead from h group by 1, 2),
    m as (select p.episode_id, p.seg_idx, p.text, u, coalesce(v, 0) as v, lead, instr(u, '?') - 1 as qp, length(u) as n, trim(substr(u, instr(u, '?') + 1)) as rest, list_filter(string_split(regexp_replace(trim(u), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')[-1] as last from p left join k using (episode_id, seg_idx)),
    r as (select *, qp >= 0 and qp < n - 5 and length(rest) > 15 and not contains(rest, '?') as qa, regexp_matches(last, '(?i)\b(so|hence|therefore|that means|in short)\b') as ends,
        regexp_matches(u, '(?i)\bsubscribe\b')::int + regexp_matches(u, '(?i)\bfollow\b')::int + regexp_matches(u, '(?i)\bsmash (?:that )?like\b')::int + regexp_matches(u, '(?i)\bcheck (?:the )?link\b')::int + regexp_matches(u, '(?i)\bjoin (?:my|our)\b')::int as bad from m),
    z as (select *, greatest(0, least(1, v + case when qa then case when qp >= floor(n * 0.4::double) then 0.32 else 0.22 end else 0 end + coalesce(ends, false)::int * 0.15 - bad * 0.2))::double as s from r)
    select episode_id, seg_idx, round(case when length(text) < 24 then 0 when s > 0.75 then 0.75 + 0.25 * (s - 0.75) else s end, 6)::double as payoff,
        case when length(text) < 24 then 'none' when lead = 1 then 'lead' when lead = 0 then 'numeric' when qa then 'qa' when ends then 'conclusion' else 'none' end as payoff_label from z""")
def d09(spark, d):
    paid = E.payoff_v2(F.col("text"))
    return columns(spark, d, payoff=paid["score"], payoff_label=paid["label"])


@query("d10_payoff_presence", rf"""with {CUED}, p as (select *, string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ss from x) select episode_id, seg_idx, round((case when length(trim(text)) < 8 then 0.0 else greatest(0.0, least(1.0,
        regexp_matches(t, 'here(''?s)? (how|why|the deal|what you need)|the (solution|answer|truth|key)|because|so that|which means|in other words|this means|the (lesson|takeaway|insight|bottom line)|therefore|thus|that''s why|turns out')::int * 0.25
        + contains(t, 'therefore stop')::int * 0.15 + {VALUE} - {NO_ANSWER})) end)::double, 6) as payoff_presence, regexp_matches(t, '\b(because|so that|which means|so you can|therefore|as a result|that''s why)\b')::int * 0.08::double as resolution_bonus,
        (len(list_filter(ss[1:len(ss) - 1], lambda s: ends_with(s, '?'))) > 0 and regexp_matches(ss[-1], '[.!?]$'))::int * 0.1::double as answer_bump from p""")
def d10(spark, d):
    text = F.col("text")
    return columns(spark, d, payoff_presence=E.payoff_presence(text, ("Therefore stop",)), resolution_bonus=E.resolution_bonus(text), answer_bump=E.answer_bump(text))


FEELINGS = ("happy", "sad", "love", "hate", "win", "won", "the", "better")


@query("d15_emotion_rate", rf"""with {CUED}, p as (select *, len({WS}) as n, {" + ".join(f"contains(t, '{w}')::int" for w in FEELINGS)} as k from x), r as (select episode_id, seg_idx, round((case when n = 0 then 0.0 else greatest(least(k / n::double * 20, 1.0), case when seg_idx % 2 = 1 and k >= 2 then 0.25 else 0.0 end) end)::double, 6) as raw from p),
    q as (select episode_id, quantile_cont(raw, 0.5) as mid, (quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)) / 1.349::double as sigma from r group by 1)
    select episode_id, seg_idx, raw, round(1 / (1 + exp(-1.5::double * (raw - mid) / case when sigma > 1e-6 then sigma else 1.0::double end)), 6) as emotion from r join q using (episode_id)""")
def d15(spark, d):
    loud = F.when(F.col("seg_idx") % 2 == 1, 0.7).otherwise(0.2)
    return E.calibrate_by_median(columns(spark, d, raw=E.emotion_rate(F.col("text"), FEELINGS, loud)), "episode_id", "raw", "emotion")


@query("d16_question_list_v2", rf"""with {CUED}, p as (select *, string_split_regex(trim(text), '[.!?]+\s+') as ss, len(regexp_extract_all(text, '\d+\.\s+[^.!?]+[.!?]?')) as k from x),
    q as (select *, ss[1] as f, ss[-1] as l, regexp_matches(ss[-1], '\?\s*$')::int as qm from p),
    r as (select *, 1 - (1 - (0.6 * qm + 0.4 * (regexp_matches(l, '(?i)\b(what|why|how|when|where|which|who)\b') or regexp_matches(f, '(?i)\b(what|why|how|when|where|which|who)\b'))::int)) * (1 - 0.3 * regexp_matches(text, '(?i)\b(vs\.?|versus|better than|worse than|compare(?:d)? to)\b')::int)
        * (1 - 0.25 * regexp_matches(text, '(?i)\b(which|pick|choose|would you rather|either|or)\b')::int) * (1 - 0.15 * regexp_matches(text, '(?i)\b(you know|right|isn''t it|don''t you think|agree)\b')::int) * (1 - 0.15 * qm * regexp_matches(l, '(?i)\b(what if|imagine|suppose|what would happen|what do you think)\b')::int)
        + 0.1 * regexp_matches(text, '(?i)\b(genuinely|honestly|really|truly|actually)\b')::int as qs, case when k = 0 then 0.0 when k between 3 and 7 then 1.0 when k < 3 then 0.3 + 0.7 * (k / 3::double) else greatest(0.3, 1 - 0.1 * (k - 7)) end + 0.02
        + 0.2 * regexp_matches(text, '(?i)\b(first|second|third|fourth|fifth|last|finally|next|then|also|additionally|moreover|furthermore)\b')::int as ls,
        least(0.25, 0.1 * len(regexp_extract_all(text, '(?i)\b(you won''t believe|shocking|amazing|incredible|unbelievable|mind-blowing)\b'))) + least(0.2, 0.05 * len(regexp_extract_all(text, '(?i)\b(what do you think|what''s your opinion|agree\?|right\?|you know\?)\b'))) as bad from q)
    select episode_id, seg_idx, round((case when text = '' then 0.0 when len(regexp_extract_all(text, '[A-Za-z0-9'']+')) < 6 then 0.35 else greatest(0.0, least(1.0, 1 - (1 - greatest(0.0, least(1.0, qs))) * (1 - greatest(0.0, least(1.0, ls))) - bad)) end)::double, 6) as question_list from r""")
def d16(spark, d):
    return columns(spark, d, question_list=E.question_list_v2(F.col("text"), "linkedin"))


@query("d19_confidence", rf"""with {CUED}, p as (select *, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(string_split_regex(s, '\s+')[2:], lambda w: regexp_matches(w, '^\p{{Lu}}\p{{Ll}}+'))) >= 2)) > 0 as burst,
        regexp_matches(plain, '(?i)(most (people|folks)|everyone|nobody).{{0,40}}\b(actually|but|instead)\b') as a, regexp_matches(plain, '(?i)\b\d+(?:\.\d+)?(?:%|k|m|b)?\b') as b, regexp_matches(plain, '(?i)\b(vs\.?|versus|more than|less than|bigger than|smaller than)\b') as c from (select * replace (trim(text) as text), regexp_replace(trim(text), '[^\x00-\x7F]', '_', 'g') as plain from x)),
    q as (select *, greatest(0.5, least(0.9, 0.6 + a::int * 0.1 + b::int * 0.1 + c::int * 0.05 + regexp_matches(plain, '(?i)\b(because|therefore|so|which means)\b')::int * 0.05 + regexp_matches(plain, '(?i)\b(try|avoid|do|don''?t|stop|start|focus|use|measure|swap|choose|should|need|must)\b')::int * 0.1
        - regexp_matches(plain, '(?i)\b(maybe|probably|i think|i guess|kinda|sort of)\b')::int * 0.1 + burst::int * 0.05))::double as conf from p)
    select episode_id, seg_idx, a or b or c as has_evidence, round(conf, 6) as confidence, round(least(1.0::double, 0.6::double * (0.9::double + 0.3::double * (conf - 0.5::double) / 0.4::double)), 6) as insight from q""")
def d19(spark, d):
    hard, sure = E.evidence_confidence(F.col("text"))
    return columns(spark, d, has_evidence=hard, confidence=sure, insight=E.insight_by_confidence(F.lit(0.6), sure))


FAMILIES = [("curiosity", r"\b(what if|did you know|why)\b", 0.20), ("contrarian", r"\b(most people|nobody|actually)\b", 0.15), ("authority", r"\bi built\b", 0.10)]
TOKS = r"regexp_extract_all(t, '[a-z0-9%$''()*+,\-.]+')[1:40]"
FILL, STRONG = "('uh', 'um', 'er', 'ah', 'like', 'you', 'know', 'so', 'well', 'okay', 'ok')", "('what', 'why', 'how', 'here''s', 'listen', 'the', 'truth', 'nobody', 'you', 'let', 'here', 'this', 'stop', 'remember')"
KINDS = (
    r"\b\d+(?:\.\d+)?(?:%|k|m|b|\$)?\b", r"\b(?:vs\.?|versus|more than|less than|bigger than|smaller than|better than|worse than)\b",
    r"\b(?:but actually|however|on the contrary|surprisingly|unexpectedly|turns out)\b", r"\b(?:because|therefore|so|which means|as a result|consequently)\b",
    r"\b(?:must|should|need to|have to|don''t|stop|start|always|never)\b", r"\b(?:specifically|exactly|precisely|particularly)\b",
    r"\b(first|second|third|then|next|finally|additionally)\b", r"\b(means|defined as|refers to|is when|called)\b",
)


@query("d04_hook_enhanced", rf"""with {CUED}, p as (select *, {TOKS} as k, {" + ".join(f"regexp_matches(text, '(?i){p}')::int" for p in KINDS)} as kinds from x),
    w as (select episode_id, seg_idx, i - 1 as j, k[i] as w, array_to_string(k[greatest(i - 2, 1):i + 2], ' ') as five, concat_ws(' ', k[i], k[i + 1]) as two from (select *, unnest(range(1, len(k) + 1)) as i from p)),
    s as (select episode_id, seg_idx, {", ".join(f"sum(case when regexp_matches(five, '{r}') then 0.25::double * exp(-j / 5.0::double) else 0 end) as f{n}" for n, (_, r, _) in enumerate(FAMILIES))},
        min(case when j <= 6 and (w in {STRONG} or contains(two, 'truth') or contains(two, 'need') or contains(two, 'nobody')) then j end) as peak, bool_or(j < 3 and w in {FILL}) as hedge, bool_or(j between 3 and 7 and ((length(w) > 2 and w not in {FILL}) or w in {STRONG})) as follow from w group by 1, 2),
    b as (select p.*, hedge, follow, {" + ".join(f"coalesce({w}::double * f{n} / (1 + 0.6::double * f{n}), 0)" for n, (_, _, w) in enumerate(FAMILIES))} + least(0.015::double, 0.008::double * coalesce(peak, 0)) as v from p left join s using (episode_id, seg_idx)),
    c as (select *, case when hedge then greatest(0, v - case when follow then 0.015::double else 0.03::double end) else v end - regexp_matches(left(string_split_regex(text, '[.!?]\s+')[1], 180), '(?i)\b(hey|hi|hello|welcome|thanks for|what''s up|good (morning|afternoon|evening))\b')::int * 0.05::double as u from b)
    select episode_id, seg_idx, round(case when length(trim(text)) < 8 then 0 else greatest(0, least(1, case when kinds >= 2 or regexp_matches(array_to_string(k[1:12], ' '), '\b(how|why|what)\b|\b\d+(?:\.\d+)?%?\b|\b(?:vs\.?|versus|more than|less than)\b') then u else least(u, 0.2::double) end)) end, 6)::double as hook_v5 from c""")
def d04(spark, d):
    return columns(spark, d, hook_v5=E.hook_v5_enhanced(F.col("text"), FAMILIES))


def each(weight: str, most: str, *patterns: str) -> str:
    return f"least({most}, {weight} * ({' + '.join(f'''regexp_matches(t, '{p}')::int''' for p in patterns)}))::double"


@query("d27_genre_patterns", rf"""with {CUED} select episode_id, seg_idx,
    round({each("0.1", "1.0", "mystery", "case", "investigation", "evidence", "clue", "witness", "suspect", "victim", "crime scene")}, 6) as true_crime_mystery_score,
    round({each("0.15", "1.0", "turns out", "the truth", "discovered", "revealed", "finally", "at last", "the answer")}, 6) as true_crime_resolution_score,
    round({each("0.1", "0.5", "the shocking truth", "what they didn''t tell you", "the real story", "behind the scenes", "the untold story")}, 6) as true_crime_viral_trigger_boost,
    round({each("0.2", "1.0", "i built", "i founded", "i sold", "i invested", "my company", "my startup", "my experience")}, 6) as business_authority_score,
    round({each("0.15", "1.0", r"\$\d+", r"\d+%", r"\d+ years", r"\d+ months", "revenue", "profit", "customers", "employees")}, 6) as business_specificity_score,
    round({each("0.25", "1.0", "did you know", "surprisingly", "contrary to", "most people think", "the truth is")}, 6) as educational_curiosity_score,
    round({each("0.2", "1.0", "here''s why", "the reason is", "this means", "in other words", "simply put")}, 6) as educational_clarity_score,
    round({each("0.15", "1.0", "doctor", "physician", "therapist", "nutritionist", "trainer", "expert", "specialist", "certified", "licensed")}, 6) as health_credibility_score,
    round({each("0.1", "1.0", "transform", "change", "improve", "boost", "enhance", "better", "stronger", "healthier", "happier")}, 6) as health_transformation_score,
    round({each("0.1", "0.5", "doctors don''t want you to know", "the secret to", "transform your", "natural remedy", "proven method")}, 6) as health_viral_trigger_boost,
    round({each("0.2", "1.0", "breaking", "just in", "developing", "urgent", "immediate", "right now", "this moment", "critical")}, 6) as news_urgency_score,
    round({each("0.15", "1.0", "controversial", "scandal", "outrage", "fury", "anger", "protest", "backlash", "criticism")}, 6) as news_controversy_score,
    round({each("0.1", "0.5", "breaking:", "the real reason", "what nobody''s saying", "the truth about", "behind the headlines")}, 6) as news_viral_trigger_boost,
    regexp_matches(t, 'case|investigation|evidence|witness') as true_crime_has_case_details, regexp_matches(t, 'in \d{{4}}|when|then|after|before') as true_crime_has_timeline, regexp_matches(t, 'turns out|the truth|discovered|revealed') as true_crime_has_resolution,
    regexp_matches(t, 'doctor|physician|therapist|nutritionist|trainer') as health_has_credentials, regexp_matches(t, 'benefits|improve|boost|enhance|better') as health_has_benefits, regexp_matches(t, 'here''s how|try this|start with|focus on') as health_has_actionable,
    regexp_matches(t, 'breaking|just in|developing') as news_has_breaking, regexp_matches(t, 'today|yesterday|this week|recently') as news_has_timeline, regexp_matches(t, 'according to|reports|sources say|official') as news_has_sources from x""")
def d27(spark, d):
    found = E.genre_patterns(F.col("text"))
    return cued(spark, d).select(*KEYS, *((c if "_has_" in n else F.round(c, 6)).alias(n) for n, c in found.items()))


@query("d32_semantic_end", rf"""with {CUED}, y as (select *, right(text, 120) as tail from x) select episode_id, seg_idx, round((regexp_matches(lower(tail), 'that''s why|so that''s|and that''s|which means|this shows|proves that|the point is|bottom line|in the end|finally|as a result|so in short|long story short')::int * 0.25
    + regexp_matches(trim(tail), '[.!?]$')::int * 0.12 - regexp_matches(tail, '\b([A-Z][a-z]+|[0-9]+)$')::int * 0.15)::double, 6) as end_bonus, regexp_matches(lower(tail), 'but|however|here''s why|the catch|what you don''t|what no one|\?|…') as curious from y""")
def d32(spark, d):
    tail = F.right(F.col("text"), F.lit(120))
    return columns(spark, d, end_bonus=E.semantic_end_bonus(tail), curious=E.ends_curious(tail))


@query("d32_quiet_start", f"""with {S.SEGMENTS}, c as (select episode_id, seg_idx::varchar as clip_id, start_ms - (seg_idx % 3) * 500 as s, end_ms as e from segments), h as (select *, least(s + 1000, e) as e1 from c),
    v as (select h.episode_id, clip_id, sum(least(g.end_ms, e1) - greatest(g.start_ms, s)) as covered from h join segments g on g.episode_id = h.episode_id and g.start_ms < e1 and g.end_ms > s group by 1, 2)
    select h.episode_id, h.clip_id, e1 - s <= 50 or (e1 - s) - coalesce(covered, 0) >= 600 as quiet from h left join v on v.episode_id = h.episode_id and v.clip_id = h.clip_id""")
def d32q(spark, d):
    s = segments(spark, d)
    moved = s.select("episode_id", F.col("seg_idx").cast("string").alias("clip_id"), (F.col("start_ms") - (F.col("seg_idx") % 3) * 500).alias("start_ms"), "end_ms")
    return E.quiet_start(moved, s)


@query("g07_diversify_titles")
def g07(spark, d):
    titles = cued(spark, d).select("episode_id", F.col("seg_idx").cast("string").alias("clip_id"), F.substring_index("text", " ", 8).alias("title"), "text", "start_ms", "end_ms")
    return E.diversify_titles(titles.withColumn("final_score", F.round(features.prerank_score(F.col("text"), features.seconds()), 6)))
