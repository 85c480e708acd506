"""Queries of rules with scope: emotion under negation, n-gram tables.

As in cued.py, cue sentences stand before every segment, and the SQL spells each rule out again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import emotion, evidence, sequence, stats
from cliploom.plans import sql as S
from cliploom.plans.queries import docs, query, segments, words

CUES = (
    "I am not happy and never was sad. ", "WOW!! This is unbelievable... I'm proud of it. ", "I felt ashamed; it hurts. But relief came, and love! ",
    "Nobody can't want this. They don't ever panic or crave. No horror, no grief. ", "Unhappy crusaders enraged by grosser OK NASA news. ", "It is great. It was a nightmare of pain. ",
    "Mind-blown, jaw dropped, itching to win 🤯🔥😂 I was terrified. ", "ok", "Not a single very awesome day. ", "",
)
CUED = f"""{S.SEGMENTS}, cue as (select unnest([{", ".join(f"'{S.quoted(c)}'" for c in CUES)}]) as cue, unnest(range({len(CUES)})) as no),
x as (select episode_id, seg_idx, cue || text as text from segments join cue on no = (episode_id + seg_idx) % {len(CUES)})"""


def cued(spark, d):
    at = ((F.col("episode_id") + F.col("seg_idx")) % len(CUES)).cast("int")
    return segments(spark, d).select("episode_id", "seg_idx", F.concat(F.get(F.array(*map(F.lit, CUES)), at), "text").alias("text"))


def pieces(words: str) -> str:
    return f"string_split(regexp_replace(text, '({words})', chr(1) || '\\1', 'gi'), chr(1))"


def hits(name: str) -> str:
    before = f"len(regexp_extract_all(lower(array_to_string({name}[1:k - 1], '')), '[a-z'']+'))"
    negated = f"list_has_any(toks[greatest({before} - 2, 1):{before}], ['not', 'no', 'never', 'isnt', 'isn''t', 'dont', 'don''t', 'cannot', 'can''t', 'wont', 'won''t'])"
    return f"coalesce(list_sum(list_transform(range(2, len({name}) + 1), lambda k: case when {negated} then -1 else 1 end)), 0)::int as emotion_{name}"


#: The families once more, spelled out for the SQL.
PIECES = {
    "anger": pieces("angry|furious|mad|irritated|irritating|rage|pissed|enraged|enrage"),
    "fear": pieces("afraid|terrified|terrifying|scared|anxious|panic|frightened|frighten|horror|nightmare"),
    "sad": pieces("sad|devastated|devastating|heartbroken|heartbreaking|depressed|depressing|mourning|grief"),
    "joy": pieces("happy|thrilled|excited|exciting|joy|delighted|delight|proud|relief|relieved|love|beautiful|hilarious"),
    "surprise": pieces(r"shocked|shocking|jaw[-\s]?dropped|stunned|unbelievable|insane|crazy|wow|mind[-\s]?blown|🤯"),
    "disgust": pieces("disgusted|disgusting|gross|nauseated|nauseating|repulsed|repulse"),
    "desire": pieces("want|crave|obsessed|hungry for|itching to|itch to|ambitious|driven|aspire"),
    "shame": pieces("ashamed|embarrassed|embarrassing|humiliated|humiliating|guilty|regret"),
    "awe": pieces("awesome|awe|majestic|breathtaking|staggering|incredible|amazing|unbelievable|mind-blowing"),
}
POLARITY = "tanh(0.6::double * (len(regexp_extract_all({0}, '(?i)\\b(great|love|happy|proud|amazing|wow|relief)\\b')) - len(regexp_extract_all({0}, '(?i)\\b(hate|scared|sad|angry|annoying|nightmare|pain)\\b'))))"
EMOTION = rf"""with {CUED}, p as (
    select *, regexp_extract_all(lower(text), '[a-z'']+') as toks, string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ss, {", ".join(f"{sql} as {name}" for name, sql in PIECES.items())} from x
), h as (
    select episode_id, seg_idx, text, {", ".join(hits(name) for name in PIECES)}, {" + ".join(f"len({name}) - 1" for name in PIECES)} as n,
        least(0.14, 0.4 * regexp_matches(text, '!!')::int + 0.1 * regexp_matches(text, '\.\.\.')::int + 0.25 * least(3, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))) / 3::double
            + 0.15 * least(1.0, len(regexp_extract_all(text, '[😂🤣😭😡😱😍❤💔🤯✨🔥]')) / 3::double))::double as emotion_intensity,
        case when len(ss) < 2 then 0.0::double else least(1.0, abs({POLARITY.format("ss[-1]")} - {POLARITY.format("ss[1]")}))::double end as emotion_arc,
        regexp_matches(text, '(?i)\b(i felt|made me (feel|cry|smile)|it hurts|i''m proud|i am proud|i''m terrified|i was terrified)\b')::int as emotion_empathy
    from p
), v as (
    select *, greatest(0, emotion_joy + emotion_awe + emotion_desire) as pos, greatest(0, emotion_anger + emotion_fear + emotion_sad + emotion_disgust + emotion_shame) as neg from h
), r as (
    select * exclude (text, n, pos, neg), case when length(trim(text)) < 3 then 0.0::double else 1 - (1 - 0.45 * tanh(0.35::double * n)) * (1 - greatest(0.0, 0.2 * (tanh(0.6::double * (pos - neg) / greatest(1, pos + neg)) + 0.54) / 1.08))
        * (1 - 0.15 * emotion_intensity) * (1 - 0.12 * emotion_arc) * (1 - 0.08 * emotion_empathy) end as emotion_raw from v
)"""


@query("d15_emotion_v2", EMOTION + """ select * replace (round(emotion_intensity, 6) as emotion_intensity, round(emotion_arc, 6) as emotion_arc, round(emotion_raw, 6) as emotion_raw) from r""")
def d15(spark, d):
    rows = emotion.emotion_columns(cued(spark, d)).drop("text")
    return rows.withColumns({c: F.round(c, 6) for c in ("emotion_intensity", "emotion_arc", "emotion_raw")})


@query("d15_emotion_calibrated", EMOTION + """, s as (select episode_id, seg_idx, round(emotion_raw, 6) as raw from r),
    q as (select episode_id, quantile_cont(raw, 0.5) as mid, (quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)) / 1.349::double as sigma from s group by 1)
    select episode_id, seg_idx, raw, round(1 / (1 + exp(-1.5::double * (raw - mid) / case when sigma > 1e-6 then sigma else 1.0::double end)), 6) as emotion from s join q using (episode_id)""")
def d15_calibrated(spark, d):
    rows = emotion.emotion_columns(cued(spark, d)).select("episode_id", "seg_idx", F.round("emotion_raw", 6).alias("raw"))
    return evidence.calibrate_by_median(rows, "episode_id", "raw", "emotion")


GRAMS = r"""w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}0-9'']+') as ws from documents), g as (
    select n, unnest(list_filter(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1]), lambda r: not list_contains(['the', 'of', 'and', 'de', 'der'], r[1]) and not list_contains(['the', 'of', 'and', 'de', 'der'], r[-1]))) as r
    from w, (select unnest([1, 2, 3]) as n) where len(ws) >= n)"""


@query("f11_ngram_table", f"with {GRAMS} select n, array_to_string(r, ' ') as ngram, count(*) as count from g group by 1, 2 having count(*) >= 4")
def f11_table(spark, d):
    return stats.ngram_table(docs(spark, d), (1, 2, 3), stop=("the", "of", "and", "de", "der"), least=4)


@query("f11_anchor_phrases", r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}]+') as ws from documents),
    a as (select doc_id, ws, i, case when lower(ws[i]) = 'license' then 'License' else 'Source' end as anchor, ws[greatest(i - 6, 1):i - 1] as before from w, unnest(range(1, len(ws) + 1)) as u(i) where lower(ws[i]) in ('license', 'source', 'sources')),
    p as (select doc_id, anchor, list_filter(before, lambda t: regexp_matches(t, '^\p{Lu}') and lower(t) not in ('the', 'this'))[-1] as noun from a),
    s as (select doc_id, case when noun is null then anchor else noun || ' ' || anchor end as phrase, case when noun is null then 2 else 4 end as points from p)
    select doc_id, phrase, sum(points)::bigint as points from s group by 1, 2""")
def f11_anchors(spark, d):
    return stats.anchor_phrases(docs(spark, d), "doc_id", {"license": "License", "source": "Source", "sources": "Source"}, stop=("the", "this"))


def word_marks(name: str, words: str, key: str) -> str:
    """CTEs that end in `name` (episode_id, t_ms): marks from words by punctuation, long gaps and closers, in groups of `key`."""
    return f"""{name}_g as (select *, lead(start_ms) over (partition by {key} order by word_idx) - end_ms as gap from {words}),
    {name}_s as (select {key}, quantile_cont(gap, 0.5) as mid, stddev_samp(gap) as dev from {name}_g where gap > 0 group by {key}),
    {name}_n as (select {key}, quantile_cont(gap, 0.5) as near from {name}_g join {name}_s using ({key}) where gap > 0 and abs(gap - mid) <= dev group by {key}),
    {name}_l as (select {key}, greatest(280.0, mid + coalesce(near, mid)) as lim from {name}_s left join {name}_n using ({key})),
    {name} as (select distinct episode_id, end_ms as t_ms from {name}_g left join {name}_l using ({key}) where gap is not null and (regexp_matches(w, '[.!?…]$') or gap >= coalesce(lim, 280.0) or lower(w) in ('right?', 'you know?')))"""


@query("c10_eos_waterfall", rf"""with recursive {S.WORDS}, spoken as (select episode_id, count(*) as n from words group by 1), own as (select * from words where episode_id in (select episode_id from spoken where n >= 100)),
    {word_marks("a", "own", "episode_id")},
    b_g as (select *, lead(w) over (partition by episode_id order by word_idx) as nw, lead(start_ms) over (partition by episode_id order by word_idx) - end_ms as gap from own),
    b as (select episode_id, end_ms as t_ms from b_g where (regexp_matches(w, '[.!?]$') and (nw is null or regexp_matches(nw, '^\p{{Lu}}'))) or (regexp_matches(w, '[,;:]$') and gap > 500)),
    ab as (select distinct * from (from a union all from b)),
    thin as (select episode_id, min(t_ms) as t_ms from ab group by 1 union all
        select k.episode_id, (select min(m.t_ms) from ab m where m.episode_id = k.episode_id and m.t_ms > k.t_ms + 250) from thin k where k.t_ms is not null),
    snapped as (select distinct t.episode_id, coalesce(arg_min(b.t_ms, abs(b.t_ms - t.t_ms) * 2 + (b.t_ms > t.t_ms)::int), t.t_ms) as t_ms
        from thin t left join b on b.episode_id = t.episode_id and abs(b.t_ms - t.t_ms) <= 250 where t.t_ms is not null group by t.episode_id, t.t_ms),
    said as (select w.* from words w join segments s using (episode_id, seg_idx) where s.speaker = 'assistant'),
    {word_marks("c", "said", "episode_id, seg_idx")},
    chars as (select episode_id, start_ms, end_ms, length(text) as n, unnest(range(length(text))) as pos, unnest(string_split(text, '')) as ch from segments where trim(text) <> ''),
    d as (select distinct episode_id, (start_ms + floor((end_ms - start_ms) * pos / greatest(n, 1)::double))::bigint as t_ms from chars where ch in ('.', '!', '?') union select episode_id, end_ms from segments where end_ms > 0 and trim(text) <> ''),
    every as (select *, 1 as rank, 'episode+enhanced' as source from snapped union all select *, 2, 'segment' from c union all select *, 3, 'fallback' from d union all select distinct episode_id, end_ms, 4, 'segment_boundary' from segments where end_ms > 0),
    best as (select episode_id, t_ms, source from (select *, min(rank) over (partition by episode_id) as best from every) where rank = best),
    sparse as (select e.episode_id from (select distinct episode_id from segments) e left join (select episode_id, count(*) as m from best group by 1) m using (episode_id) left join spoken using (episode_id)
        where coalesce(m, 0) < 10 or (coalesce(n, 0) > 0 and coalesce(m, 0) < 0.015 * n)),
    breaks as (select *, lead(start_ms) over (partition by episode_id order by seg_idx) - end_ms as gap, coalesce(sum(n_words) over (partition by episode_id order by seg_idx rows between 1 following and unbounded following), 0) as after from segments),
    filled as (select distinct episode_id from breaks join sparse using (episode_id) where gap >= 300)
    select distinct episode_id, t_ms::bigint as t_ms, source from (
        select episode_id, t_ms, case when f.episode_id is not null then 'gap_fallback' else source end as source from best left join filled f using (episode_id)
        union all select episode_id, end_ms, 'gap_fallback' from breaks join sparse using (episode_id) where gap >= 300 and after >= 8)""")
def c10_waterfall(spark, d):
    """Word times of whole episodes where they are many, else those of the assistant's turns, else the text."""
    all_, said = segments(spark, d), segments(spark, d).where("speaker = 'assistant'").select("episode_id", "seg_idx")
    return sequence.eos_waterfall(all_, words(spark, d), words(spark, d).join(said, ["episode_id", "seg_idx"], "left_semi"))
