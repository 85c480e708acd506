"""Queries over windows by hotness, marks and cues. Their SQL states every rule again and shares no value with the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import windows
from cliploom.plans import sql as S
from cliploom.plans.queries import MARKS, clips, marks, query, segments, words


def present(phrases: str, weight: str) -> str:
    return "(" + " + ".join(f"contains(low, '{p.strip()}')::int" for p in phrases.replace("'", "''").split(",")) + f") * {weight}::double"


def times(phrases: str, weight: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(low, '{p.strip()}'))" for p in phrases.split(",")) + f") * {weight}::double"


LITE = rf"""ends as (select episode_id, max(end_ms) // 500 as last from words group by 1), grid as (select episode_id, last, unnest(range(last + 1)) as hop from ends),
texts as (select g.episode_id, g.hop, coalesce(string_agg(w.w, ' ' order by w.word_idx), '') as txt, lower(coalesce(string_agg(w.w, ' ' order by w.word_idx), '')) as low
    from grid g left join words w on w.episode_id = g.episode_id and w.start_ms >= g.hop * 500 - 2000 and w.start_ms <= g.hop * 500 + 2000 group by 1, 2),
cut as (select *, list_filter(string_split_regex(low, '\s+'), lambda p: p <> '') as parts from texts),
lite as (select episode_id, hop,
    least(1.0::double, {times("what,why,how,when,where,who,which", "0.1")} + {present("but,however,here's why,the catch,what you don't,what no one", "0.2")} + len(regexp_extract_all(txt, '[?]')) * 0.15::double) as hook,
    least(1.0::double, len(regexp_extract_all(txt, '!')) * 0.2::double + {present("amazing,incredible,shocking,surprising,unbelievable,stunning", "0.15")} + len(regexp_extract_all(txt, '\p{{Lu}}')) / greatest(length(txt), 1)::double * 0.1::double) as arousal,
    least(1.0::double, {present("insight,secret,tip,trick,strategy,method,way,solution", "0.1")} + {present("learn,discover,find,get,achieve,create,build,make", "0.08")} + len(regexp_extract_all(txt, '[0-9]+')) * 0.05::double) as payoff,
    case when len(parts) > 0 then least(1.0::double, len(parts) / 20.0::double * (list_sum(list_transform(parts, lambda p: length(p)))::double / len(parts) / 5.0::double)) else 0.0::double end as info,
    least(1.0::double, contains(txt, '?')::int * 0.3::double + regexp_matches(txt, '[0-9]+\.|[•·-]')::int * 0.2::double + {present("first,second,third,next,then,finally,also,additionally", "0.1")}) as q_or_list,
    least(1.0::double, {present("love,amazing,great,awesome,fantastic,wonderful,excellent", "0.1")} + {present("hate,terrible,awful,horrible,disgusting,annoying,frustrating", "0.1")}) as emotion,
    least(1.0::double, (len(parts) > 3 and len(list_filter(range(1, len(parts) - 1), lambda i: length(low) - length(replace(low, array_to_string(parts[i:i + 2], ' '), '')) > length(array_to_string(parts[i:i + 2], ' ')))) > 0)::int * 0.2::double
        + {present("you know,i mean,basically,literally,obviously", "0.1")}) as loop
    from cut)"""

CURVE = f"""{LITE}, raw as (select episode_id, hop, last, round((hook * 0.26::double + arousal * 0.2::double + payoff * 0.18::double + info * 0.11::double + q_or_list * 0.09::double + emotion * 0.06::double + loop * 0.05::double) * 1000000000::double)::bigint as r from lite join ends using (episode_id)),
curve as (select episode_id, hop, last, (case when last * 500 < 600000 then sum(r) over a // count(*) over a else sum(r) over b // count(*) over b end)::bigint as hot from raw
    window a as (partition by episode_id order by hop rows between 4 preceding and 4 following), b as (partition by episode_id order by hop rows between 3 preceding and 3 following))"""

PEAKS = f"""{CURVE}, sides as (select *, lag(hot) over (partition by episode_id order by hop) as before, lead(hot) over (partition by episode_id order by hop) as after from curve),
pool as (select episode_id, hop, hot::double as hot, last, case when last * 500 < 600000 then 8 else 12 end as apart from sides where hot > before and hot > after),
{S.greedy("hot desc, hop", "abs(k.hop - o.hop) < o.apart", "hop, hot, last", 60)},
tops as (select episode_id, k.hop as hop, k.hot::bigint as hot, pick from picked where pick <= least(greatest(floor(k.last * 500 * 1.5 / 60000.0), 20), 60))"""


def snap(centres: str) -> str:
    """CTEs that end in `snapped` (episode_id, centre_ms, size_ms, start_ms, end_ms, quality)."""
    return f"""silences as (select *, start_ms - lag(end_ms) over (partition by episode_id order by word_idx) as silent, lead(start_ms) over (partition by episode_id order by word_idx) - end_ms as quiet from words),
    aim as (select distinct episode_id, centre_ms, size_ms, centre_ms - size_ms // 2 as f, centre_ms - size_ms // 2 + size_ms as t from {centres}),
    four as (select a.*, (select min(t_ms) from marks m where m.episode_id = a.episode_id and t_ms between f - 3000 and f - 1) as s1,
        (select min(start_ms) from silences m where m.episode_id = a.episode_id and silent > 350 and start_ms between f - 3000 and f + 3000) as s2,
        (select min(t_ms) from marks m where m.episode_id = a.episode_id and t_ms between t and t + 3000) as e1,
        (select min(end_ms) from silences m where m.episode_id = a.episode_id and quiet > 350 and end_ms between t - 3000 and t + 3000) as e2,
        a.episode_id in (select episode_id from marks) and a.episode_id in (select episode_id from words) as live from aim a),
    snapped as (select episode_id, centre_ms, size_ms, case when live then coalesce(s1, s2, f) else f end as start_ms, case when live then coalesce(e1, e2, t) else t end as end_ms,
        case when live then round(((case when s1 is not null then 1.0 when s2 is not null then 0.8 else 0 end)::double + (case when e1 is not null then 1.0 when e2 is not null then 0.8 else 0 end)::double) / 2
            - (case when coalesce(s1, s2) is null then 0.01 else 0 end)::double - (case when coalesce(e1, e2) is null then 0.02 else 0 end)::double, 4) else 0.0::double end as quality from four)"""


@query("c24_lite_scores", f"with {S.WORDS}, {LITE} select episode_id, hop, {', '.join(f'round({c}, 6) as {c}' for c in ('hook', 'arousal', 'payoff', 'info', 'q_or_list', 'emotion', 'loop'))} from lite")
def c24_lite(spark, d):
    rows = windows.lite_scores(words(spark, d))
    return rows.select("episode_id", "hop", *(F.round(c, 6).alias(c) for c in windows.SHARES))


@query("c25_hotness", f"with {S.WORDS}, {CURVE} select episode_id, hop, hot from curve")
def c25(spark, d):
    return windows.hotness_curve(windows.lite_scores(words(spark, d))).select("episode_id", "hop", "hot")


@query("c26_peaks", f"with recursive {S.WORDS}, {PEAKS} select episode_id, hop, hot, pick from tops")
def c26(spark, d):
    return windows.hot_peaks(windows.hotness_curve(windows.lite_scores(words(spark, d))))


CENTRES = "centres as (select episode_id, (start_ms + end_ms)::bigint // 2 as centre_ms, unnest([8000, 10000, 23000])::bigint as size_ms from segments)"


@query("c27_snap_to_marks", f"with {S.WORDS}, {MARKS}, {CENTRES}, {snap('centres')} select * from snapped")
def c27(spark, d):
    sizes = F.explode(F.array(*(F.lit(x).cast("long") for x in (8_000, 10_000, 23_000))))
    centres = segments(spark, d).select("episode_id", F.expr("(start_ms + end_ms) div 2").alias("centre_ms"), sizes.alias("size_ms")).distinct()
    return windows.snap_to_marks(centres, marks(spark, d), words(spark, d))


@query("c29_discover", f"""with recursive {S.WORDS}, {MARKS}, {PEAKS.replace("pool as", "tips as").replace("from pool", "from tips").replace("ordered", "ordered_tips").replace("folded", "folded_tips").replace("best as", "best_tips as").replace("from best", "from best_tips").replace("picked", "picked_tips")},
    centres as (select episode_id, hop as peak, hop * 500 as centre_ms, unnest([12000, 18000, 23000, 30000, 35000, 45000, 60000, 75000, 90000])::bigint as size_ms from tops), {snap("centres")},
    spans as (select c.episode_id, c.peak, greatest(s.start_ms, 0) as start_ms, s.end_ms, max(s.quality) as quality from centres c join snapped s using (episode_id, centre_ms, size_ms) where s.end_ms - greatest(s.start_ms, 0) between 7000 and 120000 group by 1, 2, 3, 4),
    warm as (select p.episode_id, p.peak, p.start_ms, p.end_ms, max(p.quality) as quality, (sum(c.hot) // count(*))::bigint as heat from (select *, row_number() over () as id from spans) p
        join curve c on c.episode_id = p.episode_id and c.hop * 500 >= p.start_ms and c.hop * 500 < p.end_ms group by p.id, 1, 2, 3, 4),
    two as (select episode_id, start_ms, end_ms, heat, quality from warm qualify row_number() over (partition by episode_id, peak order by heat desc, quality desc, start_ms, end_ms) <= 2),
    pool as (select episode_id, start_ms, end_ms, max(heat)::double as hot, max(quality) as final_score from two where heat > 20000000 group by 1, 2, 3),
    {S.greedy("hot desc, final_score desc, start_ms, end_ms", f"{S.iou()} >= 0.6", "start_ms, end_ms, hot, final_score", 40)}
    select episode_id, k.start_ms as start_ms, k.end_ms as end_ms, k.hot / 1000000000::double as heat, k.final_score as quality, pick as rank from picked join ends using (episode_id)
    where pick <= least(greatest((select max(end_ms) // 60000 from words w where w.episode_id = picked.episode_id), 20), 40)""")
def c29(spark, d):
    """The least heat is low, as the tables' texts hold few of the English cues."""
    return windows.discover_windows(words(spark, d), marks(spark, d), least_heat=0.02)


def near(at: str, far: str, value: str, otherwise: str, cand: str, out: str) -> str:
    """CTEs for one side: each place with its word, silence, stop, text and score; ends in `out` (episode_id, clip_id, t)."""
    return f"""{out}_a as (select c.*, coalesce(w.word_idx, -1) as i, case when w.word_idx is null then (select min(start_ms) from words x where x.episode_id = c.episode_id) else greatest(coalesce(w.nxt - w.end_ms, 0), 0) end as gap from {cand} c asof left join timed w on w.episode_id = c.episode_id and c.t >= w.start_ms),
    {out}_b as (select a.episode_id, a.clip_id, a.origin, a.t, a.lo, any_value(a.gap) as gap, coalesce(bool_or(w.word_idx between a.i - 2 and a.i + 2 and regexp_matches(w.w, '[.!?…]$') and abs(w.end_ms - a.t) <= 250), false)::int as stop, {far}
        from {out}_a a left join timed w on w.episode_id = a.episode_id and w.start_ms between a.t - 60000 and a.t + 60000 group by 1, 2, 3, 4, 5),
    {out} as (select episode_id, clip_id, arg_max(t, {value} * 1000000 - t) as t from (select *, {at} from {out}_b) group by 1, 2)"""


def joined(lo: str, hi: str) -> str:
    return f"coalesce(string_agg(w.w, ' ' order by w.word_idx) filter (coalesce(w.nxt, 9000000000) > {lo} and w.start_ms <= {hi}), '')"


def cue(text: str, phrases: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{p.strip()}')" for p in phrases.replace("'", "''").split("|")) + ")::int"


@query("c30_refine_bounds", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, timed as (select *, lead(start_ms) over (partition by episode_id order by word_idx) as nxt from words),
    long as (select episode_id, clip_id, start_ms, end_ms from clips where end_ms - start_ms >= 8000),
    from_ as (select episode_id, clip_id, start_ms as origin, 0 as lo, unnest(range(greatest(start_ms - 1000, 0), least(end_ms - 8000, start_ms + 1000) + 1, 50)) as t from long),
    {near("1 as one", joined("a.t", "a.t + 2000") + " as two, " + joined("a.t", "a.t + 8000") + " as eight", f"(500 * least(gap, 220) + 55000 * stop + 8250 * {cue('lower(two[:120])', chr(124).join(['why', 'how', 'stop', 'the secret', 'here' + chr(39) + 's', 'watch', 'don' + chr(39) + 't', 'never']))} + 6600 * {cue('lower(eight[:200])', 'ever watched|webinar|video that|ramble on|go into circles')} - 77 * abs(t - origin))", "", "from_", "s")},
    to_ as (select l.episode_id, l.clip_id, end_ms as origin, s.t as lo, unnest(range(greatest(s.t + 8000, end_ms - 1000), least(s.t + 90000, end_ms + 1000) + 1, 50)) as t from long l join s using (episode_id, clip_id)),
    {near("lower(right(four, 120)) as tail", joined("greatest(a.lo, a.t - 4000)", "a.t") + " as four, " + joined("greatest(a.lo, a.t - 1400)", "a.t") + " as last", f"(550 * least(gap, 220) + 77000 * stop + 13750 * {cue('tail', 'but|however|here' + chr(39) + 's why|the catch|what you don' + chr(39) + 't|what no one|?|…')} + 55000 * {cue('lower(last)', 'that' + chr(39) + 's why|so that' + chr(39) + 's|and that' + chr(39) + 's|which means|this shows|proves that|the point is|bottom line|in the end|finally|as a result|so in short|long story short')} + 26400 * regexp_matches(last, '[.!?]$')::int - 33000 * regexp_matches(last, '(^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]+|[0-9]+)$')::int - 77 * abs(t - origin))", "", "to_", "e")},
    best as (select l.episode_id, l.clip_id, s.t as a, coalesce(e.t, l.end_ms) as b from long l join s using (episode_id, clip_id) left join e using (episode_id, clip_id)),
    moved as (select episode_id, clip_id, greatest(least(a, b - 8000), 0) as f, least(a + 90000, greatest(b, greatest(least(a, b - 8000), 0) + 8000)) as t from best)
    select episode_id, clip_id, coalesce((f + 5) // 10 * 10, start_ms)::bigint as start_ms, coalesce((t + 5) // 10 * 10, end_ms)::bigint as end_ms from clips left join moved using (episode_id, clip_id)""")
def c30(spark, d):
    return windows.refine_by_cues(clips(spark, d).select("episode_id", "clip_id", "start_ms", "end_ms"), words(spark, d))
