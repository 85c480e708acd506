"""SQL for queries whose rules are sequential: merged seeds, unified marks, rescues, accepted updates, stratified picks."""

from __future__ import annotations

from cliploom.plans import sql as S
from cliploom.plans.queries import ORACLES
from cliploom.plans.scoped import word_marks

ORACLES["h03_dedup_iou"] = f"""with recursive {S.CLIPS}, pool as (select * from clips),
    {S.greedy("final_score desc, (not finished)::int, abs(end_ms - start_ms - 18000), clip_id", f"{S.iou()} >= 0.85", "clip_id, start_ms, end_ms, final_score")}
    select episode_id, k.clip_id as clip_id from picked"""

ORACLES["c15_merge_seeds"] = f"""with recursive {S.SEGMENTS}, o as (select *, row_number() over (partition by episode_id order by seg_idx) as rn from segments),
    w as (
        select episode_id, rn, 0 as seed_idx, start_ms, end_ms, speaker from o where rn = 1
        union all
        select episode_id, rn, case when fits then seed_idx else seed_idx + 1 end, case when fits then first_ms else start_ms end, end_ms, speaker
        from (
            select o.episode_id, o.rn, w.seed_idx, w.start_ms as first_ms, o.start_ms, o.end_ms, o.speaker,
                o.start_ms - w.end_ms <= 700 and o.speaker = w.speaker and w.end_ms - w.start_ms < 16000 and o.end_ms - w.start_ms <= 28000 as fits
            from w join o on o.episode_id = w.episode_id and o.rn = w.rn + 1
        )
    )
    select w.episode_id, w.seed_idx, min(o.start_ms)::bigint as start_ms, max(o.end_ms)::bigint as end_ms, any_value(o.speaker) as speaker, string_agg(o.text, ' ' order by o.rn) as text, count(*) as n
    from w join o on o.episode_id = w.episode_id and o.rn = w.rn group by 1, 2"""

ORACLES["c09_unify_marks"] = f"""with recursive {S.WORDS}, {word_marks("b", "words", "episode_id")},
    chars as (select episode_id, start_ms, end_ms, length(text) as n, unnest(range(length(text))) as pos, unnest(string_split(text, '')) as ch from segments),
    a as (select episode_id, (start_ms + floor((end_ms - start_ms) * pos / greatest(n, 1)::double))::bigint as t_ms from chars where ch in ('.', '!', '?') union select episode_id, end_ms from segments where end_ms > 0),
    ab as (select distinct * from (from a union all from b)),
    thin as (select episode_id, min(t_ms) as t_ms from ab group by 1 union all
        select k.episode_id, (select min(m.t_ms) from ab m where m.episode_id = k.episode_id and m.t_ms > k.t_ms + 250) from thin k where k.t_ms is not null)
    select distinct t.episode_id, coalesce(arg_min(b.t_ms, abs(b.t_ms - t.t_ms) * 2 + (b.t_ms > t.t_ms)::int), t.t_ms)::bigint as t_ms
    from thin t left join b on b.episode_id = t.episode_id and abs(b.t_ms - t.t_ms) <= 250 where t.t_ms is not null group by t.episode_id, t.t_ms"""

ORACLES["g03_stratified"] = f"""with {S.CLIPS}, s as (
        select *, least(floor((start_ms - min(start_ms) over e) * 3 / greatest(max(end_ms) over e - min(start_ms) over e, 1)::double), 2) as third,
            case when end_ms - start_ms < 15000 then 0 when end_ms - start_ms < 30000 then 1 else 2 end as class, sha1(clip_id) as tie from clips window e as (partition by episode_id)
    ), r as (
        select *, row_number() over (partition by episode_id, third order by final_score desc, tie) as a, row_number() over (partition by episode_id, class order by final_score desc, tie) as b from s
    ), p as (select episode_id, clip_id, row_number() over (partition by episode_id order by (least(a, b) > 2)::int, final_score desc, tie) as place from r)
    select * from p where place <= 8"""

ORACLES["f05_calibrator"] = f"""with {S.CLIPS}, l as (select value / 1000 as score from events where value / 1000 between 0 and 1 order by ts desc, value desc limit 500), a as (select list_sort(list(score)) as a from l),
    p as (select coalesce(a[round_even(0.1::double * (len(a) - 1), 0)::int + 1], 0.3) as p10, coalesce(a[round_even(0.9::double * (len(a) - 1), 0)::int + 1], 0.7) as p90 from a)
    select episode_id, clip_id, round_even(greatest(0.0, least(100.0, case when x <= p10 then case when p10 = 0 then 0.0 else 35 * x / p10 end
        when x >= p90 then 80 + 12 * least(1.0, (x - p90) / greatest(1 - p90, 1e-6)) else 35 + 45 * (x - p10) / (p90 - p10) end))::double, 0)::bigint as display from (select *, final_score as x from clips), p"""

ORACLES["g12_payoff_rescue"] = f"""with recursive {S.CLIPS}, v as (
        select episode_id, clip_id, final_score as c, case when (n_words % 2 = 0 or (n_words % 7) / 7::double >= 0.7) and (n_words % 3) / 2::double >= 0.6
            then case when greatest((n_words % 10) / 10::double, (n_words % 7) / 7::double) >= 0.35 then 0.05::double else 0.03::double end else 0.0::double end as bump from clips
    ), o as (select *, row_number() over (partition by episode_id order by c desc, clip_id) as rn from v),
    w as (
        select episode_id, rn, clip_id, c, case when bump > 0 then least(c * (1 + bump), c + 0.08::double) else c end as rescued from o where rn = 1
        union all
        select o.episode_id, o.rn, o.clip_id, o.c, case when o.bump > 0 then least(o.c * (1 + o.bump), greatest(w.rescued - 0.02::double, o.c), o.c + 0.08::double) else o.c end
        from w join o on o.episode_id = w.episode_id and o.rn = w.rn + 1
    )
    select episode_id, clip_id, c as calibrated, round(rescued, 6) as rescued from w"""

ORACLES["i01_progress"] = """with recursive e as (
        select user_id as episode_id, case event_type when 'signup' then 'queued' when 'view' then 'transcribing' when 'click' then 'scoring' when 'purchase' then 'processing' else 'completed' end as stage,
            least(greatest(json_extract_string(props, '$.k')::int, 0), 100)::bigint as percent, floor(epoch(ts))::bigint as at_s, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as rn from events
    ), x as (select *, list_position(['queued', 'uploading', 'converting', 'transcribing', 'scoring', 'processing', 'completed', 'error'], stage) as place from e),
    w as (
        select episode_id, rn, true as yes, stage, percent, at_s, place, 0::bigint as no from x where rn = 1
        union all
        select episode_id, rn, yes, case when yes then s else stage end, case when yes then p else percent end, case when yes then t else at_s end, case when yes then pl else place end, case when yes then no + 1 else no end
        from (
            select w.*exclude (rn, yes), x.rn, x.stage as s, x.percent as p, x.at_s as t, x.place as pl,
                not (w.stage in ('completed', 'error') or x.place < w.place or x.percent < w.percent or (x.stage = w.stage and (x.percent - w.percent < 5 or x.at_s - w.at_s < 2))) as yes
            from w join x on x.episode_id = w.episode_id and x.rn = w.rn + 1
        )
    )
    select episode_id, no, stage, percent, at_s from w where yes"""
