"""Queries of operators that combine or choose rows, over the tables' own rows and segments with the cue sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import experiments, features, joins, scores, selection, sequence, stats
from cliploom.operators.written import written
from cliploom.plans import sql as S
from cliploom.plans.cued import CUED, KEYS, columns, cued
from cliploom.plans.queries import clips, docs, events, query, segments, words
from cliploom.sources import transcripts as T

# --- sources -----------------------------------------------------------------------------------------------------


@query("a02_canonical_words", f"""with {S.WORDS} select episode_id, seg_idx, (word_idx - first_word)::bigint as word_idx, trim(w) as w, start_ms, start_ms + case when word_idx % 2 = 0 then 200 else round(length(trim(w)) * 0.06 * 1000)::bigint end as end_ms, (word_idx % 10) / 10.0::double as prob from words join (select episode_id as e, seg_idx as s, first_word from segments) on e = episode_id and s = seg_idx""")
def a02(spark, d):
    """Words with the start under `t` and a duration under `d` for every other one, as records of several spellings."""
    w = words(spark, d)
    number = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    record = F.struct(
        none.alias("w"), none.alias("word"), none.alias("token"), F.col("w").alias("text"), number(F.col("start_ms") / 1000).alias("t"), none.alias("start"), none.alias("s"), none.alias("ts"),
        none.alias("end"), none.alias("e"), none.alias("te"), F.when(F.col("word_idx") % 2 == 0, "0.2").alias("d"), number((F.col("word_idx") % 10) / 10).alias("prob"),
    )
    rows = w.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", record.alias("x")))), lambda r: r["x"]).alias("words"))
    out = T.canonical_words(rows)
    return out.withColumn("word_idx", F.col("word_idx").cast("long"))


@query("a06_clips_of_json", f"with {CUED} select seg_idx, episode_id, 0::bigint as clip_no, seg_idx::varchar as id, start_ms / 1000.0::double as start, end_ms / 1000.0::double as end_, text from x")
def a06(spark, d):
    body = F.concat(F.lit('{"clips": '), F.to_json(F.array(F.struct(F.col("seg_idx").cast("string").alias("clip_id"), (F.col("start_ms") / 1000).alias("startTime"), (F.col("end_ms") / 1000).alias("end"), F.col("text").alias("transcript")))), F.lit("}"))
    return T.clips_of_json(cued(spark, d).select(*KEYS, body.alias("body"))).select(*KEYS, F.col("clip_no").cast("long").alias("clip_no"), "id", "start", F.col("end").alias("end_"), "text")


@query("a09_get_clips", f"with {S.CLIPS} select episode_id, clip_id, start_ms, end_ms from clips where episode_id = 3")
def a09(spark, d):
    return T.get_clips(clips(spark, d), 3).select("episode_id", "clip_id", "start_ms", "end_ms")


@query("a16_hashtags", """with t as (select doc_id, list_transform(string_split(coalesce(source, ''), ' '), lambda w: lower(w)) as t from documents) select doc_id, array_to_string(list_filter([lower(source), lower(lang)], lambda v: v is not null and v <> ''), ' ') as tags from documents""")
def a16(spark, d):
    tags = T.collect_hashtags(F.concat(F.lit("#"), "source"), F.array("lang"))
    return docs(spark, d).select("doc_id", F.array_join(F.filter(tags, lambda t: t.isNotNull()), " ").alias("tags"))


# --- joins and lookups -------------------------------------------------------------------------------------------


@query("b14_clip_lookup", f"with {S.CLIPS}, t as (select clip_id, left(text, 20) as title from clips where n_words % 2 = 0) select c.clip_id, c.episode_id, t.title from clips c left join t using (clip_id)")
def b14(spark, d):
    c = clips(spark, d)
    return joins.clip_lookup(c, c.where("n_words % 2 = 0").select("clip_id", F.substring("text", 1, 20).alias("title")))


@query("b14_untitled", f"with {S.CLIPS} select clip_id, episode_id from clips where n_words % 2 = 1")
def b14u(spark, d):
    c = clips(spark, d)
    return joins.untitled(c, c.where("n_words % 2 = 0").select("clip_id")).select("clip_id", "episode_id")


@query("b19_payoff_guard", rf"""with {CUED} select episode_id, seg_idx, (case when seg_idx % 3 = 0 or regexp_matches(regexp_replace(substr(t, 101), '[^\x00-\x7F]', '_', 'g'), '\b(so|that means|because|the (answer|takeaway|key) is|here''?s (how|why))\b') then 0.9 else case when seg_idx % 3 = 1 then 0.5 else 0.7 end end)::double as score from x""")
def b19(spark, d):
    rows = cued(spark, d).select(*KEYS, "text", F.concat(F.lit("g"), F.col("seg_idx") % 3).alias("genre"), F.lit(0.9).alias("score"))
    return joins.payoff_guard(rows, spark.createDataFrame([("g1", 0.5), ("g2", 0.7)], "genre string, cap double")).select(*KEYS, "score")


# --- sequence ----------------------------------------------------------------------------------------------------

OPENS = "look|listen|here''s|here is|let me|the thing is|real talk|so here''s|okay so|so today|what we''re|we''re gonna|and i''ll|and i will|the 3|the three|top |why |how "


@query("c03_span_flags", rf"""with {CUED}, y as (select *, trim(t) as l from x) select episode_id, seg_idx, ends_with(l, '?') or regexp_matches(l, '^({OPENS})') as strong_opening,
    regexp_matches(l, 'the answer|that means|because|the key|so ') and regexp_matches(l, '[.!?]$') and len(string_split_regex(l, '[.!?]+')) >= 2 as complete_payoff from y""")
def c03(spark, d):
    return sequence.span_flags(cued(spark, d)).select(*KEYS, "strong_opening", "complete_payoff")


@query("c04_context_seeds")
def c04(spark, d):
    return sequence.context_seeds(cued(spark, d).withColumnRenamed("seg_idx", "span_idx"))


@query("c18_split_mixed")
def c18(spark, d):
    return sequence.split_mixed(cued(spark, d))


@query("c21_stitch_answers", rf"""with {CUED}, v as (select * replace (case when seg_idx % 2 = 0 then text || '?' else text end as text) from x), y as (select *, lead(text) over w as nt, lead(end_ms) over w as ne from v window w as (partition by episode_id order by seg_idx)),
    z as (select *, coalesce(ends_with(rtrim(text), '?') and regexp_matches(regexp_replace(lower(nt), '[^\x00-\x7F]', '_', 'g'), '\b(so|that means|here(''s)? (how|why)|the (answer|takeaway) is|because)\b'), false) as j from y)
    select episode_id, seg_idx, start_ms, case when j then least(end_ms + 8000, ne) else end_ms end as end_ms, case when j then text || ' ' || nt else text end as text, j as has_answer from z""")
def c21(spark, d):
    asked = F.when(F.col("seg_idx") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return sequence.stitch_answers(cued(spark, d).withColumn("text", asked))


@query("c22_collapse_runs", f"""with {S.CLIPS}, q as (select *, seg % 3 <> 0 as ask from (select *, row_number() over (partition by episode_id order by start_ms, clip_id) as seg from clips)), b as (select *, case when not ask or not coalesce(lag(ask) over (partition by episode_id order by seg), false) then 1 else 0 end as n from q),
    r as (select *, sum(n) over (partition by episode_id order by seg) as run from b), k as (select *, row_number() over (partition by episode_id, run order by final_score desc, start_ms, clip_id) as rn from r) select episode_id, clip_id from k where rn = 1 or not ask""")
def c22(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("start_ms", "clip_id"))
    rows = clips(spark, d).withColumn("n", n).withColumn("text", F.when(F.col("n") % 3 != 0, "Really?").otherwise("Yes.")).withColumn("payoff_score", F.lit(0.0))
    return sequence.collapse_runs(rows).select("episode_id", "clip_id")


@query("c31_refine_grid")
def c31(spark, d):
    return sequence.refine_grid(clips(spark, d), segments(spark, d))


@query("c35_pick_variant", f"""with {S.CLIPS}, r as (select *, row_number() over (partition by episode_id, start_ms order by finished desc, final_score desc, end_ms) as rn from clips where end_ms - start_ms between 7500 and 90000) select episode_id, start_ms, end_ms, final_score from r where rn = 1""")
def c35(spark, d):
    rows = clips(spark, d).withColumn("clip_id", F.col("start_ms").cast("string"))
    return sequence.pick_variant(rows, "final_score").select("episode_id", "start_ms", "end_ms", "final_score")


@query("c36_hysteresis", f"""with {S.CLIPS}, k as (select start_ms, episode_id, end_ms, final_score, row_number() over (partition by episode_id, start_ms order by end_ms) as n from clips), cur as (select * from k where n = 1), o as (select *, row_number() over (partition by episode_id, start_ms order by final_score desc, end_ms) as rn from k where n > 1)
    select cur.episode_id || '-' || cur.start_ms as clip_id, cur.start_ms, case when coalesce(o.final_score > cur.final_score + 0.005::double + 0.03::double, false) then o.end_ms else cur.end_ms end as end_ms, coalesce(o.final_score > cur.final_score + 0.005::double + 0.03::double, false) as moved from cur left join o on o.episode_id = cur.episode_id and o.start_ms = cur.start_ms and o.rn = 1""")
def c36(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("episode_id", "start_ms").orderBy("end_ms"))
    rows = clips(spark, d).select(F.concat_ws("-", "episode_id", "start_ms").alias("clip_id"), "start_ms", "end_ms", F.col("final_score").alias("score"), n.alias("n"))
    return sequence.hysteresis(rows.where("n = 1").drop("n"), rows.where("n > 1").drop("n")).select("clip_id", "start_ms", "end_ms", "moved")


# --- features ----------------------------------------------------------------------------------------------------

HOOKS = [("curiosity", r"\b(what if|did you know|why)\b", 0.35), ("contrarian", r"\b(most people|nobody|actually)\b", 0.30), ("authority", r"\bi built\b", 0.25)]


@query("d03_hook_v5", rf"""with {CUED}, y as (select *, regexp_replace(t, '[^\x00-\x7F]', '_', 'g') as a from x), z as (select *, greatest(0.0, least(1.0, (1 - {" * ".join(f"(1 - case when regexp_matches(a, '{p}') then {w} else 0 end)" for _, p, w in HOOKS)})::double * (case when regexp_matches(a, '\d|\b(because|proof|study|data|example)\b') then 1.0 else 0.8 end)::double
    * exp(-seg_idx / 48.0::double) - regexp_matches(a, '^(hi|hello|welcome|thanks for|that''s all)')::int * 0.25)) as raw from y) select episode_id, seg_idx, round(raw, 6)::double as raw, round(1 / (1 + exp(-(1.6::double * (raw - 0.4::double) / 0.18::double))), 6)::double as hook from z""")
def d03(spark, d):
    raw, hook = features.hook_v5(F.col("text"), F.col("seg_idx"), HOOKS)
    return columns(spark, d, raw=raw, hook=hook)


@query("d05_cluster_cues", """select event_type as cue, case when regexp_matches(lower(event_type), 'click|view') then 'looking' when regexp_matches(lower(event_type), 'purchase|cart') then 'buying' else 'general' end as family from (select distinct event_type from events)""")
def d05(spark, d):
    return features.cluster_cues(events(spark, d).select(F.col("event_type").alias("cue")).distinct(), [("looking", "click|view"), ("buying", "purchase|cart")])


CLOSE = "and that''s why|so we|that''s why|which is why|this is why|that''s it|that''s right|all set|we''re done"


@query("d25_finish_confidence", rf"""with {CUED}, y as (select *, lead(text) over w as nt, lead(start_ms) over w - end_ms as gap from x window w as (partition by episode_id order by seg_idx)), z as (select *, regexp_matches(trim(text), '[.!?]$') as e from y)
    select episode_id, seg_idx, round((case when trim(text) = '' then 0 else least(1.0, e::int * 0.6 + (e and coalesce(regexp_matches(nt, '^\p{{Lu}}'), false))::int * 0.2 + regexp_matches(t, '{CLOSE}')::int * 0.4 + coalesce(gap > 500, false)::int * 0.2 + regexp_matches(trim(text), '[,;:]$')::int * 0.1 + coalesce(case when gap between 0 and 1200 then 0.1 * (1200 - gap) / 1200.0 end, 0)) end)::double, 6) as confidence from z""")
def d25(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id").orderBy("seg_idx")
    gap = F.lead("start_ms").over(w) - F.col("end_ms")
    rows = cued(spark, d).withColumn("next", F.lead("text").over(w)).withColumn("gap", gap)
    return rows.select(*KEYS, F.round(features.finish_confidence(F.col("text"), F.col("next"), F.col("gap"), F.col("gap")), 6).alias("confidence"))


@query("d26_finish_threshold", """select doc_id, round(greatest(0.3, least(0.8, 0.6 - (length(coalesce(text, '')) % 10 > 7)::int * 0.15 + (doc_id % 3 = 0)::int * 0.1 - (doc_id % 2 = 0)::int * 0.1))::double, 6) as threshold from documents""")
def d26(spark, d):
    genre = F.when(F.col("doc_id") % 3 == 0, "technical").otherwise("comedy")
    return docs(spark, d).select("doc_id", F.round(features.finish_threshold(genre, (F.length("text") % 10) / 10, F.col("doc_id") % 2 == 0), 6).alias("threshold"))


@query("d31_arousal_mix", f"""with {CUED}, y as (select episode_id, seg_idx, (seg_idx % 7) / 7.0::double as arousal, length(text)::double as v from x), z as (select *, (v - avg(v) over w) / nullif(stddev_pop(v) over w, 0) as z from y window w as (partition by episode_id)) select episode_id, seg_idx, round(0.6::double * arousal + 0.4::double * (0.5::double + 0.5::double * ((exp(2 * coalesce(z, 0)) - 1) / (exp(2 * coalesce(z, 0)) + 1))), 6) as arousal_mix from z""")
def d31(spark, d):
    rows = cued(spark, d).select(*KEYS, ((F.col("seg_idx") % 7) / 7).alias("arousal"), F.length("text").cast("double").alias("rms_var"))
    return features.arousal_blend(rows).select(*KEYS, "arousal_mix")


@query("d34_archetypes")
def d34(spark, d):
    return features.archetypes(cued(spark, d).select(F.concat_ws("-", *KEYS).alias("key"), "text"), [("teacher", "did you know", 40.0), ("teacher", "here's why", 20.0), ("founder", "i built", 45.0), ("reporter", "breaking", 35.0), ("reporter", "according to", 30.0)], "key")


@query("d35_asr_quality", f"with {S.WORDS} select episode_id, seg_idx, round(avg((word_idx % 10) / 10.0::double), 6) as asr_confidence, regexp_matches(rtrim(any_value(text)), '[.!?]$') as punctuated from words join (select episode_id, seg_idx, text from segments) using (episode_id, seg_idx) group by 1, 2")
def d35(spark, d):
    w = words(spark, d).groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list("word_idx")), lambda i: F.struct(((i % 10) / 10).cast("string").alias("prob"))).alias("words"))
    return features.asr_quality(segments(spark, d).join(w, list(KEYS)).withColumn("confidence", F.lit(None).cast("double")))


@query("d36_clean_title")
def d36(spark, d):
    return cued(spark, d).select(*KEYS, features.clean_title(F.col("text")).alias("title"))


# --- scores and statistics ---------------------------------------------------------------------------------------


@query("e01_weights", "with w as (select event_type as name, sum(value) as weight from events group by 1) select name, round(weight / sum(weight) over (), 9) as weight from w")
def e01(spark, d):
    w = events(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("weight"))
    return scores.weights_normalised(w).select("name", F.round("weight", 9).alias("weight"))


@query("e04_genre_score", """with x as (select doc_id, 'g' || (doc_id % 2) as genre, (doc_id % 10) / 10.0::double as hook, (doc_id % 7) / 7.0::double as payoff from documents), w(genre, path, feature, weight) as (values ('g0', 'a', 'hook', 0.6::double), ('g0', 'a', 'payoff', 0.4::double), ('g0', 'b', 'payoff', 0.9::double), ('g1', 'a', 'hook', 0.5::double)),
    s as (select doc_id, x.genre, path, round(sum(case feature when 'hook' then hook else payoff end * weight), 6) as score from x join w on w.genre = x.genre group by 1, 2, 3) select *, row_number() over (partition by doc_id order by score desc, path) = 1 as first from s""")
def e04(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat(F.lit("g"), F.col("doc_id") % 2).alias("genre"), ((F.col("doc_id") % 10) / 10).alias("hook"), ((F.col("doc_id") % 7) / 7).alias("payoff"))
    w = spark.createDataFrame([("g0", "a", "hook", 0.6), ("g0", "a", "payoff", 0.4), ("g0", "b", "payoff", 0.9), ("g1", "a", "hook", 0.5)], "genre string, path string, feature string, weight double")
    return scores.genre_score(rows, w, "doc_id")


@query("e06_blend_weights", """with c as (select user_id, event_type as genre, (count(*) / sum(count(*)) over (partition by user_id))::double as confidence from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by confidence desc, genre) as rn from c where confidence >= 0.2), t as (select *, confidence / sum(confidence) over (partition by user_id) as share from r where rn <= 2),
    w as (select distinct event_type as genre, unnest(['hook', 'payoff']) as name from events), m as (select user_id, name, sum(share * case when name = 'hook' then length(genre) else 10 end) as w from t join w using (genre) group by 1, 2) select user_id, name, round(w / sum(w) over (partition by user_id), 6)::double as weight from m""")
def e06(spark, d):
    from pyspark.sql import Window

    n = events(spark, d).groupBy("user_id", F.col("event_type").alias("genre")).agg(F.count("*").alias("n"))
    sure = n.select("user_id", "genre", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("confidence"))
    w = events(spark, d).select(F.col("event_type").alias("genre")).distinct().withColumn("name", F.explode(F.array(F.lit("hook"), F.lit("payoff"))))
    return scores.blend_weights(sure, w.withColumn("weight", F.when(F.col("name") == "hook", F.length("genre")).otherwise(10).cast("double")), "user_id")


@query("e07_whiten", """with x as (select doc_id, [(doc_id % 10) / 10.0::double, (doc_id % 7) / 7.0::double, 0.5::double] as v from documents), y as (select *, list_sum(v) / 3 as m from x), z as (select *, sqrt(list_sum(list_transform(v, lambda a: (a - m) * (a - m)))) as n from y)
    select doc_id, round(greatest(0, least(1, (v[1] - m) / (case when n = 0 then 1 else n end) * 0.5::double + 0.5::double)), 6)::double as white_a, round(greatest(0, least(1, (v[2] - m) / (case when n = 0 then 1 else n end) * 0.5::double + 0.5::double)), 6)::double as white_b from z""")
def e07(spark, d):
    rows = docs(spark, d).select("doc_id", ((F.col("doc_id") % 10) / 10).alias("a"), ((F.col("doc_id") % 7) / 7).alias("b"), F.lit(0.5).alias("c"))
    return scores.whiten(rows, ["a", "b", "c"]).select("doc_id", "white_a", "white_b")


@query("e08_synergy", """with x as (select doc_id, (doc_id % 10) / 10.0::double as h, (doc_id % 7) / 7.0::double as a, (doc_id % 11) / 11.0::double as p from documents) select doc_id, (case when h >= 0.6 and a >= 0.5 and p >= 0.4 then 0.12 when h >= 0.4 and (a >= 0.4 or p >= 0.3) then 0.06 else 0.0 end)::double as step,
    round(greatest(-0.10, least(0.15, 0.10 * (h + p + a) / 3 + 0.05 * (h + p + a) / 3 - (h > 0.8 and (p < 0.3 or h < 0.3))::int * 0.08 - (a > 0.8 and p < 0.3)::int * 0.05))::double, 6) as unified from x""")
def e08(spark, d):
    rows = docs(spark, d).select("doc_id", ((F.col("doc_id") % 10) / 10).alias("hook"), ((F.col("doc_id") % 7) / 7).alias("arousal"), ((F.col("doc_id") % 11) / 11).alias("payoff"))
    rows = rows.select("*", F.col("hook").alias("info_density"), F.col("payoff").alias("q_list"), F.col("arousal").alias("loopability"))
    return rows.select("doc_id", scores.synergy_step(F.col("hook"), F.col("arousal"), F.col("payoff")).alias("step"), F.round(scores.synergy_unified(), 6).alias("unified"))


@query("e10_anti_bait")
def e10(spark, d):
    rows = cued(spark, d).withColumn("n_words", features.n_words(F.col("text"))).withColumn("final_score", F.lit(0.9)).withColumn("hook", (F.col("seg_idx") % 4) / 3).withColumn("payoff", (F.col("seg_idx") % 5) / 10)
    return scores.anti_bait_cap(rows).select(*KEYS, "final_score", F.array_join("caps_applied", ",").alias("caps"))


@query("e15_explain", """with x as (select doc_id, (doc_id % 10) / 10.0::double as hook, (doc_id % 7) / 7.0::double as payoff from documents) select doc_id, case when hook >= 0.5 and payoff >= 0.5 then case when hook >= payoff then 'hook, payoff' else 'payoff, hook' end when hook >= 0.5 then 'hook' when payoff >= 0.5 then 'payoff' else '' end as strengths from x""")
def e15(spark, d):
    rows = docs(spark, d).select("doc_id", ((F.col("doc_id") % 10) / 10).alias("hook"), ((F.col("doc_id") % 7) / 7).alias("payoff"))
    return scores.explain(rows, ["hook", "payoff"]).select("doc_id", "strengths")


@query("e16_viability", """with x as (select doc_id, coalesce(text, '') as text, doc_id % 5 <> 0 as f, (doc_id % 10) / 10.0 as a, (doc_id % 7) / 7.0 as c, (doc_id % 11) / 20.0 as s from documents) select doc_id, case when trim(text) = '' then 'empty' when a >= 0.6 then 'ad' when not f or c < 0.66 then 'unfinished' when s >= 0.3 then 'safety' end as gate_reason from x""")
def e16(spark, d):
    rows = docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 5 != 0).alias("finished"), ((F.col("doc_id") % 10) / 10).alias("ad_likelihood"), ((F.col("doc_id") % 7) / 7).alias("coverage"), ((F.col("doc_id") % 11) / 20).alias("safety"))
    return scores.viability(rows).select("doc_id", "gate_reason")


@query("f02_minmax", f"with {S.CLIPS}, r as (select *, min(final_score) over w as lo, max(final_score) over w as hi from clips window w as (partition by episode_id)) select episode_id, clip_id, round(case when hi - lo > 1e-9 then 100 * (final_score - lo) / (hi - lo) else 50 end, 6)::double as pct from r")
def f02(spark, d):
    return stats.minmax_pct(clips(spark, d), "episode_id").select("episode_id", "clip_id", "pct")


@query("f05_calibrator")
def f05(spark, d):
    return stats.calibrator(events(spark, d).select((F.col("value") / 1000).alias("score"), "ts"), clips(spark, d)).select("episode_id", "clip_id", "display")


@query("f09_tfidf_cosine")
def f09(spark, d):
    vectors = stats.tfidf(segments(spark, d).select(F.concat_ws("-", *KEYS).alias("key"), "text"), "key")
    return stats.tfidf_cosine(vectors.withColumn("episode_id", F.substring_index("key", "-", 1)), "key", "episode_id")


@query("f19_reason_counts", "with r as (select unnest(list_filter([source, lang, case when doc_id % 2 = 0 then 'even' end], lambda x: x is not null)) as reason from documents) select reason, count(*) as n from r group by 1")
def f19(spark, d):
    rows = docs(spark, d).select(F.array_compact(F.array("source", "lang", F.when(F.col("doc_id") % 2 == 0, "even"))).alias("reasons"))
    return stats.reason_counts(rows)


@query("f24_episode_stats", f"with {S.SEGMENTS} select episode_id, round(avg(n_words), 6) as mean_n_words, round(stddev_pop(n_words), 6) as std_n_words from segments group by 1")
def f24(spark, d):
    out = stats.episode_stats(segments(spark, d), ["n_words"])
    return out.select("episode_id", F.round("mean_n_words", 6).alias("mean_n_words"), F.round("std_n_words", 6).alias("std_n_words"))


# --- selection ---------------------------------------------------------------------------------------------------


def pool(spark, d):
    """Clips without their texts, scored once and written, as the rules below read them many times."""
    return written(clips(spark, d).drop("text"), "clips")


def chosen(rows, n=3):
    return selection.rank_clips(rows).where(F.col("place") <= n).drop("place")


PICKED = "p as (select *, row_number() over (partition by episode_id order by final_score desc, start_ms, clip_id) as place from clips), ch as (select * exclude (place) from p where place <= 3)"
WEAKEST = "weak as (select episode_id, clip_id, row_number() over (partition by episode_id order by final_score, clip_id desc) as rn from ch), res as (select episode_id, clip_id from ch where clip_id not in (select w.clip_id from weak w join best b on b.episode_id = w.episode_id where w.rn = 1) union all select episode_id, clip_id from best)"


@query("g09_diversity_swap")
def g09(spark, d):
    rows = pool(spark, d)
    return selection.diversity_swap(chosen(rows), rows, 4_000, 0.2).select("episode_id", "clip_id")


@query("g10_length_mix", f"""with {S.CLIPS}, {PICKED}, st as (select episode_id, max(final_score) as top, bool_or(end_ms - start_ms >= 30000) as has from ch group by 1), b as (select c.*, row_number() over (partition by c.episode_id order by c.final_score desc, c.clip_id) as rn from clips c join st on st.episode_id = c.episode_id where c.end_ms - c.start_ms >= 30000 and not has and c.final_score >= 0.8::double * top),
    best as (select * from b where rn = 1), {WEAKEST} select * from res""")
def g10(spark, d):
    rows = pool(spark, d)
    return selection.length_mix(chosen(rows), rows).select("episode_id", "clip_id")


@query("g11_finished_backstop", f"""with {S.CLIPS}, {PICKED}, st as (select episode_id, min(final_score) as low, bool_or(n_words % 10 = 0) as has from ch group by 1), b as (select c.*, row_number() over (partition by c.episode_id order by c.final_score desc, c.clip_id) as rn from clips c join st on st.episode_id = c.episode_id where c.n_words % 10 = 0 and not has and c.final_score >= low - 0.05::double),
    best as (select * from b where rn = 1), {WEAKEST} select * from res""")
def g11(spark, d):
    rows = pool(spark, d).withColumn("finished", F.col("n_words") % 10 == 0)
    return selection.finished_backstop(chosen(rows), rows).select("episode_id", "clip_id")


@query("g12_payoff_rescue")
def g12(spark, d):
    rows = clips(spark, d).withColumn("calibrated", F.col("final_score")).withColumn("payoff_score", (F.col("n_words") % 10) / 10).withColumn("insight_score", (F.col("n_words") % 7) / 7).withColumn("insight_conf", (F.col("n_words") % 3) / 2)
    return selection.payoff_rescue(rows.withColumn("payoff_label", F.when(F.col("n_words") % 2 == 0, "lead")))


@query("g17_rank_titles")
def g17(spark, d):
    c = cued(spark, d).withColumn("clip_id", F.concat_ws("-", *KEYS))
    titles = c.select("clip_id", F.explode(F.array(F.substring_index("text", " ", 6), F.substring_index("text", " ", -6))).alias("title"))
    return selection.rank_titles(titles, c)


@query("g19_fail_reason", """with x as (select doc_id, (doc_id % 20) / 100.0 as h, (doc_id % 7) / 10.0 as p, (doc_id % 5) / 8.0 as a, (doc_id % 3) / 4.0 as q, (doc_id % 4) / 10.0 as ad from documents), y as (select *, case when p >= 0.6 and a >= 0.45 then 0.06 when p >= 0.4 and a >= 0.35 then 0.10 else 0.15 end as lim from x)
    select doc_id, case when h < 0.08 and ad >= 0.3 and p < 0.25 then 'ad_like;weak_hook;no_payoff' when h < 0.08 and ad >= 0.3 then 'ad_like;weak_hook' when h < 0.08 and p < 0.25 then 'weak_hook;no_payoff' when h < 0.08 then 'weak_hook_very_soft' when h < lim then 'weak_hook_mild_soft' when p < 0.25 and q < 0.5 then 'no_payoff' when a < 0.2 then 'low_energy' end as fail_reason from y""")
def g19(spark, d):
    share = lambda n, k: (F.col("doc_id") % n) / k
    return selection.fail_reason(docs(spark, d).select("doc_id", share(20, 100).alias("hook"), share(7, 10).alias("payoff"), share(5, 8).alias("arousal"), share(3, 4).alias("question"), share(4, 10).alias("ad_penalty"))).select("doc_id", "fail_reason")


@query("g20_family_pick", f"with {S.CLIPS}, r as (select *, row_number() over (partition by episode_id, start_ms order by finished desc, end_ms - start_ms desc, final_score desc, clip_id) as rn from clips) select episode_id, clip_id from r where rn = 1")
def g20(spark, d):
    return selection.family_pick(clips(spark, d).withColumn("family", F.col("start_ms"))).select("episode_id", "clip_id")


@query("h03_dedup_iou")
def h03(spark, d):
    return selection.dedup_iou(clips(spark, d)).select("episode_id", "clip_id")


@query("h09_union_candidates", f"with {S.CLIPS} select episode_id, clip_id, case when n_words % 2 = 0 then 'seed' else 'other' end as source, n_words % 2 = 0 as is_seed from clips")
def h09(spark, d):
    c = clips(spark, d).select("episode_id", "clip_id", (F.col("n_words") % 2 == 0).alias("finished"))
    return selection.union_candidates(c.where("finished"), c.where("not finished")).drop("finished")


@query("j06_choices", "select user_id::varchar as test_id, lower(event_type) as choice, ts from events where user_id is not null and event_type is not null")
def j06(spark, d):
    return experiments.choices(events(spark, d).select(F.col("user_id").alias("test_id"), F.col("event_type").alias("choice"), "ts"))
