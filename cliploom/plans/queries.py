"""The library's queries over the driver's tables, each with SQL that gives the same rows where SQL can express it.

A query is registered with @query(name, sql). Segments and words come from `conversations` with times by rule; clips
are the runs of one to three segments; texts in bulk are `documents`; usage, metrics and requests are `events`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import experiments, features, joins, scores, selection, sequence, stats
from cliploom.plans import sql as S
from cliploom.sources import transcripts as T
from cliploom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return keep


def segments(spark: SparkSession, d: str) -> DataFrame:
    return T.segments_of_conversations(spark, d)


def words(spark: SparkSession, d: str) -> DataFrame:
    return T.words_of_segments(segments(spark, d))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to three segments of an episode, with the cheap score and whether they end a sentence."""
    from pyspark.sql import Window

    s = Window.partitionBy("episode_id").orderBy("seg_idx")
    rows = segments(spark, d).select("episode_id", "start_ms", "end_ms", "text", *(F.lead(c, k).over(s).alias(f"{c}_{k}") for c in ("end_ms", "text") for k in (1, 2)))
    one = lambda e, *t: F.struct(F.col(e).alias("end_ms"), F.concat_ws(" ", *t).alias("text"))
    runs = F.array(one("end_ms", "text"), one("end_ms_1", "text", "text_1"), one("end_ms_2", "text", "text_1", "text_2"))
    rows = rows.select("episode_id", "start_ms", F.explode(runs).alias("x")).select("episode_id", "start_ms", "x.*").where("end_ms is not null")
    text, seconds = F.col("text"), (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = T.assign_clip_ids(rows).withColumn("n_words", features.n_words(text).cast("long"))
    return rows.withColumn("final_score", F.round(features.prerank_score(text, seconds), 6)).withColumn("finished", text.rlike(r"[.!?]\s*$"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def events(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events")


CORPUS_LEXICON = (("function", "the", 1.0), ("function", "and", 1.0), ("function", "of", 0.5), ("function", "in", 0.5), ("romance", "de", 1.0), ("romance", "la", 1.0), ("romance", "que", 0.5), ("german", "der", 1.0), ("german", "und", 1.0), ("german", "die", 0.5))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, "token", w) for a, b, w in CORPUS_LEXICON], "lexicon string, term string, match_mode string, weight double")


LEXICON_SQL = "lexicon(lexicon, term, weight) as (values " + ", ".join(f"('{a}', '{b}', {w}::double)" for a, b, w in CORPUS_LEXICON) + ")"
DOC_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}0-9'']+')"

# --- sources -----------------------------------------------------------------------------------------------------


@query("a01_segments", f"with {S.SEGMENTS} select episode_id, seg_idx, speaker, n_words, start_ms::bigint as start_ms, end_ms::bigint as end_ms from segments")
def a01(spark, d):
    return segments(spark, d).select("episode_id", "seg_idx", "speaker", "n_words", "start_ms", "end_ms")


@query("a03_words", f"with {S.WORDS} select episode_id, seg_idx, word_idx, w, start_ms, end_ms from words")
def a03(spark, d):
    return words(spark, d)


@query("a03_synthesize_words", f"""with {S.SEGMENTS} , l as (select episode_id, seg_idx, start_ms, (end_ms - start_ms)::double / len(ws) as step, unnest(ws) as w, unnest(range(len(ws))) as pos from segments)
    select episode_id, seg_idx, pos::bigint as pos, w, floor(start_ms + pos * step)::bigint as start_ms, floor(start_ms + (pos + 1) * step)::bigint as end_ms from l""")
def a03s(spark, d):
    return T.synthesize_words(segments(spark, d).select("episode_id", "seg_idx", "start_ms", "end_ms", "text")).withColumn("pos", F.col("pos").cast("long"))


@query("a03_sentences", r"""with s as (select doc_id as episode_id, regexp_extract_all(text, '[^.!?]+[.!?]*') as s from documents)
    select episode_id, unnest(range(len(s)))::bigint as seg_idx, unnest(s) as text from s""")
def a03d(spark, d):
    return T.sentences_of_documents(spark, d).withColumn("seg_idx", F.col("seg_idx").cast("long"))


@query("a04_normalize_text", "select doc_id, replace(translate(coalesce(text, ''), '‘’‚“”„‐‑‒–—−\u00a0', '''''''\"\"\"------ '), '…', '...') as text from documents")
def a04(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("a08_latest_by_user", "select * exclude (rn) from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def a08(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return T.upsert(e.where("event_type != 'purchase'"), e.where("event_type = 'purchase'"), "user_id", "version").drop("version")


@query("a10_titles", r"""with t as (select page_id, regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1) as t from pages), u as (select page_id, unnest(t) as raw, unnest(range(len(t))) as no from t)
    select page_id, no::bigint as no, trim(regexp_replace(raw, '<[^>]+>', '', 'g')) as title from u where trim(regexp_replace(raw, '<[^>]+>', '', 'g')) <> ''""")
def a10(spark, d):
    return T.extract_titles(T.read(spark, d, "pages"), skip=0)


@query("a11_clamp_spans", f"""with {S.CLIPS}, e as (select episode_id, max(end_ms) - 2000 as d from clips group by 1)
    select episode_id, clip_id, least(greatest(start_ms, 0), greatest(d - 500, 0))::bigint as start_ms, least(greatest(end_ms, start_ms + 500), d)::bigint as end_ms from clips join e using (episode_id)""")
def a11(spark, d):
    c = clips(spark, d).select("episode_id", "clip_id", "start_ms", "end_ms")
    return T.clamp_spans(c, c.groupBy("episode_id").agg((F.max("end_ms") - 2000).alias("duration_ms")))


@query("a12_clip_ids", f"with {S.CLIPS} select episode_id, clip_id, start_ms, end_ms, regexp_matches(clip_id, '^[0-9a-f]{{16}}$') as valid from clips")
def a12(spark, d):
    return clips(spark, d).select("episode_id", "clip_id", "start_ms", "end_ms", T.valid_clip_id(F.col("clip_id")).alias("valid"))


@query("a14_caption_lines", f"""with {S.WORDS}, l as (select *, (row_number() over (partition by episode_id order by word_idx) - 1) // 5 as line from words)
    select episode_id, line::bigint as line, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(w, ' ' order by word_idx) as text from l group by 1, 2""")
def a14(spark, d):
    return T.caption_lines(words(spark, d), 5)


@query("a15_episode_duration", f"with {S.SEGMENTS} select episode_id, max(end_ms)::bigint as duration_ms from segments group by 1")
def a15(spark, d):
    s = segments(spark, d)
    none = s.select("episode_id").distinct().withColumn("duration_ms", F.lit(0).cast("long"))
    return T.episode_duration(none, words(spark, d), s, clips(spark, d))


@query("a13_vtt")
def a13(spark, d):
    return T.captions_to_vtt(sequence.vtt_cues(words(spark, d)))


# --- joins -------------------------------------------------------------------------------------------------------

OVERLAP = "w.episode_id = c.episode_id and w.start_ms < c.end_ms + 250 and w.end_ms > greatest(c.start_ms - 250, 0)"


@query("b01_words_overlap_clips", f"with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]} select c.episode_id, c.clip_id, count(*) as n, min(word_idx) as first_word, max(word_idx) as last_word from clips c join words w on {OVERLAP} group by 1, 2")
def b01(spark, d):
    rows = joins.words_overlap_clips(words(spark, d), clips(spark, d))
    return rows.groupBy("episode_id", "clip_id").agg(F.count("*").alias("n"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"))


@query("b02_words_contained", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]} select c.episode_id, c.clip_id, count(*) as n from clips c join words w
    on w.episode_id = c.episode_id and w.start_ms >= greatest(c.start_ms - 80, 0) and w.end_ms <= c.end_ms + 80 where lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) not in ('uh', 'um') group by 1, 2""")
def b02(spark, d):
    return joins.words_contained_in(words(spark, d), clips(spark, d)).groupBy("episode_id", "clip_id").agg(F.count("*").alias("n"))


@query("b03_words_clamped", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]} , x as (select c.episode_id, c.clip_id, c.end_ms - c.start_ms as size, w.word_idx, round((greatest(w.start_ms, c.start_ms) - c.start_ms) / 1000.0, 2) as t,
        round((least(w.end_ms, c.end_ms) - greatest(w.start_ms, c.start_ms)) / 1000.0, 2) as d, row_number() over (partition by c.episode_id, c.clip_id order by word_idx desc) as r
    from clips c join words w on w.episode_id = c.episode_id and w.start_ms < c.end_ms and w.end_ms > c.start_ms)
    select episode_id, clip_id, count(*) as n, round(sum(d), 2) as total, max(t) as last_t from (select *, case when r = 1 then least(d, round(round(size / 1000.0, 2) - t, 2)) else d end as d2 from x) group by 1, 2""")
def b03(spark, d):
    spoken = words(spark, d).select("episode_id", "word_idx", "start_ms", "end_ms")
    return joins.words_clamped_to_clip(spoken, clips(spark, d)).groupBy("episode_id", "clip_id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 2).alias("total"), F.max("t").alias("last_t"))


@query("b04_clip_transcript", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]} select c.episode_id, c.clip_id, regexp_replace(string_agg(w, ' ' order by word_idx), '\\s+([,.!?;:])', '\\1', 'g') as transcript, 'words' as source, count(*) as n_words,
    round(least(sum(w.end_ms - w.start_ms)::double / greatest(max(c.end_ms) - max(c.start_ms), 1), 1.0), 6) as coverage
    from clips c join words w on w.episode_id = c.episode_id and w.start_ms >= greatest(c.start_ms - 80, 0) and w.end_ms <= c.end_ms + 80 group by 1, 2""")
def b04(spark, d):
    return joins.clip_transcript(clips(spark, d), words(spark, d), segments(spark, d))


@query("b05_window_text", f"""with {S.SEGMENTS}, t as (select episode_id, max(end_ms) as total from segments group by 1), w as (select episode_id, total, unnest(range(0, total + 1, 18000)) as start_ms from t),
    v as (select episode_id, start_ms, least(start_ms + 28000, total) as end_ms from w where least(start_ms + 28000, total) - start_ms >= 8000)
    select v.episode_id, v.start_ms || '-' || v.end_ms as clip_id, v.start_ms::bigint as start_ms, v.end_ms::bigint as end_ms, string_agg(text, ' ' order by seg_idx) as text, count(*) as n_segments from v join segments s
    on s.episode_id = v.episode_id and least(s.end_ms, v.end_ms) - greatest(s.start_ms, v.start_ms) > 500 group by 1, 2, 3, 4 having length(trim(string_agg(text, ' ' order by seg_idx))) >= 20""")
def b05(spark, d):
    return sequence.sliding_windows(segments(spark, d))


@query("b06_attach_words", f"with {S.WORDS} select s.episode_id, s.seg_idx, count(*) as n, min(w.word_idx) as first_word from segments s join words w on w.episode_id = s.episode_id and w.end_ms > s.start_ms and w.start_ms < s.end_ms group by 1, 2")
def b06(spark, d):
    return joins.attach_words(segments(spark, d), words(spark, d)).select("episode_id", "seg_idx", F.size("words").cast("long").alias("n"), F.col("words")[0]["word_idx"].alias("first_word"))


MARKS = "marks as (select distinct episode_id, end_ms as t_ms from words where regexp_matches(w, '[.!?]$'))"


def marks(spark, d):
    return words(spark, d).where(F.col("w").rlike("[.!?]$")).select("episode_id", F.col("end_ms").alias("t_ms")).distinct()


def points(spark, d):
    return segments(spark, d).select("episode_id", "seg_idx", (F.col("end_ms") - 700).alias("end_ms"))


@query("b07_next_prev_eos", f"""with {S.WORDS}, {MARKS}, p as (select episode_id, seg_idx, (end_ms - 700)::bigint as end_ms from segments)
    select episode_id, seg_idx, end_ms, (select min(t_ms) from marks m where m.episode_id = p.episode_id and t_ms >= p.end_ms) as next_ms, (select max(t_ms) from marks m where m.episode_id = p.episode_id and t_ms < p.end_ms) as prev_ms from p""")
def b07(spark, d):
    m = marks(spark, d)
    return joins.prev_eos(joins.next_eos(points(spark, d), m), m)


@query("b08_near_eos", f"""with {S.WORDS}, {MARKS}, p as (select episode_id, seg_idx, (end_ms - 700)::bigint as end_ms from segments)
    select episode_id, seg_idx, end_ms, exists (select 1 from marks m where m.episode_id = p.episode_id and abs(t_ms - p.end_ms) <= 250) as near from p""")
def b08(spark, d):
    return joins.near_eos(points(spark, d), marks(spark, d))


@query("b09_snap_to_word_end", f"""with {S.WORDS}, p as (select episode_id, seg_idx, (end_ms - 700)::bigint as end_ms from segments)
    select episode_id, seg_idx, end_ms, coalesce((select max(w.end_ms) from words w where w.episode_id = p.episode_id and w.end_ms < p.end_ms), (select min(w.end_ms) from words w where w.episode_id = p.episode_id)) as snapped_ms from p""")
def b09(spark, d):
    return joins.snap_to_word_end(points(spark, d), words(spark, d))


@query("b10_snap_nearest", f"""with {S.WORDS}, {MARKS}, p as (select episode_id, seg_idx, (end_ms - 700)::bigint as end_ms from segments)
    select episode_id, seg_idx, end_ms, coalesce((select arg_min(t_ms, (abs(t_ms - p.end_ms), t_ms)) from marks m where m.episode_id = p.episode_id and abs(t_ms - p.end_ms) <= 900), end_ms) as snapped_ms from p""")
def b10(spark, d):
    return joins.snap_nearest(points(spark, d), marks(spark, d), 900)


@query("b11_lexicon_match", f"""with {LEXICON_SQL}, t as (select distinct doc_id, unnest({DOC_WORDS}) as term from documents)
    select doc_id, lexicon, count(*) as n_terms, round(sum(weight), 6) as score from t join lexicon using (term) group by 1, 2""")
def b11(spark, d):
    return joins.lexicon_match(docs(spark, d), lexicon(spark), "doc_id")


@query("b11_substring_lexicon", """select doc_id, 'sub' as lexicon, (contains(t, 'tion')::int + contains(t, '@mail')::int + regexp_matches(t, '[0-9]{4}')::int)::bigint as n_terms,
    round(contains(t, 'tion')::int * 0.5 + contains(t, '@mail')::int * 1.0 + regexp_matches(t, '[0-9]{4}')::int * 2.0, 6)::double as score
    from (select doc_id, lower(coalesce(text, '')) as t from documents) where contains(t, 'tion') or contains(t, '@mail') or regexp_matches(t, '[0-9]{4}')""")
def b11s(spark, d):
    terms = [("sub", "tion", "substring", 0.5), ("sub", "@mail", "substring", 1.0), ("sub", "[0-9]{4}", "regex", 2.0)]
    return joins.lexicon_match(docs(spark, d), spark.createDataFrame(terms, "lexicon string, term string, match_mode string, weight double"), "doc_id")


TREND_TERMS = (("global", "the", 0.8, "2024-01-01"), ("global", "que", 0.5, "2024-01-05"), ("de", "der", 0.9, "2024-01-03"), ("fr", "les", 0.7, "2024-01-02"), ("fr", "de la", 0.4, "2024-01-06"))
TREND_SQL = "terms(category, term, weight, since) as (values " + ", ".join(f"('{a}', '{b}', {w}::double, timestamp '{s}')" for a, b, w, s in TREND_TERMS) + ")"


def trend_terms(spark):
    rows = [(a, b, w, s) for a, b, w, s in TREND_TERMS]
    return spark.createDataFrame(rows, "category string, term string, weight double, since string").select("category", "term", "weight", F.array().cast("array<string>").alias("aliases"), F.to_timestamp("since").alias("decay_start"))


TREND_HITS = f"""{TREND_SQL}, t as (select doc_id, ' ' || array_to_string({DOC_WORDS}, ' ') || ' ' as t from documents), hits as (select doc_id, category, term, weight, since from t join terms on contains(t, ' ' || term || ' '))"""


@query("b12_trend_hits", f"with {TREND_HITS} select doc_id, category, term, weight from hits")
def b12(spark, d):
    return joins.trend_hits(docs(spark, d), trend_terms(spark), "doc_id")


@query("b13_emotion_hits", f"""with {LEXICON_SQL}, t as (select doc_id, list_slice({DOC_WORDS}, 1, 300) as ws from documents), u as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos from t),
    n as (select *, coalesce(max((term in ({", ".join("'" + S.quoted(x) + "'" for x in joins.NEGATIONS)}))::int) over (partition by doc_id order by pos rows between 3 preceding and 1 preceding), 0) as neg from u)
    select doc_id, lexicon as family, round(sum(case when neg = 1 then -least(abs(weight), 1.5) else least(abs(weight), 1.5) end), 6) as score, count(*) as n from n join lexicon using (term) where abs(weight) >= 0.2 group by 1, 2""")
def b13(spark, d):
    return joins.emotion_hits(docs(spark, d), lexicon(spark), "doc_id")


@query("b15_remove_flagged", "select doc_id, source from documents where not regexp_matches(lower(coalesce(text, '')), '\\b(?:https?://|www\\.)?[a-z0-9-]+\\.(?:com|net|org|io|co)\\b')")
def b15(spark, d):
    rows = docs(spark, d)
    flagged = rows.where(F.lower("text").rlike(features.DOMAIN)).select("doc_id")
    return joins.remove_flagged(rows.select("doc_id", "source"), flagged, "doc_id")


@query("b16_interval_pairs", f"""with {S.CLIPS} select k.episode_id, k.clip_id as a, o.clip_id as b, round({S.iou()}, 6) as iou from clips k join clips o on k.episode_id = o.episode_id and k.clip_id < o.clip_id
    and k.start_ms < o.end_ms and k.end_ms > o.start_ms where {S.iou()} >= 0.3""")
def b16(spark, d):
    return joins.interval_pairs(clips(spark, d), 0.3).withColumn("iou", F.round("iou", 6))


@query("b17_jaccard_pairs", f"""with {S.SEGMENTS}, s as (select episode_id, seg_idx, list_distinct(string_split_regex(lower(trim(text)), '\\s+')) as ws from segments)
    select a.episode_id, a.seg_idx as a, b.seg_idx as b, round(len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws))), 6) as similarity from s a join s b on a.episode_id = b.episode_id and a.seg_idx < b.seg_idx
    where len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.25""")
def b17(spark, d):
    return joins.jaccard_pairs(segments(spark, d), "seg_idx", "episode_id", 0.25).withColumn("similarity", F.round("similarity", 6))


VECTORS = "e as (select vec_id, label, embedding::double[] as x from embeddings)"


def all_pairs(least: float) -> str:
    return f"""with {VECTORS} select a.label, a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.x, b.x), 6) as similarity
    from e a join e b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.x, b.x) >= {least}"""


@query("b18_cosine_pairs_low", all_pairs(0.35))
def b18_low(spark, d):
    return joins.cosine_pairs(T.read(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.35).withColumn("similarity", F.round("similarity", 6))


@query("b18_cosine_pairs", all_pairs(0.92))
def b18(spark, d):
    return joins.cosine_pairs(T.read(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.92).withColumn("similarity", F.round("similarity", 6))


# --- sequence ----------------------------------------------------------------------------------------------------


@query("c01_distribute_punct", f"""with {S.WORDS}, l as (select episode_id, seg_idx, max(word_idx) as last from words group by 1, 2)
    select w.episode_id, w.word_idx, case when w.word_idx = l.last and not regexp_matches(w.w, '[.!?,;:]$') then regexp_extract(rtrim(s.text), '([.!?,;:]+)$', 1) else '' end as after
    from words w join l using (episode_id, seg_idx) join segments s using (episode_id, seg_idx)""")
def c01(spark, d):
    return sequence.distribute_punct(words(spark, d), segments(spark, d)).select("episode_id", "word_idx", "after")


SPANS = f"""{S.WORDS}, e as (select *, regexp_matches(w, '[.!?]$') or coalesce(start_ms - lag(end_ms) over (partition by episode_id order by word_idx) >= 400, false) as ended from words),
    i as (select *, sum(coalesce(b, false)::int) over (partition by episode_id order by word_idx rows unbounded preceding) as span_idx from (select *, lag(ended) over (partition by episode_id order by word_idx) as b from e)),
    spans as (select episode_id, span_idx::bigint as span_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(w, ' ' order by word_idx) as text, count(*) as n_words from i group by 1, 2)"""


@query("c02_sentence_spans", f"with {SPANS} select * from spans")
def c02(spark, d):
    return sequence.sentence_spans(words(spark, d))


@query("c05_eos_from_words", f"""with {S.WORDS}, g as (select *, lead(start_ms) over (partition by episode_id order by word_idx) - end_ms as gap from words),
    s as (select episode_id, quantile_cont(gap, 0.5) as mid, stddev_samp(gap) as dev from g where gap > 0 group by 1),
    n as (select episode_id, quantile_cont(gap, 0.5) as near from g join s using (episode_id) where gap > 0 and abs(gap - mid) <= dev group by 1),
    l as (select episode_id, greatest(280.0, mid + coalesce(near, mid)) as lim from s left join n using (episode_id))
    select distinct episode_id, end_ms as t_ms, 'words' as source from g left join l using (episode_id) where gap is not null and (regexp_matches(w, '[.!?…]$') or gap >= coalesce(lim, 280.0) or lower(w) in ('right?', 'you know?'))""")
def c05(spark, d):
    return sequence.eos_from_words(words(spark, d))


@query("c06_eos_strong_weak", f"""with {S.WORDS}, g as (select *, lead(w) over o as nw, lead(start_ms) over o - end_ms as gap from words window o as (partition by episode_id order by word_idx)),
    k as (select episode_id, end_ms as t_ms, case when regexp_matches(w, '[.!?]$') and (nw is null or regexp_matches(nw, '^\\p{{Lu}}')) then 'strong' when regexp_matches(w, '[,;:]$') and gap > 500 then 'weak' end as source from g)
    select * from k where source is not null""")
def c06(spark, d):
    return sequence.eos_strong_weak(words(spark, d))


@query("c07_eos_from_text", f"""with {S.SEGMENTS}, c as (select episode_id, start_ms, end_ms, length(text) as n, unnest(range(length(text))) as pos, unnest(string_split(text, '')) as c from segments)
    select distinct episode_id, t_ms, 'text' as source from (select episode_id, (start_ms + floor((end_ms - start_ms) * pos / greatest(n, 1)::double))::bigint as t_ms from c where c in ('.', '!', '?') union all select episode_id, end_ms from segments where end_ms > 0)""")
def c07(spark, d):
    return sequence.eos_from_text(segments(spark, d))


@query("c08_eos_from_gaps", f"""with {S.SEGMENTS} , g as (select episode_id, end_ms, lead(start_ms) over o - end_ms as gap, coalesce(sum(n_words) over (partition by episode_id order by seg_idx rows between 1 following and unbounded following), 0) as after from segments window o as (partition by episode_id order by seg_idx))
    select episode_id, end_ms::bigint as t_ms, 'gaps' as source from g where gap >= 300 and after >= 8""")
def c08(spark, d):
    return sequence.eos_from_gaps(segments(spark, d))


@query("c09_unify_marks")
def c09(spark, d):
    return sequence.unify_marks(sequence.eos_from_text(segments(spark, d)), sequence.eos_from_words(words(spark, d)))


@query("c10_eos_index")
def c10(spark, d):
    return sequence.eos_index(words(spark, d), segments(spark, d))


@query("c11_eos_density", f"""with {S.WORDS}, {MARKS}, s as (select episode_id, count(*) as n_words, max(end_ms) as e, min(start_ms) as b from words group by 1), m as (select episode_id, count(*) as n_marks from marks group by 1)
    select *, per_minute < 6 as fallback from (select episode_id, n_words, coalesce(n_marks, 0) as n_marks, round(coalesce(n_marks, 0) / greatest((e - b) / 60000.0, 1.0)::double, 6) as per_minute from s left join m using (episode_id))""")
def c11(spark, d):
    return sequence.eos_density(words(spark, d), marks(spark, d))


@query("c12_natural_boundaries")
def c12(spark, d):
    return sequence.natural_boundaries(segments(spark, d).select((F.col("episode_id") * 1000 + F.col("seg_idx")).alias("episode_id"), "text"))


@query("c13_topic_segments", f"""with {S.SEGMENTS}, i as (select *, sum(coalesce(b, false)::int) over (partition by episode_id order by seg_idx rows unbounded preceding) as topic from (select *, ({" or ".join(f"starts_with(trim(lower(text)), '{m} ')" for m in ("the", "in", "an"))}) as b from segments))
    select * from (select episode_id, topic::bigint as topic, min(start_ms)::bigint as start_ms, max(end_ms)::bigint as end_ms, string_agg(text, ' ' order by seg_idx) as text from i group by 1, 2) where end_ms - start_ms between 8000 and 90000""")
def c13(spark, d):
    return sequence.topic_segments(segments(spark, d), ("the", "in", "an"))


@query("c14_dynamic_segments")
def c14(spark, d):
    return sequence.dynamic_segments(segments(spark, d))


@query("c15_merge_seeds")
def c15(spark, d):
    return sequence.merge_short_seeds(segments(spark, d), gap_ms=700)


@query("c17_multiscale_windows", f"""with {S.SEGMENTS}, t as (select episode_id, max(end_ms) as total from segments group by 1), b(band, size, step) as (values {", ".join(f"({i}, {(x + y) // 2}, {(x + y) // 2 * p // 100})" for i, (x, y, p) in enumerate(sequence.BANDS))})
    select episode_id, band, start_ms::bigint as start_ms, (start_ms + size)::bigint as end_ms from (select episode_id, band, size, unnest(range(0, total - size + 1, step)) as start_ms from t, b where total >= size)""")
def c17(spark, d):
    return sequence.multiscale_windows(segments(spark, d))


@query("c19_content_filter", f"""with {S.SEGMENTS}, w as (select *, string_split_regex(lower(trim(text)), '\\s+') as v from segments), m as (select episode_id, seg_idx, max(c) as most from (select episode_id, seg_idx, x, count(*) as c from (select episode_id, seg_idx, unnest(v) as x from w) group by 1, 2, 3) group by 1, 2)
    select w.episode_id, w.seg_idx from w join m using (episode_id, seg_idx) where not (len(v) >= 10 and (most > len(v) * 0.5 or len(list_distinct(v)) < len(v) * 0.3))""")
def c19(spark, d):
    return sequence.content_filter(segments(spark, d)).select("episode_id", "seg_idx")


@query("c20_keep_caps", f"with {S.SEGMENTS} select episode_id, seg_idx from segments where len(string_split_regex(trim(text), '\\s+')) between 5 and 100 and end_ms - start_ms between 8000 and 60000")
def c20(spark, d):
    return sequence.keep_caps(segments(spark, d)).select("episode_id", "seg_idx")


@query("c24_hop_features", f"""with {S.WORDS}, h as (select episode_id, w, unnest(range(greatest(ceil((start_ms - 2000) / 500.0), 0)::bigint, floor((start_ms + 2000) / 500.0)::bigint + 1)) as hop from words), l as (select episode_id, floor(max(end_ms) / 500.0)::bigint as last from words group by 1),
    c as (select episode_id, hop, count(*) as n, sum(length(w)) as chars, sum({S.count("w", "!")}) as shouts, sum({S.count("w", "?")}) as asks, sum(len(regexp_extract_all(w, '[0-9]+'))) as numbers, sum(len(regexp_extract_all(w, '\\p{{Lu}}'))) as caps from h join l using (episode_id) where hop <= last group by 1, 2)
    select episode_id, hop, round(least(1.0, asks * 0.15)::double, 6) as hook, round(least(1.0, shouts * 0.2 + caps / greatest(chars + n - 1, 1)::double * 0.1)::double, 6) as arousal, round(least(1.0, numbers * 0.05)::double, 6) as payoff, round(least(1.0, (n / 20.0) * (chars / n::double / 5))::double, 6) as info from c""")
def c24(spark, d):
    rows = sequence.hop_features(words(spark, d))
    return rows.select("episode_id", "hop", *(F.round(c, 6).alias(c) for c in ("hook", "arousal", "payoff", "info")))


@query("c32_extend_end", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, {MARKS}, n as (select episode_id, clip_id, start_ms, end_ms - 700 as e, (select min(t_ms) from marks m where m.episode_id = c.episode_id and t_ms >= c.end_ms - 700) as nx from clips c)
    select episode_id, clip_id, start_ms, (case when nx - e <= 5000 and nx - start_ms <= 60000 then nx else e end)::bigint as end_ms, (case when nx - e <= 5000 and nx - start_ms <= 60000 then nx - e else 0 end)::bigint as moved_ms from n""")
def c32(spark, d):
    c = clips(spark, d).select("episode_id", "clip_id", "start_ms", (F.col("end_ms") - 700).alias("end_ms"))
    return sequence.extend_end(c, marks(spark, d), 5_000, 60_000)


@query("c33_finish", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, {MARKS}, n as (select episode_id, clip_id, text, end_ms - 700 as e, (select min(t_ms) from marks m where m.episode_id = c.episode_id and t_ms >= c.end_ms - 700) as nx,
        (select max(t_ms) from marks m where m.episode_id = c.episode_id and t_ms < c.end_ms - 700) as pv from clips c), g as (select *, least(coalesce(nx - e, 1000000000), coalesce(e - pv, 1000000000)) as gap from n)
    select episode_id, clip_id, (case when gap > 300 and nx - e <= 800 then nx else e end)::bigint as end_ms, case when gap <= 300 or nx - e <= 800 then 'finished' when regexp_matches(rtrim(text), '[.!?]$') then 'finished' else 'unresolved' end as status from g""")
def c33(spark, d):
    c = clips(spark, d).select("episode_id", "clip_id", "text", (F.col("end_ms") - 700).alias("end_ms"))
    return sequence.finish_normalize(c, marks(spark, d)).select("episode_id", "clip_id", "end_ms", "status")


@query("c34_length_variants", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, {MARKS}, t(target) as (values {", ".join(f"({t}::bigint)" for t in sequence.TARGETS)})
    select c.episode_id, clip_id, start_ms, target, arg_min(t_ms, (abs(t_ms - start_ms - target), t_ms)) as end_ms from clips c, t, marks m where m.episode_id = c.episode_id and t_ms between start_ms + target - 2000 and start_ms + target + 2000 group by 1, 2, 3, 4""")
def c34(spark, d):
    return sequence.length_variants(clips(spark, d), marks(spark, d))


@query("c37_moments", f"""with {S.SEGMENTS}, k as (select episode_id, seg_idx, start_ms, text, lead(end_ms, 0) over o as e0, lead(end_ms, 1) over o as e1, lead(end_ms, 2) over o as e2, lead(text, 1) over o as t1, lead(text, 2) over o as t2, end_ms from segments window o as (partition by episode_id order by seg_idx)),
    m as (select *, 'number' as kind from k where regexp_matches(lower(text), '[0-9]') union all select *, 'the' from k where regexp_matches(lower(text), '^the\\b')),
    x as (select episode_id, seg_idx, kind, start_ms, end_ms as e, 0 as g, text as t from m union all select episode_id, seg_idx, kind, start_ms, e1, 1, t1 from m union all select episode_id, seg_idx, kind, start_ms, e2, 2, t2 from m)
    select episode_id, seg_idx, kind, start_ms::bigint as start_ms, arg_min(e, r)::bigint as end_ms, arg_min(g + 1, r)::bigint as n_segments from (select *, ((not coalesce(regexp_matches(t, '[.!?]$'), false))::int, g) as r from x where e - start_ms between 8000 and 60000) group by 1, 2, 3, 4""")
def c37(spark, d):
    return sequence.find_moments(segments(spark, d), {"number": "[0-9]", "the": r"^the\b"}, grow=2)


@query("c38_trim_fillers", f"""with {S.WORDS}, {S.CLIPS[len(S.SEGMENTS) + 2:]}, f as (select c.episode_id, c.clip_id, min(w.start_ms) as f from clips c join words w on w.episode_id = c.episode_id and w.start_ms between c.start_ms and c.start_ms + 2000 where lower(regexp_replace(w.w, '[^\\p{{L}}]', '', 'g')) not in ('the', 'and', 'de', 'la') group by 1, 2)
    select c.episode_id, c.clip_id, coalesce(f, c.start_ms) as start_ms, c.end_ms from clips c left join f using (episode_id, clip_id)""")
def c38(spark, d):
    return sequence.trim_fillers(clips(spark, d).select("episode_id", "clip_id", "start_ms", "end_ms"), words(spark, d), ("the", "and", "de", "la"))


# --- features ----------------------------------------------------------------------------------------------------

WS = S.tokens("text")


@query("d01_text_basics", f"""select doc_id, len({WS})::bigint as word_count, len(regexp_extract_all(text, '[.!?]+'))::bigint as sentence_count, regexp_matches(rtrim(text), '[.!?]$') as ends_sentence,
    len(list_filter({WS}, lambda w: regexp_matches(w, '^[A-Z]{{2,}}$')))::bigint as caps_words, len(regexp_extract_all(text, '[0-9]'))::bigint as digits, {S.count("text", "!")}::bigint as shouts, {S.count("text", "?")}::bigint as asks,
    case when len({WS}) > 0 then round(list_sum(list_transform({WS}, lambda w: length(w))) / len({WS})::double, 6) else 0.0 end as mean_word from (select doc_id, coalesce(text, '') as text from documents)""")
def d01(spark, d):
    return docs(spark, d).select("doc_id", *(c.alias(n) for n, c in features.basics(F.col("text")).items()))


HOOK_V4 = f"""least(1.0, (regexp_matches(t, '\\b(most|many|people|everyone|they)\\s+(think|say|assume)\\b') and regexp_matches(t, '\\bbut\\s+actually\\b|\\bhowever\\b|\\bbut\\s+(it|this)\\s+isn''?t\\b'))::int * 0.15
    + len(list_filter(['you', 'imagine', 'what if', 'did you know', 'here''s why', 'the secret', 'shocking', 'amazing', 'incredible', 'unbelievable', 'mind-blowing', 'here''s what', 'the truth is', 'the key', 'the trick', 'the secret', 'what happens when', 'why do', 'how did', 'here''s how'], lambda p: contains(t, p))) * 0.15
    + contains(text, '?')::int * 0.25 + (case when n < 8 then 0.2 when n < 15 then 0.1 else 0.0 end) + least({S.count("text", "!")} * 0.1, 0.3) + regexp_matches(text, '[0-9]')::int * 0.1 + regexp_matches(t, 'vs|versus|more than|less than|better than|worse than')::int * 0.1)"""
SEG_TEXT = f"{S.SEGMENTS}, x as (select episode_id, seg_idx, text, lower(text) as t, (end_ms - start_ms) / 1000.0 as s, len({WS}) as n from segments)"


@query("d02_hook_v4", f"with {SEG_TEXT} select episode_id, seg_idx, round(({HOOK_V4})::double, 6) as hook_v4 from x")
def d02(spark, d):
    return segments(spark, d).select("episode_id", "seg_idx", F.round(features.hook_v4(F.col("text")), 6).alias("hook_v4"))


@query("d07_prerank_proxies", f"with {SEG_TEXT} select episode_id, seg_idx, round({S.prerank('text', 's', 'n')}, 6)::double as prerank from x")
def d07(spark, d):
    return segments(spark, d).select("episode_id", "seg_idx", F.round(features.prerank_score(F.col("text"), features.seconds()), 6).alias("prerank"))


INFO = rf"""case when length(trim(text)) < 8 then 0.1 else greatest(0.1, least(1.0, least(0.3, n * 0.012) - least({S.hits("t", features.FILLERS)} * 0.08, 0.4) + least(len(regexp_extract_all(text, '\b\d+\b|[\$\d,]+|\d+%|\d+\.\d+')) * 0.15
    + len(list_filter({WS}, lambda w: regexp_matches(w, '^\p{{Lu}}') and length(w) > 2)) * 0.12, 0.6))) end"""


@query("d11_info_density", f"select doc_id, round(({INFO})::double, 6) as info_density from (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as t, len({S.tokens('coalesce(text, $$$$)')}) as n from documents)")
def d11(spark, d):
    return docs(spark, d).select("doc_id", F.round(features.info_density(F.col("text")), 6).alias("info_density"))


@query("d14_emotion", f"with {SEG_TEXT} select episode_id, seg_idx, round(least(1.0, ({S.hits('t', features.STRONG_EMOTIONS)} * 2 + {S.hits('t', features.EMOTIONS)}) / 5.0)::double, 6) as emotion from x")
def d14(spark, d):
    return segments(spark, d).select("episode_id", "seg_idx", F.round(features.emotion(F.col("text")), 6).alias("emotion"))


@query("d20_repetition", """with r as (select doc_id, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 200)), '[a-z'']+') as w from documents)
    select doc_id, round(case when len(w) > 0 then 1 - len(list_distinct(w)) / len(w)::double else 0.0 end, 6) as repetition from r""")
def d20(spark, d):
    return docs(spark, d).select("doc_id", F.round(features.repetition_ratio(F.col("text")), 6).alias("repetition"))


AD = rf"""with x as (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as t from documents), m as (select doc_id, max(c) as rep from (select doc_id, w, count(*) as c from (select doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda v: regexp_full_match(v, '[A-Z][a-zA-Z]{{2,}}'))) as w from x) group by 1, 2) group by 1),
    s as (select x.doc_id, least(1.0, regexp_matches(t, '{features.DOMAIN}')::int * 0.45 + regexp_matches(regexp_replace(t, '[^\x00-\x7F]', '_', 'g'), '\b(?:[a-z](?:\s*-\s*|\.?\s*)){{3,}}[a-z]\s*(?:dot|\.)\s*(?:com|net|org|io|co)\b')::int * 0.45 + {S.any_of("t", features.AD_PHRASES)}::int * 0.25 + ({S.hits("t", features.AD_CALLS)} >= 2)::int * 0.15
    + case when rep >= 3 then 0.20 when rep = 2 then 0.10 else 0.0 end)::double as v from x left join m using (doc_id))"""


@query("d21_ad_likelihood", f"{AD} select doc_id, round(v, 6) as ad_likelihood, v >= 0.5 as ad_flag from s")
def d21(spark, d):
    v = features.ad_likelihood(F.col("text"))
    return docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", F.round("v", 6).alias("ad_likelihood"), (F.col("v") >= 0.5).alias("ad_flag"))


@query("d22_ad_like", rf"""with x as (select doc_id, trim(lower(coalesce(text, ''))) as t from documents) select doc_id, (case when {S.any_of("t", features.LIKE_PHRASES)} then 0.8 when regexp_matches(t, '{S.quoted(features.PHONE)}') or regexp_matches(t, '{S.quoted(features.LINK)}') then 0.6 else 0.0 end)::double as ad_like from x""")
def d22(spark, d):
    return docs(spark, d).select("doc_id", features.ad_like_score(F.col("text")).cast("double").alias("ad_like"))


@query("d23_platform_length", f"""with {SEG_TEXT}, y as (select episode_id, seg_idx, s, ({INFO})::double as i from x) select episode_id, seg_idx, round(greatest(0.0, least(1.0, 0.65 * greatest(0.0, 1 - pow(abs(s - 22) / greatest(6.0, 12.0 - 4.0 * i), 2)) + 0.35 * i))::double, 6) as platform_length from y""")
def d23(spark, d):
    text = F.col("text")
    return segments(spark, d).select("episode_id", "seg_idx", F.round(features.platform_length(features.seconds(), features.info_density(text), "tiktok"), 6).alias("platform_length"))


@query("d24_finish_flags", r"""select doc_id, regexp_matches(x, '[.!?…]$') as terminal, regexp_matches(lower(x), '\b(and|but|so|because|or|the|a|to|of|with|that)$') as unfinished_tail, regexp_matches(lower(x), '^(and|but|so|because|which)\b') as continues
    from (select doc_id, rtrim(coalesce(text, '')) as x from documents)""")
def d24(spark, d):
    flags = features.finish_flags(F.col("text"))
    return docs(spark, d).select("doc_id", *(flags[n].alias(n) for n in ("terminal", "unfinished_tail", "continues")))


@query("d28_safety", "select doc_id, round(least((contains(t, 'idiot')::int + contains(t, 'stupid')::int + contains(t, 'moron')::int) * 0.1, 0.3)::double, 6) as penalty from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def d28(spark, d):
    return docs(spark, d).select("doc_id", F.round(features.safety_penalty(F.col("text"), ("idiot", "stupid", "moron")), 6).alias("penalty"))


@query("d33_categories", f"""with {LEXICON_SQL}, t as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}'']+')) as term from documents), c as (select doc_id, lexicon, count(*) as n from t join lexicon using (term) group by 1, 2),
    r as (select *, row_number() over (partition by doc_id order by n desc, lexicon) as r from c) select d.doc_id, coalesce(string_agg(lexicon, ',' order by r), 'general') as categories from (select distinct doc_id from documents) d left join (select * from r where r <= 2) r using (doc_id) group by 1""")
def d33(spark, d):
    return features.categories(docs(spark, d), lexicon(spark), "doc_id").select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("d_segment_features")
def d_all(spark, d):
    return features.segment_features(segments(spark, d).select("episode_id", "seg_idx", "start_ms", "end_ms", "text"))


# --- scores ------------------------------------------------------------------------------------------------------


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the feature columns that the scores take."""
    rows = features.segment_features(segments(spark, d).select("episode_id", "seg_idx", "start_ms", "end_ms", "text"))
    return rows.withColumnsRenamed({"hook_v4": "hook", "ad_likelihood": "ad_penalty"}).withColumn("question", F.col("q_list"))


@query("e03_score_v4")
def e03(spark, d):
    return scores.score_v4(scored(spark, d)).select("episode_id", "seg_idx", "winning_path", "base_score", "final_score", "score_100")


@query("e05_detect_genre", f"""with {LEXICON_SQL}, t as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}'']+')) as term from documents), c as (select doc_id, lexicon as genre, count(*) as n from t join lexicon using (term) group by 1, 2),
    r as (select doc_id, arg_min(genre, (-n, genre)) as g, max(n) as b, coalesce(list_sort(list(n), 'DESC')[2], 0) as s from c group by 1)
    select d.doc_id, case when coalesce(b, 0) >= 2 then g else 'general' end as genre, (case when coalesce(b, 0) >= 2 then b else 0 end)::bigint as hits, case when coalesce(b, 0) >= 2 then round((b - s) / b::double, 6) else 0.0 end as confidence from documents d left join r using (doc_id)""")
def e05(spark, d):
    return scores.detect_genre(docs(spark, d), lexicon(spark), "doc_id")


@query("e09_calibrations", f"""with {S.CLIPS} select clip_id, round((case when x < 0.2 then x * 0.8 when x < 0.5 then 0.16 + (x - 0.2) * 0.9 when x < 0.8 then 0.43 + (x - 0.5) * 0.8 else 0.67 + (x - 0.8) * 0.6 end)::double, 9) as cal, floor(45 + 55 * x + 0.5)::bigint as band,
    case when p >= 90 then 'A+' when p >= 80 then 'A' when p >= 70 then 'B' when p >= 60 then 'C' when p >= 50 then 'D' else 'F' end as grade from (select clip_id, final_score as x, final_score * 100 as p from clips)""")
def e09(spark, d):
    x = F.col("final_score")
    return clips(spark, d).select("clip_id", F.round(scores.calibrate_piecewise(x), 9).alias("cal"), scores.ui_band(x).alias("band"), scores.grade(x * 100).alias("grade"))


@query("e12_platforms", f"""with {S.CLIPS}, b(lo, hi, p) as (values {", ".join(f"({a}, {b}, {list(p)})" for a, b, p in scores.PLATFORM_BANDS)}), x as (select clip_id, unnest(p) as platform, unnest(range(len(p))) as pos from clips join b on (end_ms - start_ms) / 1000.0 >= lo and (end_ms - start_ms) / 1000.0 < hi)
    select clip_id, platform, round((1.0 - 0.2 * pos)::double, 6) as fit, row_number() over (partition by clip_id order by 1.0 - 0.2 * pos desc, platform) as rank from x""")
def e12(spark, d):
    return scores.recommend_platforms(clips(spark, d))


@query("e13_trend_score", f"""with {TREND_HITS}, c as (select doc_id, category, least(sum(weight * exp(-ln(2.0) * greatest(epoch(timestamp '2024-01-31' - since) / 86400.0, 0) / 7.0)), 1.0) as s from hits group by 1, 2),
    w as (select doc_id, max(case when category = 'global' then s end) as g, max(case when category <> 'global' then s end) as c from c group by 1) select doc_id, round(least(1.0, 0.4 * coalesce(g, 0) + 0.6 * coalesce(c, 0))::double, 6) as trend from documents left join w using (doc_id)""")
def e13(spark, d):
    rows = docs(spark, d)
    hits = joins.trend_hits(rows, trend_terms(spark), "doc_id").join(trend_terms(spark).select("category", "term", "decay_start"), ["category", "term"])
    return scores.trend_score(hits, rows, "doc_id", F.to_timestamp(F.lit("2024-01-31")))


@query("e14_what_if")
def e14(spark, d):
    sets = [("a", "hook", 0.5), ("a", "payoff", 0.5), ("b", "info_density", 0.7), ("b", "arousal", 0.3)]
    rows = scored(spark, d).withColumn("seg", F.concat_ws(":", "episode_id", "seg_idx"))
    return scores.what_if(rows, spark.createDataFrame(sets, "set_id string, feature string, weight double"), "seg")


# --- statistics --------------------------------------------------------------------------------------------------


@query("f01_znorm", f"""with {S.CLIPS}, w as (select clip_id, final_score as x, avg(final_score) over p as m, coalesce(stddev_samp(final_score) over p, 0) as s, min(final_score) over p as lo, max(final_score) over p as hi from clips window p as (partition by episode_id))
    select clip_id, round(case when s > 1e-6 then 1 / (1 + exp(-2 * (x - m) / s)) when hi - lo < 1e-6 then 0.5 else (x - lo) / (hi - lo) end, 6) as norm from w""")
def f01(spark, d):
    return stats.znorm(clips(spark, d), "episode_id").select("clip_id", "norm")


@query("f03_band_norm", f"""with {S.CLIPS}, b as (select *, case when end_ms - start_ms < 12500 then 0 when end_ms - start_ms < 18500 then 1 when end_ms - start_ms < 24500 then 2 when end_ms - start_ms < 30500 then 3 when end_ms - start_ms < 60000 then 4 else 5 end as band from clips),
    s as (select band, list_sort(list(final_score * 100)) as v from b group by 1), q as (select band, v[len(v) * 2 // 4 + 1] as mid, greatest(v[len(v) * 3 // 4 + 1] - v[len(v) // 4 + 1], 1e-6) as iqr from s)
    select clip_id, band, round(greatest(0.05, least(1.0, (final_score * 100 - (mid - iqr)) / (2 * iqr))), 6) as band_score from b join q using (band)""")
def f03(spark, d):
    return stats.band_norm(clips(spark, d), []).select("clip_id", "band", "band_score")


@query("f04_calibrate", f"""with {S.CLIPS}, s as (select quantile_cont(final_score, 0.5) as c, (quantile_cont(final_score, 0.75) - quantile_cont(final_score, 0.25)) / 1.349 as d from clips)
    select clip_id, round(1 / (1 + exp(-(case when d > 1e-9 then (final_score - c) / d else 0 end))), 6) as cal from clips, s""")
def f04(spark, d):
    return stats.calibrate(clips(spark, d), "final_score", "median").select("clip_id", F.col("final_score_cal").alias("cal"))


@query("f06_percentile_gate", f"""with {S.CLIPS}, r as (
        select episode_id, clip_id, final_score, start_ms, end_ms, case when end_ms - start_ms < 14000 then 'micro' when end_ms - start_ms <= 28000 then 'normal' else 'long' end as size from clips
    ), n as (
        select *, count(*) over (partition by episode_id, size) as n, row_number() over (partition by episode_id, size order by final_score desc, clip_id) as place,
            row_number() over (partition by episode_id order by final_score desc, clip_id) as best, max(end_ms) over (partition by episode_id) - min(start_ms) over (partition by episode_id) > 1500000 as long_episode
        from r
    ), c as (
        select episode_id, size, quantile_cont(final_score, 0.7) as p70, quantile_cont(final_score, 0.6) as p60, quantile_cont(final_score, 0.55) as p55
        from n where n <= 10 or place > greatest(1, floor(n * 0.1)) group by 1, 2
    )
    select n.episode_id, n.clip_id, n.size, n.final_score from n left join c on c.episode_id = n.episode_id and c.size = n.size
    where best <= 3 or (n.size <> 'long' and final_score >= least(case when n.size = 'micro' then p70 when long_episode then p55 else p60 end, 0.8) - 1e-12)""")
def f06(spark, d):
    return stats.percentile_gate(clips(spark, d), "episode_id").select("episode_id", "clip_id", "size", "final_score")


@query("f07_quality_floor", f"""with {S.CLIPS}, r as (select episode_id, clip_id, final_score, row_number() over (partition by episode_id order by final_score desc, clip_id) as place from clips) select episode_id, clip_id, final_score, place from r where final_score >= 0.3 - 0.04 or place <= 4""")
def f07(spark, d):
    return stats.quality_floor(clips(spark, d), "episode_id", 0.3).select("episode_id", "clip_id", "final_score", F.col("place").cast("long").alias("place"))


TERMS = f"t as (select doc_id, unnest({DOC_WORDS}) as term from documents), c as (select doc_id, term, count(*) as n from t group by 1, 2)"


@query("f08_tfidf", f"""with {TERMS}, s as (select doc_id, sum(n) as size from c group by 1), f as (select term, count(*) as df from c group by 1), n as (select count(*) as total from documents)
    select doc_id, term, round(n / size::double * (ln((total + 1) / (1 + df)::double) + 1), 6) as tfidf from c join s using (doc_id) join f using (term), n""")
def f08(spark, d):
    return stats.tfidf(docs(spark, d), "doc_id")


@query("f10_top_keywords", """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}0-9'']+') as ws from documents), t as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as pos from w),
    g as (select doc_id, lower(w) as term, count(*) as n, max((regexp_matches(w, '^\\p{Lu}') and pos > 0)::int) as cap, min(pos) as pos from t where length(lower(w)) >= 3 group by 1, 2),
    s as (select doc_id, term, pos, round(n + 5 * cap + 3 * regexp_matches(term, '[0-9]')::int + 0.1::double * length(term), 6) as score from g), r as (select *, row_number() over (partition by doc_id order by score desc, pos, term) as rank from s)
    select doc_id, rank, term, score from r where rank <= 10""")
def f10(spark, d):
    return stats.top_keywords(docs(spark, d), "doc_id")


@query("f11_bigrams", f"""with w as (select {DOC_WORDS} as ws from documents), g as (select unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as ngram from w where len(ws) >= 2)
    select ngram, count(*) as n from g group by 1 having count(*) >= 5""")
def f11(spark, d):
    return stats.ngrams(docs(spark, d), 2, least=5)


@query("f12_trends", f"""with t as (select source as category, unnest({DOC_WORDS}) as term from documents), c as (select category, term, count(*) as n from t where length(term) >= 3 group by 1, 2), g as (select * from c union all select 'global', term, count(*) from c group by term),
    r as (select *, row_number() over (partition by category order by n desc, term) as r from g) select category, term, n, round(least(1.0, 0.25 + 0.05 * n)::double, 3) as weight from r where r <= 150""")
def f12(spark, d):
    return stats.build_trends(docs(spark, d).select(F.col("source").alias("category"), F.col("text").alias("title")))


@query("f13_metric_summary", """select event_type as name, count(*) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(coalesce(stddev_samp(value), 0), 6) as deviation from events
    where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""")
def f13(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("name"), "value", "ts")
    return stats.metric_summary(e, F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20")))


@query("f14_timing_summary", """with r as (select event_type as name, value, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events), a as (select name, list_sort(list(value)) as a, len(list(value)) as n from r where r <= 100 group by 1),
    p as (select *, 0.95::double * (n + 1) as place, least(greatest(floor(0.95::double * (n + 1))::bigint, 1), n - 1) as lo from a)
    select name, n::bigint as n, round(list_sum(a) / n, 6) as mean, round((a[(n + 1) // 2] + a[n // 2 + 1]) / 2, 6) as median, round(case when n >= 20 then a[lo] + (place - lo) * (a[lo + 1] - a[lo]) end, 6) as p95 from p""")
def f14(spark, d):
    return stats.timing_summary(events(spark, d).select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("id")))


@query("f15_error_summary", "select event_type as kind, count(*) as n, arg_min(props, (ts, event_id)) as first_message, arg_max(props, (ts, event_id)) as last_message from events group by rollup (event_type)")
def f15(spark, d):
    return stats.error_summary(events(spark, d).select(F.col("event_type").alias("kind"), F.col("props").alias("message"), "ts", F.col("event_id").alias("id")))


PLANS = (("AUTOMOBILE", 5), ("BUILDING", 10), ("FURNITURE", 3), ("MACHINERY", 8))


@query("f16_usage", f"""with p(plan, lim) as (values {", ".join(f"('{a}', {b}::bigint)" for a, b in PLANS)}), e as (select user_id, count(*) filter (event_type = 'signup') as u, count(*) filter (event_type = 'click') as c from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-28' group by 1)
    select c_custkey as user_id, c_mktsegment as plan, coalesce(u, 0)::bigint as uploads, coalesce(c, 0)::bigint as clips, greatest(lim - coalesce(u, 0), 0)::bigint as remaining, lim is null or greatest(lim - coalesce(u, 0), 0) > 0 as can_upload from customer left join e on user_id = c_custkey left join p on plan = c_mktsegment""")
def f16(spark, d):
    e = events(spark, d).select("user_id", "ts", F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") == "click", "clip").alias("action"))
    users = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"))
    plans = spark.createDataFrame([*PLANS], "plan string, upload_limit long")
    return stats.usage(e, users, plans, F.to_timestamp(F.lit("2024-01-28")))


@query("f17_job_stats", "select o_orderpriority as kind, count(*) filter (o_orderstatus = 'O') as \"O\", count(*) filter (o_orderstatus = 'F') as \"F\", count(*) filter (o_orderstatus = 'P') as \"P\", count(*) as total from orders group by 1")
def f17(spark, d):
    jobs = T.read(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return stats.job_stats(jobs, "kind", ("O", "F", "P"))


@query("f18_storage", "select source as area, count(*) as n_files, sum(strlen(coalesce(text, '')))::bigint as bytes from documents group by 1")
def f18(spark, d):
    return stats.storage(docs(spark, d).select(F.col("source").alias("area"), F.octet_length("text").cast("long").alias("bytes")))


@query("f20_histogram", f"""with {S.CLIPS} select (case when end_ms - start_ms < 12500 then 0 when end_ms - start_ms < 18500 then 1 when end_ms - start_ms < 24500 then 2 when end_ms - start_ms < 30500 then 3 when end_ms - start_ms < 60000 then 4 else 5 end)::bigint as band, count(*) as n from clips group by 1""")
def f20(spark, d):
    return stats.histogram(clips(spark, d))


@query("f21_finish_ratio", f"with {S.CLIPS} select episode_id, count(*) as n, count(*) filter (finished) as n_finished, round(avg(finished::int::double), 6) as ratio from clips group by 1")
def f21(spark, d):
    return stats.finish_ratio(clips(spark, d), "episode_id")


@query("f22_coverage", "select feature, present, (select count(*) from labels) - present as missing, round(present / nullif((select count(*) from labels), 0)::double, 6) as share from (select 'quality' as feature, count(quality) as present from labels union all select 'toxic', count(toxic) from labels union all select 'none', 0)")
def f22(spark, d):
    return stats.coverage(T.read(spark, d, "labels"), ["quality", "toxic", "none"])


@query("f23_rate_gate", f"""with {S.SEGMENTS}, x as (select episode_id, seg_idx, len(regexp_extract_all(lower(text), '\\b(like|so|you know|right)\\b')) / greatest((end_ms - start_ms) / 1000.0, 0.001)::double as f from segments) select episode_id, seg_idx, round(f, 6) as filler_rate from x""")
def f23(spark, d):
    return stats.rate_gate(segments(spark, d).withColumn("payoff_score", F.lit(0.0))).select("episode_id", "seg_idx", "filler_rate")


# --- selection ---------------------------------------------------------------------------------------------------


@query("g01_prerank")
def g01(spark, d):
    return selection.prerank(segments(spark, d), least=3).select("episode_id", "seg_idx", "prerank", "place", "why")


@query("g02_safety_keep")
def g02(spark, d):
    return selection.safety_keep(segments(spark, d)).select("episode_id", "seg_idx")


@query("g03_stratified")
def g03(spark, d):
    return selection.stratified(clips(spark, d), 8).select("episode_id", "clip_id", "place")


@query("g04_select_moments", f"""with recursive {S.CLIPS}, pool as (select episode_id, clip_id, start_ms, end_ms, final_score, list_slice(string_split_regex(lower(trim(text)), '\\s+'), 1, 10) as opening from clips where end_ms - start_ms between 12000 and 30000),
    {S.greedy("final_score desc, clip_id", "abs(k.start_ms - o.start_ms) < 15000 or len(list_intersect(k.opening, o.opening)) > 5", "clip_id, start_ms, end_ms, final_score, opening", 5)}
    select episode_id, k.clip_id as clip_id, k.start_ms as start_ms, k.end_ms as end_ms, k.final_score as final_score, pick from picked""")
def g04(spark, d):
    return selection.select_moments(clips(spark, d), gap_ms=15_000)


@query("g05_rank_clips", f"with {S.CLIPS} select episode_id, clip_id, row_number() over (partition by episode_id order by final_score desc, start_ms, clip_id) as place from clips")
def g05(spark, d):
    return selection.rank_clips(clips(spark, d)).select("episode_id", "clip_id", "place")


@query("g06_mmr")
def g06(spark, d):
    return selection.mmr(clips(spark, d), 3)


@query("g08_duration_mix", f"""with {S.CLIPS}, c as (select *, case when end_ms - start_ms < 15000 then 0 when end_ms - start_ms < 30000 then 1 when end_ms - start_ms < 45000 then 2 else 3 end as k from clips), r as (select *, (row_number() over (partition by episode_id, k order by final_score desc, clip_id) > 1)::int as rest from c),
    p as (select episode_id, clip_id, row_number() over (partition by episode_id order by rest, final_score desc, clip_id) as place from r) select * from p where place <= 6""")
def g08(spark, d):
    return selection.duration_mix(clips(spark, d), 6).select("episode_id", "clip_id", "place")


@query("g13_soft_floor", f"""with {S.CLIPS}, r as (select episode_id, clip_id, row_number() over (partition by episode_id order by (final_score < 0.3)::int, final_score desc, clip_id) as p, final_score >= 0.3 as good from clips) select episode_id, clip_id from r where good or p <= 3""")
def g13(spark, d):
    c = clips(spark, d)
    return selection.soft_floor(c.where("final_score >= 0.3"), c, 3).select("episode_id", "clip_id")


@query("g14_final_order", f"with {S.CLIPS} select episode_id, clip_id, row_number() over (partition by episode_id order by finished desc, abs(end_ms - start_ms - 18000), final_score desc, start_ms, clip_id) as place from clips")
def g14(spark, d):
    return selection.final_order(clips(spark, d)).select("episode_id", "clip_id", "place")


@query("g15_default_clip", f"with {S.CLIPS} select episode_id, arg_max(clip_id, (final_score, -start_ms, clip_id)) as clip_id from clips group by 1")
def g15(spark, d):
    return selection.default_clip(clips(spark, d))


@query("g16_bucket_cap", f"""with {S.CLIPS}, r as (select *, end_ms - start_ms > 30000 as l, row_number() over (partition by episode_id, end_ms - start_ms > 30000 order by final_score desc, clip_id) as r from clips) select episode_id, clip_id from r where not l or r <= 1""")
def g16(spark, d):
    return selection.bucket_cap(clips(spark, d)).select("episode_id", "clip_id")


@query("g18_hashtags")
def g18(spark, d):
    return selection.hashtag_pack(stats.top_keywords(docs(spark, d), "doc_id"), "doc_id")


@query("g21_delivery", f"""with {S.CLIPS}, r as (select episode_id, clip_id, round(final_score * 100, 4) as score_100 from clips), p as (select *, row_number() over (partition by episode_id order by score_100 desc, clip_id) as place from r) select * from p where place <= 10""")
def g21(spark, d):
    return selection.delivery_view(clips(spark, d)).select("episode_id", "clip_id", "score_100", "place")


FIELDS = "clip_id, start_ms, end_ms, final_score"
OUT = "select episode_id, k.clip_id as clip_id, k.start_ms as start_ms, k.end_ms as end_ms, k.final_score as final_score, pick from picked"
BEST = "final_score desc, start_ms, clip_id"
POOL = "pool as (select episode_id, clip_id, start_ms, end_ms, final_score, list_distinct(string_split_regex(lower(trim(text)), '\\s+')) as ws from clips)"


@query("h01_nms", f"with recursive {S.CLIPS}, {POOL}, {S.greedy(BEST, f'{S.iou()} >= 0.55', FIELDS)} {OUT}")
def h01(spark, d):
    return selection.nms(clips(spark, d))


@query("h02_drop_overlaps", f"with recursive {S.CLIPS}, {POOL}, {S.greedy(BEST, 'k.start_ms < o.end_ms and k.end_ms > o.start_ms', FIELDS)} {OUT}")
def h02(spark, d):
    return selection.drop_overlaps(clips(spark, d))


@query("h04_dedup_timing", f"with recursive {S.CLIPS}, {POOL}, {S.greedy(BEST, 'abs(k.start_ms - o.start_ms) <= 9000 and abs(k.end_ms - o.end_ms) <= 9000', FIELDS)} {OUT}")
def h04(spark, d):
    return selection.dedup_timing(clips(spark, d), 9_000)


@query("h05_dedup_text", f"with recursive {S.CLIPS}, {POOL}, {S.greedy(BEST, 'len(list_intersect(k.ws, o.ws))::double / len(list_distinct(list_concat(k.ws, o.ws))) >= 0.6', FIELDS + ', ws')} {OUT}")
def h05(spark, d):
    return selection.dedup_text(clips(spark, d), 0.6)


@query("h06_dedupe_candidates", f"with recursive {S.CLIPS}, {POOL}, {S.greedy(BEST, f'{S.iou()} >= 0.6 or len(list_intersect(k.ws, o.ws))::double / len(list_distinct(list_concat(k.ws, o.ws))) >= 0.85', FIELDS + ', ws')} {OUT}")
def h06(spark, d):
    return selection.dedupe_candidates(clips(spark, d))


def first_of_alike(least: float) -> str:
    return f"""with recursive {VECTORS}, ordered as (select *, row_number() over (partition by label order by vec_id) as rn from e),
    folded as (
        select distinct label, 0::bigint as rn, []::struct(id bigint, x double[])[] as kept from ordered
        union all
        select f.label, o.rn, case when len(list_filter(f.kept, lambda k: list_cosine_similarity(k.x, o.x) >= {least})) > 0 then f.kept else list_append(f.kept, {{'id': o.vec_id, 'x': o.x}}) end
        from folded f join ordered o on o.label = f.label and o.rn = f.rn + 1
    ), best as (select label, arg_max(kept, rn) as kept from folded group by label)
    select label, unnest(list_transform(kept, lambda k: k.id)) as vec_id from best"""


@query("h07_semantic_dedupe_low", first_of_alike(0.3))
def h07_low(spark, d):
    return selection.semantic_dedupe(T.read(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.3)


@query("h07_semantic_dedupe", first_of_alike(0.92))
def h07(spark, d):
    return selection.semantic_dedupe(T.read(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("h08_unique_texts", r"with r as (select doc_id, row_number() over (partition by trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}0-9]+', ' ', 'g')) order by doc_id) as r from documents) select doc_id from r where r = 1")
def h08(spark, d):
    return selection.unique_texts(docs(spark, d), [], "text", "doc_id").select("doc_id")


@query("h10_remaining", f"with {S.CLIPS}, b as (select arg_max(clip_id, (final_score, -start_ms, clip_id)) as clip_id from clips group by episode_id) select episode_id, clip_id from clips where clip_id not in (select clip_id from b)")
def h10(spark, d):
    c = clips(spark, d).select("episode_id", "clip_id", "final_score", "start_ms")
    return selection.remaining(c, selection.default_clip(c)).select("episode_id", "clip_id")


# --- streams' batch twins ----------------------------------------------------------------------------------------


@query("i01_progress")
def i01(spark, d):
    stage = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "transcribing").when(F.col("event_type") == "click", "scoring").when(F.col("event_type") == "purchase", "processing").otherwise("completed")
    percent = F.get_json_object("props", "$.k").cast("int")
    return streams.progress(events(spark, d).select(F.col("user_id").alias("episode_id"), stage.alias("stage"), percent.alias("percent"), "ts", F.col("event_id").alias("id")))


@query("i02_rate_limit", """with recursive e as (select user_id, floor(epoch(ts))::bigint as at_s, event_id as id, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as rn from events),
    f as (select distinct user_id, 0::bigint as rn, []::bigint[] as open, null::bigint as id, null::bigint as at_s, null::boolean as accepted from e union all
    select f.user_id, e.rn, case when len(list_filter(f.open, lambda t: t > e.at_s - 36000)) < 5 then list_append(list_filter(f.open, lambda t: t > e.at_s - 36000), e.at_s) else list_filter(f.open, lambda t: t > e.at_s - 36000) end, e.id, e.at_s,
        len(list_filter(f.open, lambda t: t > e.at_s - 36000)) < 5 from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
    select user_id, id, at_s, accepted from f where rn > 0""")
def i02(spark, d):
    return streams.rate_limit(events(spark, d).select("user_id", "ts", F.col("event_id").alias("id")), "user_id", 5, 36_000)


@query("i03_first_seen", """with recursive e as (select user_id as key, floor(epoch(ts))::bigint as at_s, event_id as id, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as rn from events),
    f as (select distinct key, 0::bigint as rn, null::bigint as last, null::bigint as id, null::bigint as at_s, false as ok from e union all
    select f.key, e.rn, case when f.last is null or e.at_s - f.last > 43200 then e.at_s else f.last end, e.id, e.at_s, f.last is null or e.at_s - f.last > 43200 from f join e on e.key = f.key and e.rn = f.rn + 1)
    select key, id, at_s from f where ok""")
def i03(spark, d):
    return streams.first_seen(events(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")), "key", 43_200)


@query("i04_metrics", "select date_trunc('hour', ts) as start, event_type as name, count(*) as n, round(avg(value), 6) as mean, count(*) filter (event_type = 'error') as errors from events group by 1, 2")
def i04(spark, d):
    return streams.metrics(events(spark, d).select(F.col("event_type").alias("name"), "value", "ts"))


@query("i05_rolling_calibrator", "with l as (select value / 1000 as s from events where value / 1000 between 0 and 1 order by ts desc, event_id desc limit 500), a as (select list_sort(list(s)) as a, count(*) as n from l) select n, a[round_even(0.10 * (n - 1), 0)::bigint + 1] as p10, a[round_even(0.90 * (n - 1), 0)::bigint + 1] as p90 from a")
def i05(spark, d):
    return streams.rolling_calibrator(events(spark, d).select((F.col("value") / 1000).alias("score"), "ts", F.col("event_id").alias("id")))


@query("i06_trend_window", """with t as (select date_trunc('day', ts) as day, unnest(regexp_extract_all(lower(event_type), '[\\p{L}0-9'']{3,}')) as term from events)
    select day, term, count(*) as n, round(count(*) * exp(-ln(2.0) * greatest(epoch(timestamp '2024-02-01' - day) / 86400.0, 0) / 7.0), 6)::double as decayed from t group by 1, 2""")
def i06(spark, d):
    return streams.trend_window(events(spark, d).select(F.col("event_type").alias("title"), "ts"), F.to_timestamp(F.lit("2024-02-01")))


@query("i07_sessions", """with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true)::int as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hour as end, count(*) as n from s group by user_id, k""")
def i07(spark, d):
    return streams.sessions(events(spark, d), "user_id", "6 hours")


@query("i08_job_state", """select user_id as job_id, arg_max(event_type, (ts, event_id)) as status, min(ts) as created from events group by 1""")
def i08(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("id"))
    return streams.job_state(e).select("job_id", "status", "created")


# --- experiments -------------------------------------------------------------------------------------------------


@query("j01_ab_bucket", "select doc_id, case when ('0x' || substr(md5(doc_id::varchar), 1, 6))::bigint % 100 < 30 then 1.0::double else 0.2::double end as scale from documents")
def j01(spark, d):
    return docs(spark, d).select("doc_id", experiments.ab_bucket(F.col("doc_id"), 30, 0.2).cast("double").alias("scale"))


@query("j02_hash_jitter", "select doc_id, round((('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint / 4294967295.0::double * 2 - 1) * 0.01, 9) as jitter from documents")
def j02(spark, d):
    return docs(spark, d).select("doc_id", F.round(experiments.hash_jitter(F.col("doc_id"), 0.01), 9).alias("jitter"))


@query("j03_ab_summary", "select user_id as test_id, count(*) as n, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'view') as b, round(count(*) filter (event_type = 'click') / nullif(count(*) filter (event_type in ('click', 'view')), 0)::double, 6) as a_share from events group by 1")
def j03(spark, d):
    return experiments.ab_summary(events(spark, d).select(F.col("user_id").alias("test_id"), F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").alias("choice")))


@query("j04_feedback_summary", "select event_type as reason, count(*) as n, round(avg(value), 6) as mean_rating, round(avg(user_id), 6) as mean_score from events group by 1")
def j04(spark, d):
    return experiments.feedback_summary(events(spark, d).select(F.col("event_type").alias("reason"), F.col("value").alias("rating"), F.col("user_id").alias("score")))


@query("j05_title_ctr", "select user_id as title_id, count(*) filter (event_type = 'view') as impressions, count(*) filter (event_type = 'click') as clicks, round(count(*) filter (event_type = 'click') / nullif(count(*) filter (event_type = 'view'), 0)::double, 6) as ctr from events group by 1")
def j05(spark, d):
    return experiments.title_ctr(events(spark, d).select(F.col("user_id").alias("title_id"), F.col("event_type").alias("action")))


TOP = f"""with recursive {S.SEGMENTS}, pool as (select episode_id, seg_idx, start_ms::bigint as start_ms, end_ms::bigint as end_ms, seg_idx::varchar as clip_id,
    round({S.prerank('text', '((end_ms - start_ms) / 1000.0)', f'len({WS})')}, 6)::double as final_score from segments), {S.greedy("final_score desc, start_ms, clip_id", f"{S.iou()} >= 0.55", FIELDS, 3)}
    select episode_id, k.clip_id as clip_id, k.start_ms as start_ms, k.end_ms as end_ms, k.final_score as final_score, pick from picked"""


@query("top_segments", TOP)
def top_segments(spark: SparkSession, d: str) -> DataFrame:
    """The three best segments of each episode by the cheap score that do not overlap."""
    rows = segments(spark, d).withColumn("clip_id", F.col("seg_idx").cast("string"))
    rows = rows.withColumn("final_score", F.round(features.prerank_score(F.col("text"), features.seconds()), 6))
    return selection.nms(rows).where("pick <= 3")


