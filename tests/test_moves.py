"""What moves between tasks: texts rather than words, and what is counted and read is computed once."""

import math

from pyspark.sql import functions as F

from cliploom.operators import features, joins, sequence, stats

DOCS = [(1, "The cat and the Dog"), (1, "the end 2024"), (2, "cat"), (3, ""), (4, None)]


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]


def test_keywords_move_texts_by_key_and_not_words(spark):
    found = stats.top_keywords(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", k=2)
    (one,) = exchanges(found)
    assert "hashpartitioning(doc_id" in one and "term" not in one
    assert [(r.doc_id, r.rank, r.term, r.score) for r in found.orderBy("doc_id", "rank").collect()] == [(1, 1, "dog", 6.3), (1, 2, "2024", 4.4), (2, 1, "cat", 1.3)]


def test_tfidf_counts_terms_once_and_joins_texts_of_one_key(spark):
    found = stats.tfidf(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id")
    assert any("terms-" in f for f in found.inputFiles())
    got = {(r.doc_id, r.term): r.tfidf for r in found.collect()}
    assert len(got) == 7 and got[1, "the"] == round(3 / 8 * (math.log(6 / 2) + 1), 6) and got[2, "cat"] == round(math.log(6 / 3) + 1, 6)


def test_marks_are_written_before_they_are_thinned_and_met(spark):
    marks = lambda *times: spark.createDataFrame([(1, t) for t in times], "episode_id long, t_ms long")
    found = sequence.unify_marks(marks(100, 1_000, 5_000), marks(1_100, 5_200))
    assert any("word-marks-" in f for f in found.inputFiles())
    assert sorted(r.t_ms for r in found.collect()) == [100, 1_100, 5_200]


def test_rules_of_chosen_clips_read_scores_and_not_texts(spark):
    from cliploom.plans import catalog

    for name in ("g09_diversity_swap", "g10_length_mix", "g11_finished_backstop"):
        found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert all("/clips-" in f for f in found.inputFiles()) and found.count() > 0


def test_hops_take_counts_and_not_words(spark):
    words = spark.createDataFrame([(1, "Ab!", 0, 250), (1, "7?", 300, 550), (1, "c", 4_000, 4_250)], "episode_id long, w string, start_ms long, end_ms long")
    found = sequence.hop_features(words)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(" in plan and plan.index("explode(sequence(") < plan.index("regexp_extract_all(")
    got = {r.hop: (r.hook, r.payoff) for r in found.collect()}
    assert len(got) == 9 and got[0] == (0.15, 0.05) and got[8] == (0.0, 0.0)


def spoken(spark, episode=1, n=200):
    words = spark.createDataFrame([(episode, i, f"w{i}", 1_000 * i, 1_000 * i + 900) for i in range(n)], "episode_id long, word_idx long, w string, start_ms long, end_ms long")
    clips = spark.createDataFrame([(episode, f"c{a}-{b}", a, b, "own") for a, b in ((0, 2_500), (500, 1_000), (29_500, 130_500), (118_000, 121_950), (150_000, 150_001), (900_000, 950_000))], "episode_id long, clip_id string, start_ms long, end_ms long, text string")
    return words, clips


def nothing_moves_after_the_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " Exchange " not in plan[: plan.index("SortMergeJoin")]


def test_clamped_words_do_not_move_for_each_clip(spark):
    words, clips = spoken(spark)
    found = joins.words_clamped_to_clip(words, clips)
    assert nothing_moves_after_the_join(found)
    got = {}
    for r in found.orderBy("word_idx").collect():
        got.setdefault(r.clip_id, []).append((r.w, r.t, r.d))
    assert got["c0-2500"] == [("w0", 0.0, 0.9), ("w1", 1.0, 0.9), ("w2", 2.0, 0.5)] and got["c500-1000"] == [("w0", 0.0, 0.4)]
    assert [w for w, _, _ in got["c29500-130500"]] == [f"w{i}" for i in range(29, 131)] and got["c118000-121950"][-1] == ("w121", 3.0, 0.9)
    assert set(got) == {"c0-2500", "c500-1000", "c29500-130500", "c118000-121950"}


def test_transcripts_do_not_move_words_for_each_clip(spark):
    words, clips = spoken(spark)
    segments = spark.createDataFrame([(1, 1, 149_000, 152_000, "Told , so"), (1, 0, 148_000, 151_000, "First")], "episode_id long, seg_idx long, start_ms long, end_ms long, text string")
    got = {r.clip_id: (r.transcript, r.source, r.n_words, r.coverage) for r in joins.clip_transcript(clips, words, segments).collect()}
    assert got["c0-2500"] == ("w0 w1", "words", 2, 0.72) and got["c29500-130500"][0] == " ".join(f"w{i}" for i in range(30, 130))
    assert got["c150000-150001"] == ("First Told, so", "segments", 0, 0.0) and got["c900000-950000"] == ("own", "clip", 0, 0.0) and len(got) == 6
    spoken_only = joins.clip_transcript(clips.where("end_ms < 150000 and start_ms != 500"), words, segments)
    assert all("spoken-" in f for f in spoken_only.inputFiles()) and spoken_only.count() == 3


def test_window_texts_do_not_move_for_each_window(spark):
    rows = [(1, i, 10_000 * i, 10_000 * i + 9_000, f"s{i}" if i != 4 else None) for i in range(20)]
    segments = spark.createDataFrame(rows, "episode_id long, seg_idx long, start_ms long, end_ms long, text string")
    spans = [("a", 0, 25_000), ("b", 5_000, 125_000), ("c", 9_200, 9_900), ("d", 30_000, 45_000), ("e", 62_000, 75_000), ("e", 62_000, 75_000)]
    windows = spark.createDataFrame([(1, *s) for s in spans], "episode_id long, clip_id string, start_ms long, end_ms long")
    found = joins.segment_window_text(segments, windows)
    assert nothing_moves_after_the_join(found)
    got = {r.clip_id: (r.text, r.n_segments) for r in found.collect()}
    assert got == {"a": ("s0 s1 s2", 3), "b": (" ".join(f"s{i}" for i in range(13) if i != 4), 13), "d": ("s3", 2), "e": ("s6 s6 s7 s7", 4)}


def test_boundaries_do_not_move_words(spark):
    docs = spark.createDataFrame([(1, "It is so. But , then here's the thing we saw , also one two three four five six"), (2, ""), (3, None)], "episode_id long, text string")
    found = sequence.natural_boundaries(docs)
    assert not any("five" in line or "ahead" in line for line in exchanges(found))
    assert [(r.position, r.kind) for r in found.orderBy("position").collect()][:2] == [(1, "topic_shift"), (3, "sentence_end")]


def test_words_are_counted_without_a_function_for_each(spark):
    texts = ["AB cd ABC  A1 AB   ÀB  ABCD", " NASA\tÉté Éa Zoë's\nX Yz1 don't-stop ΟΔΟΣ ΟΔΟΣ' - -- !", "", " ", None, "a b", "One two one two One two 3rd", " AB AB\u0085 𐐀𐐨𐐨x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    text = F.col("text")
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = lambda p: F.size(F.filter(ws, lambda w: w.rlike(p))).cast("long")
    table = docs.select("id", *(c.alias(k) for k, c in features.basics(text).items()), features.n_capitals(text, 3).alias("caps3"))
    assert "lambda" not in table._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in table.collect()}
    clean = F.transform(ws, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}0-9']", "")))
    want = docs.select("id", F.size(ws).alias("n"), count("^[A-Z]{2,}$").alias("caps"), count("^[A-Z]{3,}$").alias("caps3"), F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w)).alias("chars"), clean.alias("clean"))
    cleaned = docs.select("id", F.split(F.lower(F.regexp_replace(F.array_join(features.words(text), " "), r"[^\p{L}0-9' ]", "")), " ").alias("c"))
    cut = {r.id: r.c for r in cleaned.collect()}
    for r in want.where("text is not null").collect():
        g = got[r.id]
        assert (g.word_count, g.caps_words, g.caps3) == (r.n, r.caps, r.caps3) and g.mean_word == (round(r.chars / r.n, 6) if r.n else 0.0), texts[r.id]
        assert cut[r.id] == (r.clean or [""])


def test_gaps_are_counted_from_a_table_without_texts(spark):
    rows = [(e, s, 10 * s + i, w, 1_000 * i + 7 * i * (i % 3), 1_000 * i + 7 * i * (i % 3) + 250) for e in (1, 2) for s in (0, 1) for i, w in enumerate(["a", "B.", "c,", "d", "right?", "E", "f", "g"])]
    words = spark.createDataFrame(rows, "episode_id long, seg_idx long, word_idx long, w string, start_ms long, end_ms long")
    gaps = sequence.word_gaps(words, ("episode_id", "seg_idx"), kinds=True)
    assert gaps.columns == ["episode_id", "seg_idx", "t_ms", "gap", "named", "kind"] and all("gaps-" in f for f in gaps.inputFiles())
    mid = gaps.where("gap > 0").groupBy("episode_id", "seg_idx").agg(F.percentile("gap", 0.5).alias("mid"), F.stddev_samp("gap").alias("dev"))
    near = gaps.join(mid, ["episode_id", "seg_idx"]).where("gap > 0 and abs(gap - mid) <= dev").groupBy("episode_id", "seg_idx").agg(F.percentile("gap", 0.5).alias("near"))
    limits = {(r.episode_id, r.seg_idx): max(280.0, r.mid + r.near) for r in mid.join(near, ["episode_id", "seg_idx"]).collect()}
    want = {(r.episode_id, r.t_ms) for r in gaps.collect() if r.gap is not None and (r.named or r.gap >= limits[r.episode_id, r.seg_idx])}
    found = sequence.marks_of_gaps(gaps, by=("episode_id", "seg_idx"))
    assert {(r.episode_id, r.t_ms) for r in found.collect()} == want and len(want) >= 4
