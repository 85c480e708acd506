"""Operators on small rows: edges, invariants, plans, and streams against their batch twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import experiments, features, joins, patterns, scores, selection, sequence, stats
from cliploom.plans import queries as Q
from cliploom.sources import transcripts as T
from cliploom.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def clips(spark):
    make, rows = random.Random(5), []
    for e in range(4):
        for i in range(25):
            s = make.randint(0, 120_000)
            rows.append((e, f"c{e}_{i:02}", s, s + make.randint(5_000, 60_000), round(make.random(), 3), make.random() < 0.5, f"words {make.randint(0, 5)} of clip {make.randint(0, 3)}."))
    rows += [(9, "x0", None, 5_000, 0.5, True, "a"), (9, "x1", 3_000, None, 0.5, True, None), (9, "x2", 7_000, 7_000, 0.5, False, ""), (9, "x3", 9_000, 1_000, 0.9, False, "b")]
    return spark.createDataFrame(rows, "episode_id long, clip_id string, start_ms long, end_ms long, final_score double, finished boolean, text string")


def overlap(a, b):
    (s1, e1), (s2, e2) = sorted(a), sorted(b)
    common = max(0, min(e1, e2) - max(s1, s2))
    return common / ((e1 - s1) + (e2 - s2) - common) if common else 0.0


def test_nms_keeps_no_overlap_and_is_idempotent(spark, clips):
    kept = selection.nms(clips)
    rows = kept.collect()
    by = {}
    for r in rows:
        by.setdefault(r.episode_id, []).append(r)
    for group in by.values():
        spans = [(r.start_ms, r.end_ms) for r in group if None not in (r.start_ms, r.end_ms)]
        assert all(overlap(a, b) < 0.55 for i, a in enumerate(spans) for b in spans[:i])
    assert {r.clip_id for r in selection.nms(kept.drop("pick")).collect()} == {r.clip_id for r in rows}
    assert len(by[9]) >= 3  # rows without a span knock nothing out


def test_range_join_is_an_equi_join(spark, clips):
    words = Q.words(spark, SF)
    plan = joins.words_overlap_clips(words, Q.clips(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_range_join_matches_loops(spark):
    make = random.Random(2)
    spans = lambda n, w: [(make.randint(0, 2), i, s := make.randint(0, 200_000), s + make.randint(0, w)) for i in range(n)]
    a, b = spans(150, 90_000), spans(150, 5_000)
    one = spark.createDataFrame(a, "k long, a long, s long, e long")
    two = spark.createDataFrame(b, "k long, b long, s2 long, e2 long")
    touch = lambda x, y: (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e"))
    got = sorted((r.a, r.b) for r in patterns.range_join(one, two, "k", ("s", "e"), ("s2", "e2"), touch).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    left = patterns.range_join(one, two.where("b < 5"), "k", ("s", "e"), ("s2", "e2"), touch, how="left")
    assert {r.a for r in left.collect()} == {x[1] for x in a}


def test_asof_join_matches_loops(spark):
    make = random.Random(3)
    rows = [(make.randint(0, 2), i, make.randint(0, 50)) for i in range(80)]
    points = [(make.randint(0, 3), make.randint(0, 50)) for _ in range(40)]
    left, marks = spark.createDataFrame(rows, "k long, id long, t long"), spark.createDataFrame(points, "k long, m long")
    for forward in (True, False):
        for strict in (True, False):
            got = {r.id: r.mark_ms for r in patterns.asof_join(left, marks, "k", "t", "m", forward, strict).collect()}
            for k, i, t in rows:
                near = [m for g, m in points if g == k and ((m > t or (m == t and not strict)) if forward else (m < t or (m == t and not strict)))]
                assert got[i] == ((min if forward else max)(near) if near else None), (forward, strict)


def test_canonical_words_takes_all_spellings(spark):
    word = lambda **x: tuple(x.get(n) for n in ("w", "word", "token", "text", "t", "d", "start", "end", "s", "e", "ts", "te", "prob"))
    ws = [word(w="a", t="0.1", d="0.2"), word(word="bb", start="1", end="1.5", prob="0.9"), word(text="ccc", s="2", e="2.5"), word(token="d", ts="3"), word(w=" ", t="1"), word(w="x"), word(w="y", start="5", end="4")]
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "t", None, ws)], T.SEGMENT)
    got = [(r.w, r.start_ms, r.end_ms, r.prob) for r in T.canonical_words(df).orderBy("word_idx").collect()]
    assert got == [("a", 100, 300, None), ("bb", 1000, 1500, 0.9), ("ccc", 2000, 2500, None), ("d", 3000, 3060, None)]
    ready = T.preflight(spark.createDataFrame([(1, 0, 0.0, 1.0, None, None, ws[:2]), (1, 1, 0.0, 1.0, "kept", None, None)], T.SEGMENT)).orderBy("seg_idx").collect()
    assert ready[0].text == "a bb" and ready[1].words == [] and ready[1].tokens == ["kept"]


def test_clips_of_json_layouts(spark):
    bodies = ['[{"id":"a","start":1,"end":2,"score":5}]', '{"clips":[{"clip_id":"b","startTime":3,"end_time":4,"text":"t"}]}', "not json", '{"items":[]}']
    rows = T.clips_of_json(spark.createDataFrame(list(enumerate(bodies)), "no int, body string")).orderBy("no").collect()
    assert [(r.no, r.id, r.start, r.end, r.text, r.score) for r in rows] == [(0, "a", 1.0, 2.0, "", 5.0), (1, "b", 3.0, 4.0, "t", None)]


def test_history_skips_bad_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"clip_id":"a","ts":1}\nbad\n{"clip_id":"b","ts":3}\n{"clip_id":"c","ts":2}\n')
    assert [r.clip_id for r in T.list_history(spark, str(tmp_path / "h.jsonl"), 2).collect()] == ["b", "c"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("“Hi” – it’s…", "#Tag one #two #Tag")], "a string, b string")
    r = df.select(T.normalize_text(F.col("a")).alias("a"), T.collect_hashtags(F.col("b"), F.array(F.lit("#Three"))).alias("b")).first()
    assert r.a == "\"Hi\" - it's..." and r.b == ["tag", "two", "three"]


def test_cues_keep_length_and_gap(spark):
    for r in sequence.vtt_cues(Q.words(spark, SF)).collect():
        assert len(r.text) <= 38 or " " not in r.text
    one = T.captions_to_vtt(spark.createDataFrame([(1, 0, 3_723_004, "a"), (1, 5, 9, "b")], "episode_id long, start_ms long, end_ms long, text string")).first().vtt
    assert one == "WEBVTT\n\n00:00:00.000 --> 01:02:03.004\na\n\n00:00:00.005 --> 00:00:00.009\nb\n"


def test_thinned_marks_are_apart(spark):
    marks = sequence.thin_marks(spark.createDataFrame([(1, t) for t in (0, 100, 250, 251, 400, 600, 900)], "episode_id long, t_ms long"))
    assert sorted(r.t_ms for r in marks.collect()) == [0, 251, 600, 900]


def test_merge_and_stitch(spark):
    rows = [(1, 0, 0, 9_000, "Why is it so?", "a"), (1, 1, 9_100, 18_000, "Because it is.", "a"), (1, 2, 18_100, 30_000, "More.", "a"), (1, 3, 30_100, 31_000, "Other.", "b")]
    s = spark.createDataFrame(rows, "episode_id long, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    assert [(r.start_ms, r.end_ms, r.n) for r in sequence.merge_short_seeds(s).orderBy("seed_idx").collect()] == [(0, 18_000, 2), (18_100, 30_000, 1), (30_100, 31_000, 1)]
    stitched = sequence.stitch_answers(s).orderBy("seg_idx").first()
    assert stitched.has_answer and stitched.end_ms == 17_000 and stitched.text == "Why is it so? Because it is."


def test_features_in_range_and_directional(spark):
    texts = [None, "", "one", "You won't believe the secret: here's why 3 tricks are better than 10!", "Because of that, the answer is 42% more. Try it.", "Buy now at shop.com and save, visit our shop today.", "ünïcode wörds"]
    df = spark.createDataFrame([(i, 0, 10_000, t) for i, t in enumerate(texts)], "seg_idx int, start_ms long, end_ms long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = {r.seg_idx: r for r in features.segment_features(df).collect()}
    for r in rows.values():
        for c in ("hook_v4", "arousal", "payoff", "info_density", "info_density_v2", "emotion", "q_list", "loopability", "insight", "repetition", "ad_likelihood", "platform_length"):
            assert 0 <= r[c] <= 1, c
    assert rows[3].hook_v4 > rows[2].hook_v4 and rows[4].payoff > rows[2].payoff and rows[5].ad_likelihood >= 0.5 and rows[4].insight > rows[6].insight


def test_scores(spark):
    base = {"hook": 0.8, "arousal": 0.05, "payoff": 0.05, "info_density": 0.5, "platform_length": 0.5, "loopability": 0.1, "insight": 0.2, "q_list": 0.1, "emotion": 0.2, "question": 0.1, "ad_penalty": 0.0}
    rows = [{"id": 0, **base}, {"id": 1, **base, "hook": 0.9}, {"id": 2, **base, "ad_penalty": 0.2}, {"id": 3, **dict.fromkeys(base, 0.0), "hook": 1.0, "platform_length": 1.0, "insight": 1.0, "question": 1.0, "info_density": 1.0}]
    got = {r.id: r for r in scores.score_v4(spark.createDataFrame(rows)).collect()}
    assert got[1].final_score > got[0].final_score > got[2].final_score and got[3].final_score == 1.0 and got[3].score_100 == 100  # bonuses are clamped
    assert got[1].winning_path == "hook" and all(r.base_score == max(r[f"path_{p}"] for p in scores.PATHS) for r in got.values())
    white = scores.whiten(spark.createDataFrame([(0.2, 0.2), (0.9, 0.1)], "a double, b double"), ["a", "b"]).collect()
    assert (white[0].white_a, white[0].white_b) == (0.5, 0.5) and white[1].white_a > 0.8
    capped = scores.anti_bait_cap(spark.createDataFrame([("Why not?", 2, 0.9, 0.1, 0.95), ("word " * 20, 20, 0.95, 0.05, 0.9), ("fine text here", 30, 0.2, 0.5, 0.97)], "text string, n_words int, hook double, payoff double, final_score double")).collect()
    assert [r.final_score for r in capped] == [0.55, 0.72, 0.98] and capped[0].caps_applied == ["anti_bait_micro", "question_cap"]


def test_weights(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, weight double")
    assert {r.name: r.weight for r in scores.weights_normalised(w).collect()} == {"a": 0.25, "b": 0.75}
    mixed = scores.preset_weights(w, spark.createDataFrame([("a", 1.0), ("c", -1.0)], "name string, weight double")).collect()
    assert {r.name: r.weight for r in mixed} == {"a": 0.4, "b": 0.6, "c": 0.0}
    conf = spark.createDataFrame([(1, "x", 0.6), (1, "y", 0.2), (1, "z", 0.1)], "id int, genre string, confidence double")
    table = spark.createDataFrame([(g, n, v) for g, n, v in (("x", "h", 1.0), ("x", "p", 1.0), ("y", "h", 3.0), ("y", "p", 1.0))], "genre string, name string, weight double")
    assert {r.name: r.weight for r in scores.blend_weights(conf, table, "id").collect()} == {"h": 0.6, "p": 0.4}


def test_payoff_rescue(spark):
    rows = [(1, "a", 0.80, "cta", 0.8, 0.4, 0.0), (1, "b", 0.79, "cta", 0.8, 0.4, 0.0), (1, "c", 0.50, None, 0.9, 0.1, 0.8), (1, "d", 0.40, "cta", 0.1, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "episode_id long, clip_id string, calibrated double, payoff_label string, insight_conf double, payoff_score double, insight_score double")
    got = {r.clip_id: r.rescued for r in selection.payoff_rescue(df).collect()}
    assert got == {"a": 0.84, "b": 0.82, "c": 0.525, "d": 0.4}


def test_mmr_and_hashtags(spark):
    rows = [(1, "a", 0.9, "x y z"), (1, "b", 0.89, "x y z"), (1, "c", 0.7, "p q r")]
    got = selection.mmr(spark.createDataFrame(rows, "episode_id long, clip_id string, final_score double, text string"), 3).orderBy("pick").collect()
    assert [r.clip_id for r in got] == ["a", "c", "b"]
    tags = selection.hashtag_pack(spark.createDataFrame([(1, 1, "short"), (1, 2, "x" * 60), (1, 3, "other"), (1, 4, "third"), (1, 5, "fourth")], "id int, rank int, term string"), "id").first().tags
    assert tags == ["#short", "#other", "#third"]


def test_replacements(spark, clips):
    good = clips.where("episode_id < 4")
    chosen = good.where("not finished and final_score > 0.5")
    fixed = selection.finished_backstop(chosen, good, slack=1.0)
    assert fixed.where("finished").count() == chosen.select("episode_id").distinct().count() and fixed.count() == chosen.count()
    mixed = selection.length_mix(good.where("end_ms - start_ms < 30000"), good, share=0.0)
    assert mixed.groupBy("episode_id").agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("m")).where("m < 30000").count() == 0
    gate = stats.percentile_gate(good, "episode_id")
    assert 0 < gate.count() < good.count()


def test_cosine_pairs_recall(spark):
    make = random.Random(1)
    rows = []
    for i in range(120):
        v = [make.gauss(0, 1) for _ in range(64)]
        rows += [(3 * i + k, [float(x + make.gauss(0, 0.25 * k)) for x in v], i % 2) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and sum(p * q for p, q in zip(a[1], b[1])) / norm(a[1]) / norm(b[1]) >= 0.92}
    got = {(r.a, r.b) for r in joins.cosine_pairs(df, "id", "g", "v").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 50


def test_experiments(spark):
    df = spark.createDataFrame([("k%d" % i,) for i in range(2000)] + [(None,), ("",)], "k string")
    rows = df.select("k", experiments.ab_bucket(F.col("k"), 30, 0.2).alias("b"), experiments.hash_jitter(F.col("k"), 0.01).alias("j")).collect()
    assert 0.25 < sum(r.b == 1.0 for r in rows) / 2000 < 0.35 and all(abs(r.j) <= 0.01 for r in rows if r.k)
    assert [r.b for r in rows if not r.k] == [0.0, 0.0]


def replay(spark, df, run, out, tmp_path, schema, files=4, mode="append"):
    """Feed a DataFrame file by file through a stream; the sink's rows."""
    source = str(tmp_path / f"{out}-in")
    df.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = run(stream).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{out}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(out)


def test_window_streams(spark, tmp_path):
    e = Q.events(spark, SF).select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("ts"), "user_id").coalesce(1)
    live = replay(spark, e, lambda s: streams.metrics(s, watermark="2 hours"), "metrics", tmp_path, e.schema, files=1, mode="complete")
    assert sorted(map(str, live.collect())) == sorted(map(str, streams.metrics(e).collect()))


def test_entry_without_training_data_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("cliploom", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "cliploom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'h01_nms' in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
