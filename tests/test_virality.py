"""Worked values of virality, genre verdicts, lengths and moved ends, and rows with nulls."""

import math

import pytest
from pyspark.sql import functions as F

from cliploom.operators import genres, sequence, virality


def one(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def clips(spark, *rows):
    names = ("id", "start_ms", "end_ms", "hook", "arousal", "payoff", "info_density", "question", "q_list", "loopability", "finished", "payoff_ok", "penalty")
    types = "id int, start_ms long, end_ms long, hook double, arousal double, payoff double, info_density double, question double, q_list double, loopability double, finished boolean, payoff_ok boolean, penalty double"
    return spark.createDataFrame([tuple({"id": i, "start_ms": 0, **r}.get(n) for n in names) for i, r in enumerate(rows)], types)


def test_virality(spark):
    long = dict(end_ms=24_000, hook=0.8, arousal=0.5, payoff=0.6, info_density=0.4, question=0.5, q_list=0.5, loopability=0.5, finished=True, payoff_ok=True)
    short = dict(end_ms=9_000, hook=1.0, arousal=1.0, payoff=0.5)
    late = dict(end_ms=50_000, hook=1.0, arousal=1.0, payoff=0.0, penalty=0.1)
    df = clips(spark, long, short, late, dict(end_ms=0))
    content = (0.35 * 0.8 + 0.2 * 0.5 + 0.1 * 0.6 + 0.05 * 0.4) / 0.7
    prior = lambda over: -1 / (1 + math.exp(-over))
    expected = [
        content + 0.05 + 0.015 + 0.01 + 0.12, (0.35 + 0.2 + 0.05) / 0.7 - 0.5, (0.35 + 0.2) / 0.7 - 0.045 + 0.4 * prior(5) - 0.1, 0.0,
    ]
    assert one(virality.virality(df), "virality") == pytest.approx(expected, abs=1e-6)
    core = [0.208 + 0.1 + 0.102 + 0.044 + 0.045 + 0.02 + 0.025 + 0.12, 0.26 + 0.2 + 0.085 - 0.5, 0.46 - 0.045 - 0.1, 0.0]
    assert one(virality.core_virality(df), "v_core") == pytest.approx(core, abs=1e-6)
    balanced = one(virality.virality(df, rebalanced=True), "virality")
    assert balanced[0] == pytest.approx(0.4 * 0.8 + 0.11 + 0.192 + 0.024 + 0.05 + 0.015 + 0.01 + 0.12, abs=1e-6)
    assert balanced[1] == pytest.approx((0.4 + 0.22 + 0.1) / 0.88 - 0.5, abs=1e-6)
    told = df.withColumn("text", F.when(F.col("id") == 0, "It works BECAUSE of that")).withColumn("ad_flag", F.col("id") == 2)
    worth = [expected[0] + 0.55 + 0.08, expected[1] + 0.24, expected[2] + 0.12 - 0.6, 0.24]
    assert one(virality.end_utility(told), "utility") == pytest.approx(worth, abs=1e-6)
    bare = df.select("id", "start_ms", "end_ms")
    assert one(virality.end_utility(bare), "utility") == pytest.approx([0.12, 0.24, 0.12, 0.24])
    assert virality.virality(df.limit(0)).count() == 0


def test_bands_and_calibration(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate((0.05, 0.1, 0.35, 0.45, 0.66, 0.73, 0.8, 2.0, None))], "id int, x double")
    points, name = virality.confidence_band(F.col("x"))
    rows = df.select("id", points.alias("p"), name.alias("n"), virality.calibrate_v2(F.col("x")).alias("c"))
    assert one(rows, "p")[:8] == [40, 45, 62, 70, 85, 90, 95, 100]
    assert one(rows, "n")[:8] == ["Fair", "Fair", "Good", "Strong", "Premium", "Exceptional", "Exceptional", "Exceptional"]
    assert one(rows, "c")[:7] == pytest.approx([0.0475, 0.095, 0.3325, 0.504, 0.693, 0.7665, 0.784]) and one(rows, "c")[7] == 0.95


def test_lengths(spark):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate((2, 4, 10, 20, 40, 50, 61))], "id int, s double")
    assert one(df.select("id", virality.length_trapezoid(F.col("s"), "tiktok").alias("v")), "v") == pytest.approx([0, 0.35, 0.75, 1.0, 0.5 + 0.5 / 3, 0.4, 0])
    assert one(df.select("id", virality.length_trapezoid(F.col("s"), "nowhere").alias("v")), "v")[2] == 0.75
    bell = lambda w, loop, kind, sure, tail: virality.length_bell(F.col("s"), F.lit(w), F.lit(loop), F.lit(kind), F.lit(sure), F.lit(tail))
    got = one(df.select("id", bell(None, 0.0, "other", 0.0, None).alias("v")), "v")
    assert got == pytest.approx([math.exp(-0.5 * ((s - 22) / 7) ** 2) for s in (2, 4, 10, 20, 40, 50)] + [0.0])
    assert one(df.select("id", bell(3.65, 0.7, "sentence_end", 0.95, "Please SUBSCRIBE").alias("v")), "v")[3] == pytest.approx(0.85)
    assert one(df.select("id", bell(9.0, 0.0, "mid_word", 0.0, "").alias("v")), "v")[3] == pytest.approx(0.85 * 0.85 * math.exp(-0.5 * (2 / 7) ** 2))


def test_genre_verdict(spark):
    rows = [
        (0, "fantasy_sports", 0.7, 0.2, 0.0, 0.5, 0.0), (1, "business", 0.1, 0.9, 0.0, 0.0, 0.0), (2, "news_politics", 0.9, 0.3, 0.0, 0.0, 0.1),
        (3, "comedy", 0.0, 0.0, 0.9, 0.0, 0.0), (4, None, 0.0, 0.5, 0.0, 0.0, 0.0), (5, "general", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, genre string, payoff double, hook double, arousal double, info_density double, urgency_score double")
    got = genres.genre_verdict(df)
    assert got.columns == [*df.columns, "gate", "path", "path_score", "genre_score"]
    rows = {r.id: (r.genre, r.path, r.path_score, r.gate) for r in got.collect()}
    assert rows[0] == ("fantasy_sports", "payoff", pytest.approx(0.45 * 0.84 + 0.25 * 0.575 + 0.1 * 0.26), 1.0)
    assert rows[1] == ("business", "hook", pytest.approx(0.465), 0.80) and rows[2][3] == 0.75
    assert rows[3] == ("comedy", "energy", 0.5, 0.85)
    assert rows[4] == ("general", "hook", 0.225, 0.95) and rows[5] == ("general", "energy", 0.0, 0.85)


def test_niche_and_hook(spark):
    df = spark.createDataFrame([(0, "That's it", "sports", 0.9, 0.5, 0.0), (1, "and That's it", None, 0.9, 0.1, 0.3), (2, None, "comedy", 0.2, 0.9, 0.9)], "id int, text string, genre string, hook double, ad double, rep double")
    rows = df.select("id", virality.niche_penalty(F.col("text"), F.col("genre")).alias("n"), virality.clamped_hook(F.col("hook"), F.col("ad"), F.col("rep")).alias("h"))
    assert one(rows, "n") == [0.0, 0.1, 0.0] and one(rows, "h") == pytest.approx([0.3, 0.63, 0.14])


def test_moved_ends(spark):
    words = spark.createDataFrame(
        [(1, 0, "One", 0, 200), (1, 1, "two.", 250, 500), (1, 2, "three", 600, 900), (1, 3, "four.)", 1000, 1200), (1, 4, "Five", 1300, 1500), (1, 5, "six!", 4000, 4300)],
        "episode_id long, word_idx long, w string, start_ms long, end_ms long",
    )
    marks = spark.createDataFrame([(1, 500), (1, 1200), (1, 9300)], "episode_id long, t_ms long")
    segments = spark.createDataFrame([(1, 1000), (1, 6000)], "episode_id long, end_ms long")
    cut = spark.createDataFrame([(i, 1, str(i), 0, e) for i, e in enumerate((480, 500, 1250, 4300, 5900))] + [(5, 2, "5", 0, 700), (6, 1, "6", -25_000, 4_900)], "id int, episode_id long, clip_id string, start_ms long, end_ms long")
    assert one(sequence.extend_capped(cut, marks), "end_ms") == [1200, 1200, 1250, 9300, 9300, 700, 4900]
    assert one(sequence.coherent_end(cut, marks, segments), "end_ms") == [500, 1200, 6000, 9300, 9300, 700, 9300]
    natural = sequence.natural_end(cut, words)
    assert one(natural, "end_ms") == [480, 500, 1250, 4300, 5900, 700, 4900]
    assert one(sequence.natural_end(cut.withColumn("end_ms", F.col("end_ms") + 100), words), "end_ms")[2] == 4300
    near = cut.withColumn("end_ms", F.when(F.col("id") == 0, 430).when(F.col("id") == 1, 1190).otherwise(F.col("end_ms")))
    assert one(sequence.micro_jitter(near, words), "end_ms") == [500, 1200, 1200, 4300, 5900, 700, 4900]
    assert sequence.micro_jitter(near.union(near), words).count() == 14
    assert sequence.micro_jitter(near.limit(0), words).count() == 0
