"""Evidence columns on small rows: values worked out by hand from the rules, and nulls and empty texts."""

import math

import pytest
from pyspark.sql import functions as F

from cliploom.operators import evidence as E
from cliploom.operators import features, patterns


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[1] for r in rows.select("i", column(F.col("text")).alias("v")).orderBy("i").collect()]


def test_payoff_labels_and_scores(spark):
    texts = [
        "The weather was good and the answer is blue", "We sold 20 of them in a week or so I heard", "What did we do then? We went home and slept for long",
        "We walked for a long time. It was cold, so we went home", "too short", None, "", "Please subscribe and follow, do this because we said it",
    ]
    labels = values(spark, lambda t: E.payoff_v2(t)["label"], texts)
    assert labels == ["lead", "numeric", "qa", "conclusion", "none", "none", "none", "lead"]
    scores = values(spark, lambda t: F.round(E.payoff_v2(t)["score"], 6), texts)
    assert scores[0] == 0.25 and scores[4:7] == [0.0, 0.0, 0.0]
    assert scores[1] == 0.12 + 0.15  # one amount, and a last sentence with "so"
    assert scores[3] == 0.15
    assert scores[7] == 0.25  # do this 0.25, because 0.40 (from character 37, the last 35 % begin at 35), two calls to act


def test_payoff_in_the_tail_weighs_more(spark):
    early, late = values(spark, lambda t: F.round(E.payoff_v2(t)["score"], 6), ["the answer is blue " + "word " * 20, "word " * 20 + "the answer is blue"])
    assert (early, late) == (0.25, 0.4)


def test_presence_and_bonuses(spark):
    assert values(spark, E.payoff_presence, ["here's how we did it", "Is it so? No.", None, "because"]) == [0.25, 0.0, 0.0, 0.0]  # "because" is under 8 characters
    assert values(spark, E.resolution_bonus, ["it works because it must", "nothing", None]) == [0.08, 0.0, 0.0]
    assert values(spark, E.answer_bump, ["Is it? It is.", "It is.", "Is it?", None]) == [0.1, 0.0, 0.0, 0.0]


def test_payoff_v1(spark):
    unsure = "maybe it might work perhaps I think so and then we saw it work well every day of it"
    assert values(spark, lambda t: F.round(E.payoff_v1(t), 6), [unsure, "so you should", None, "so"]) == [0.2, 0.35, 0.0, 0.0]


def test_confidence(spark):
    texts = ["plain words", "in 10 cases", "maybe", None, "Most people wait but you should start because 10 is more than 5"]
    assert values(spark, lambda t: F.round(E.evidence_confidence(t)[1], 6), texts) == [0.6, 0.7, 0.5, 0.6, 0.9]
    assert values(spark, lambda t: E.evidence_confidence(t)[0], texts) == [False, True, False, False, True]
    row = spark.range(1).select(*(F.round(E.insight_by_confidence(F.lit(0.9), F.lit(c)), 6).alias(f"c{i}") for i, c in enumerate((0.5, 0.7, 0.9)))).first()
    assert list(row) == [0.81, 0.945, 1.0]


def test_question_lists(spark):
    texts = ["", None, "too few words", "we made three things: 1. one. 2. two. 3. three. That was all"]
    assert values(spark, lambda t: F.round(E.question_list_v2(t), 6), texts) == [0.0, 0.0, 0.35, 1.0]


def test_hook_enhanced(spark):
    families = [("curiosity", r"\bwhat if\b", 0.2)]
    texts = ["what if", None, "zzz what if qqq because 5", "hi www xxx yyy zzz"]
    got = values(spark, lambda t: E.hook_v5_enhanced(t, families), texts)
    acc = sum(0.25 * math.exp(-j / 5) for j in (0, 1, 2, 3))  # every window that holds both words
    assert got[:2] == [0.0, 0.0] and got[3] == 0.0
    assert got[2] == pytest.approx(0.2 * acc / (1 + 0.6 * acc) + 0.008)


def test_quiet_start_and_left_range_join(spark):
    clips = spark.createDataFrame([(1, "a", 0, 5000), (1, "b", 10_000, 15_000), (1, "c", 100, 140), (2, "d", 0, 900)], "episode_id long, clip_id string, start_ms long, end_ms long")
    segments = spark.createDataFrame([(1, 0, 300), (1, 200, 450), (1, 9_000, 12_000), (2, 50, 100)], "episode_id long, start_ms long, end_ms long")
    got = {r.clip_id: r.quiet for r in E.quiet_start(clips, segments).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": True}  # a: 300 + 250 ms of 1000 are covered
    right = segments.withColumnsRenamed({"start_ms": "s2", "end_ms": "e2"})
    met = patterns.range_join(clips.union(clips.where("clip_id = 'd'")), right, "episode_id", ("start_ms", "end_ms"), ("s2", "e2"), lambda a, b: (F.col("s2") >= F.col("start_ms")) & (F.col("e2") <= F.col("end_ms")), how="left")
    assert sorted((r.clip_id, r.s2 is not None) for r in met.collect()) == [("a", True), ("a", True), ("b", False), ("c", False), ("d", True), ("d", True)]


def test_titles_keep_apart(spark):
    rows = [(1, "a", 0.9, "red apples and pears"), (1, "b", 0.89, "red apples and pears"), (1, "c", 0.8, "ships at sea"), (2, "d", 0.1, None)]
    got = E.diversify_titles(spark.createDataFrame(rows, "episode_id long, clip_id string, final_score double, title string")).orderBy("episode_id", "pick").collect()
    assert [r.clip_id for r in got] == ["a", "c", "b", "d"]


def test_spelled_out_domains(spark):
    texts = ["go to a c m e dot com now", "visit acme dot io", "a-c-m-e.com", "dot com", "ab dot com", "x" * 30_000 + " dot net", "word " * 20_000]
    assert values(spark, lambda t: t.rlike(features.SPELLED), texts) == [True, True, True, False, False, True, False]


def test_contradiction_and_doubled_cue(spark):
    assert values(spark, lambda t: F.round(features.hook_v4(t), 6), ["zzz", "the secret", "most think but actually"]) == [0.2, 0.5, 0.35]


def test_hook_cuts_its_tokens_once(spark):
    text = spark.createDataFrame([("Why does nobody tell you? I built this, what if it grew 40%? Here's the truth.",)], "text string")
    rows = text.select(E.hook_v5_enhanced(F.col("text"), [("a", r"\bwhat if\b", 0.2), ("b", r"\bi built\b", 0.1)]).alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1 and 0 < rows.first().x < 1
