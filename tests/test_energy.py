"""Worked values of arousal, loops, rates, ad verdicts and floors, and rows with nulls."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import energy


def values(spark, column, texts, *more):
    rows = [(i, t, *m) for i, (t, *m) in enumerate(zip(texts, *more))]
    df = spark.createDataFrame(rows, "id int, text string" + ", genre string" * len(more))
    return [r.v for r in df.select("id", column.alias("v")).orderBy("id").collect()]


def test_text_arousal(spark):
    texts = ["WOW! INSANE fire", "a joke, lol", "a killer joke?", "Good NOW!!!", "", None]
    got = values(spark, energy.text_arousal(F.col("text"), F.col("genre")), texts, ["fantasy_sports", "comedy", "true_crime", None, "comedy", "comedy"])
    assert got == pytest.approx([0.15 + 0.24 + 0.15 + 0.1, 0.24, 0.1 + 0.05, 0.4 + 0.12 + 0.03 + 0.08, 0.0, 0.0])


def test_loopability(spark):
    texts = ["We all win, so we all win,", "Crazy but", "Here's the thing: why? ", "one two three", "and the catch " + "x" * 90, "we all win. So we all win", "", None]
    got = values(spark, energy.loopability_v4(F.col("text")), texts)
    assert got == pytest.approx([0.4, 0.15 + 0.15 + 0.1, 0.2 + 0.15, 0.4, 0.0, 0.0, 0.0, 0.0])


def test_prosody(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 1.0, 3.0), (1, 1, 0.5, 3.0, 3.0), (2, 0, None, 1.0, None), (None, 0, 1.0, 2.0, 2.0)], "episode_id int, id int, a double, b double, c double")
    got = {(r.episode_id, r.id): r.arousal_v2 for r in energy.prosody_mix(df, "a", "b", "c").collect()}
    half = 0.5 * (0.5 * math.tanh(0.75))
    assert got == {(1, 0): pytest.approx(0.3 + 0.4 * (0.5 - half), abs=1e-6), (1, 1): pytest.approx(0.3 + 0.4 * (0.5 + half), abs=1e-6), (2, 0): 0.2, (None, 0): 0.8}


def test_rates_and_ads(spark):
    df = spark.createDataFrame([(0, 10.0, 1, 1, 1800, False, 0.0), (1, 10.0, 2, 1, 0, False, 0.12), (2, 10.0, 2, 1, 0, True, 0.0), (3, 0.0, 0, 0, 0, False, 0.0)], "id int, s double, f int, u int, ms int, done boolean, d double")
    got = df.select("id", energy.rates_pass(*(F.col(c) for c in ("s", "f", "u", "ms", "done", "d"))).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [True, False, True, True]
    found = energy.ad_verdict(F.col("text"), ("honey", "wise"))
    got = values(spark, F.struct(*(c.alias(n) for n, c in found.items())), [" Use CODE x, wise honey", "honey, call 555 123 4567", "see www.a.b", "plain", None])
    assert [(g.ad_penalty, g.is_advertisement, g.confidence, g.reasons) for g in got] == [
        (0.8, True, 0.9, ["ad_phrase: use code", "sponsor: honey"]), (0.7, True, 0.8, ["sponsor: honey", "phone_number"]), (0.6, True, 0.7, ["url"]), (0.0, False, 0.0, []), (0.0, False, 0.0, []),
    ]
    assert values(spark, energy.ad_verdict(F.col("text"))["ad_penalty"], ["honey"]) == [0.0]


def test_adaptive_floor(spark):
    make, rows = random.Random(7), []
    for e in range(40):
        for i in range(make.choice([1, 3, 11, 30])):
            rows.append((e, f"c{i}", 0, make.choice([5_000, 20_000, 40_000] if e % 3 else [20_000, 40_000]), make.choice([None, 0.1, 0.5, make.random()])))
    got = energy.adaptive_floor(spark.createDataFrame(rows, "episode_id int, clip_id string, start_ms long, end_ms long, final_score double"), "episode_id")
    got = {(r.episode_id, r.clip_id): r.floor for r in got.collect()}
    want = {}
    for e in range(40):
        mine = [(r[4] or 0.0, r[3], r[1]) for r in rows if r[0] == e]

        def cut(scores, q):
            scores = sorted(scores)
            return np.percentile(scores[: -max(1, int(0.1 * len(scores)))] if len(scores) > 10 else scores, q)

        micro, normal = [v for v, ms, _ in mine if ms < 14_000], [v for v, ms, _ in mine if 14_000 <= ms <= 28_000]
        base = max(cut(micro, 70), cut(normal, 60)) if micro and normal else cut([v for v, _, _ in mine], 60)
        floor = round(min(base, 0.80) - 0.04, 9)
        want |= {(e, c): floor for v, _, c in mine if v >= floor}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in got)
    assert {e for e, _ in got} == set(range(40))
