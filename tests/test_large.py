"""Selection in large groups: the rows of the fold, whichever way a group is taken, and one group of a million rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import large, patterns, selection, sequence

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def clips(spark):
    make = random.Random(11)
    rows = []
    for episode in [None, *range(12)]:
        for i in range(make.choice([1, 5, 40, 90])):
            start = make.choice([None, *[make.randint(0, 60_000) for _ in range(20)]])
            end = make.choice([None, *[(start or 0) + make.choice([0, -500, 40, 900, 3_000, 3_000, 12_000, 50_000]) for _ in range(20)]])
            text = make.choice([None, "", *[" ".join(make.choices(WORDS, k=make.randint(1, 9))) for _ in range(20)]])
            rows.append((episode, f"c{episode}-{i}", start, end, make.choice([0.1, 0.5, 0.5, make.random()]), text, bool(i % 2)))
    return spark.createDataFrame(rows, "episode_id long, clip_id string, start_ms long, end_ms long, final_score double, text string, finished boolean").cache()


RULES = [
    large.Overlap(0.55), large.Overlap(0.2, hull=True), large.Touch(), large.Near(("start_ms", "end_ms"), 700), large.Near(("start_ms",), 4_000),
    large.Alike("ws", 0.6), large.Alike("ws", 0.3, near_ms=9_000), large.AnyOf((large.Overlap(0.4), large.Alike("ws", 0.5))), large.AnyOf((large.Near(("start_ms",), 900), large.Shared("ws", 3))),
]


@pytest.mark.parametrize("rule", RULES, ids=str)
@pytest.mark.parametrize("limit", [None, 4])
def test_stream_equals_fold(clips, rule, limit):
    rows, fields = selection.with_words(clips), ["clip_id", "start_ms", "end_ms", "final_score", "ws"]
    take = lambda n: sorted(map(repr, patterns.greedy_keep(rows, "episode_id", selection.best_first(), fields, rule, limit, large_group=n).collect()))
    fold = take(1_000_000)
    assert take(0) == fold == take(40) and len(fold) > 12


def test_plain_functions_still_fold(clips):
    touch = lambda k, c: (k["start_ms"] < c["end_ms"]) & (k["end_ms"] > c["start_ms"])
    fields = ["clip_id", "start_ms", "end_ms"]
    one = patterns.greedy_keep(clips, "episode_id", selection.best_first(), fields, touch)
    two = patterns.greedy_keep(clips, "episode_id", selection.best_first(), fields, large.Touch())
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_merged_seeds_stream_equals_fold(spark):
    make = random.Random(4)
    rows = []
    for episode in range(8):
        at = 0
        for i in range(make.choice([1, 3, 50])):
            at += make.choice([0, 100, 400])
            end = at + make.choice([900, 5_000, 9_000, 20_000])
            rows.append((episode, i, at, end, make.choice(["a", "a", "b", None]), make.choice(["x y", "", None, "z."])))
            at = end
    segments = spark.createDataFrame(rows, "episode_id long, seg_idx int, start_ms long, end_ms long, speaker string, text string")
    fold, stream, mixed = (sorted(map(repr, sequence.merge_short_seeds(segments, large_group=n).collect())) for n in (10_000, 0, 10))
    assert fold == stream == mixed and 8 < len(fold) < len(rows)


def test_one_group_of_a_million(spark):
    """Kept clips do not overlap too much, and every clip that is gone overlaps a better one that was kept."""
    n = 1_000_000
    start, length = F.pmod(F.xxhash64("id"), F.lit(40_000_000)), 5_000 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60_000))
    clips = spark.range(n).select(F.lit(1).alias("episode_id"), F.col("id").alias("clip_id"), start.alias("start_ms"), (start + length).alias("end_ms"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 20)) / (1 << 20)).alias("final_score"))
    rows = clips.toPandas()
    kept = selection.nms(clips).toPandas()
    assert 1_000 < len(kept) < n / 5 and kept["pick"].max() == len(kept)
    s, e, score = (kept[c].to_numpy() for c in ("start_ms", "end_ms", "final_score"))

    def share(a, b):
        common = np.clip(np.minimum(e, b) - np.maximum(s, a), 0, None)
        return common / ((e - s) + (b - a) - common)

    for i in random.Random(1).sample(range(len(kept)), 200):
        assert (share(s[i], e[i]) >= 0.55).sum() == 1
    gone = rows[~rows.clip_id.isin(kept.clip_id)].sample(300, random_state=1)
    for r in gone.itertuples():
        assert ((share(r.start_ms, r.end_ms) >= 0.55) & (score >= r.final_score)).any()
