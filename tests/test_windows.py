"""Windows by hotness, snapping and bounds on worked cases."""

import re

from pyspark.sql import functions as F

from cliploom.operators import sequence, windows
from cliploom.operators.patterns import range_join

WORDS = "episode_id long, word_idx long, w string, start_ms long, end_ms long"


def said(spark, *rows, episode=1):
    return spark.createDataFrame([(episode, i, w, a, b) for i, (w, a, b) in enumerate(rows)], WORDS)


def marks(spark, *times, episode=1):
    return spark.createDataFrame([(episode, t) for t in times], "episode_id long, t_ms long")


def test_snap_prefers_marks_then_pauses(spark):
    words = said(spark, ("a", 0, 300), ("b", 900, 1200), ("c.", 1300, 1600), ("d", 11_000, 11_200), ("e", 11_300, 11_900))
    centres = spark.createDataFrame([(1, 6_500, 10_000), (1, 6_500, 20_000), (2, 6_500, 10_000)], "episode_id long, centre_ms long, size_ms long")
    rows = windows.snap_to_marks(centres, marks(spark, 1600), words).orderBy("episode_id", "size_ms").collect()
    # the mark at 1600 is not before the target 1500, so the first word after a pause wins; the only close pause is too far from the end
    assert [tuple(r)[3:] for r in rows] == [(900, 11_500, 0.38), (-3_500, 16_500, -0.03), (1_500, 11_500, 0.0)]


def test_snap_takes_the_first_mark_before_and_the_next_after(spark):
    words = said(spark, ("a.", 0, 300), ("b.", 400, 700), ("c", 9_000, 9_300))
    centres = spark.createDataFrame([(1, 5_000, 8_000)], "episode_id long, centre_ms long, size_ms long")
    (row,) = windows.snap_to_marks(centres, marks(spark, 300, 700, 9_500), words).collect()
    assert (row.start_ms, row.end_ms, row.quality) == (300, 9_500, 1.0)


def test_lite_scores_of_one_hop_and_of_silence(spark):
    words = said(spark, ("Why", 0, 200), ("amazing!", 300, 500), ("you", 600, 700), ("know", 800, 900), ("end", 9_000, 9_400))
    got = {r.hop: r for r in windows.lite_scores(words).collect()}
    first, silent = got[0], got[10]
    assert len(got) == 19 and round(first.hook, 9) == 0.1 and round(first.emotion, 9) == 0.1 and round(first.loop, 9) == 0.1
    assert round(first.arousal, 9) == round(0.2 + 0.15 + 0.1 / 21, 9) and round(first.info, 9) == round(4 / 20 * (18 / 4 / 5), 9)
    assert all(silent[c] == 0 for c in windows.SHARES)


def test_bounds_move_to_silence_and_full_stop(spark):
    flow = [(f"w{i}", i * 300, i * 300 + 290) for i in range(60)]
    flow[19] = ("stop.", 5_700, 5_750)  # 250 ms of silence before the word at 6000
    words = said(spark, *flow)
    clips = spark.createDataFrame([(1, "a", 6_300, 15_000), (1, "short", 1_000, 3_000), (2, "none", 0, 9_000)], "episode_id long, clip_id string, start_ms long, end_ms long")
    got = {r.clip_id: (r.start_ms, r.end_ms) for r in windows.refine_by_cues(clips, words).collect()}
    assert got["short"] == (1_000, 3_000) and got["none"] == (0, 9_000)
    assert got["a"][0] == 5_950  # the nearest place in the silence cell of "stop."
    assert windows.refine_by_cues(clips.limit(0), words).count() == 0


def test_discovery_of_nothing_and_of_one_hot_place(spark):
    quiet = [("word", i * 500, i * 500 + 400) for i in range(200)]
    quiet[100] = ("why?!", 50_000, 50_400)
    words = said(spark, *quiet)
    rows = windows.discover_windows(words, marks(spark, 45_000, 60_000), least_heat=0.0).collect()
    assert rows and all(r.start_ms <= 50_000 < r.end_ms for r in rows if r.rank == 1)
    assert windows.discover_windows(words.limit(0), marks(spark, 1), least_heat=0.0).count() == 0


def test_lite_scores_read_their_words_once_and_meet_them_across_blocks(spark):
    edges = [(f"w{i}", t, t + 40) for i, t in enumerate((0, 5_999, 6_000, 9_500, 10_000, 10_001, 60_000))]
    words = said(spark, *edges)
    scores = windows.lite_scores(words)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    got = {r.hop: round(r.info, 9) for r in scores.collect()}
    heard = {hop: [w for w, t, _ in edges if abs(t - hop * 500) <= 2_000] for hop in range(121)}
    want = {hop: round(len(ws) / 20 * (sum(map(len, ws)) / len(ws) / 5), 9) if ws else 0.0 for hop, ws in heard.items()}
    assert got == want
    assert "Join" not in plan and plan.count("Scan ") == 1


def test_peaks_are_counted_and_read_from_one_table(spark):
    curve = spark.createDataFrame([(1, i, 99, (i * 37) % 11) for i in range(100)], "episode_id long, hop long, last long, hot long")
    peaks = windows.hot_peaks(curve)
    assert peaks.count() and any("maxima-" in f for f in peaks.inputFiles())


def test_joins_of_windows_send_no_side_to_every_task(spark):
    words = said(spark, ("a.", 0, 300), ("b.", 400, 700), ("c", 9_000, 9_300))
    centres = spark.createDataFrame([(1, 5_000, 8_000)], "episode_id long, centre_ms long, size_ms long")
    curve = spark.createDataFrame([(1, i, 30, 5) for i in range(31)], "episode_id long, hop long, last long, hot long")
    tops = spark.createDataFrame([(1, 10)], "episode_id long, hop long")
    met = range_join(centres.withColumn("to", F.col("centre_ms") + 1), words, "episode_id", ("centre_ms", "to"), ("start_ms", "end_ms"), lambda a, b: F.lit(True))
    found = windows.hot_windows(tops, curve, marks(spark, 300, 9_500), words)
    for df in (met, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and re.search("hop|_bin|centre_ms|_a#|_b#", line)]
        assert "SortMergeJoin" in plan and not sent


def test_refine_grid_counts_the_joined_text_and_moves_no_text(spark):
    texts = [(0, 4_000, " a b\t"), (4_000, 8_000, "   "), (8_000, 12_000, "\tc  d e "), (12_000, 16_000, None), (16_000, 20_000, "f g\n")]
    segments = spark.createDataFrame([(1, i, a, b, t) for i, (a, b, t) in enumerate(texts)], "episode_id long, seg_idx int, start_ms long, end_ms long, text string")
    spans = {"x": (4_200, 11_900), "y": (0, 4_300), "z": (12_600, 15_800), "far": (90_000, 99_000)}
    clips = spark.createDataFrame([(1, k, a, b) for k, (a, b) in spans.items()], "episode_id long, clip_id string, start_ms long, end_ms long")

    def value(a, b):
        inside = [t for s, e, t in texts if min(e, b) - max(s, a) > 500]
        seconds = (b - a) / 1000
        return inside and round(len(re.split(r"\s+", " ".join(t for t in inside if t is not None).strip(" "))) / seconds - abs(seconds - 18) / 18, 6)

    steps = range(-600, 601, 300)
    want = {k: max(((v, -s, -e) for s in (max(a + i, 0) for i in steps) for e in (b + j for j in steps) if (v := value(s, e)) or v == 0), default=None) for k, (a, b) in spans.items()}
    refined = sequence.refine_grid(clips, segments)
    assert "text" not in [line for line in refined._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line or "Generate" in line].__str__()
    assert {r.clip_id: (r.value, -r.start_ms, -r.end_ms) for r in refined.collect()} == {k: v for k, v in want.items() if v}


def test_cues_read_their_text_once(spark):
    texts = spark.createDataFrame([("Never MIND",), ("mind",)], "w string")
    found = texts.select(windows._holds(F.lower("w"), ("never", "why", "how")).alias("x"))
    assert found._jdf.queryExecution().analyzed().toString().count("lower(") == 1 and [r.x for r in found.collect()] == [1, 0]
