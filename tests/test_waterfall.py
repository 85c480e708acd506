"""An episode for each source of end marks."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cliploom.operators import sequence
from cliploom.plans import catalog

SEGMENTS = "episode_id long, seg_idx int, start_ms long, end_ms long, text string, n_words long"
WORDS = "episode_id long, seg_idx int, word_idx long, w string, start_ms long, end_ms long"


def timed(episode, seg, text, start=0):
    return [(episode, seg, i, w, start + 300 * i, start + 300 * i + 250) for i, w in enumerate(text.split())]


def test_each_source(spark):
    many = "One two three. " * 40
    segments = [
        (1, 0, 0, 36_000, many, 120), (1, 1, 36_000, 37_000, "", 0),
        (2, 0, 0, 3_000, "Aa bb. Cc dd.", 4), (2, 1, 3_000, 6_000, "Ee ff. Gg", 3),
        (3, 0, 0, 10_000, "Only. Text!", 2), (3, 1, 10_000, 20_000, "Here?", 1),
        (4, 0, 0, 5_000, "", 0), (4, 1, 5_100, 9_000, None, 0),
        (5, 0, 0, 1_000, None, 0), (5, 1, 2_000, 3_000, "", 9), (5, 2, 3_000, 3_500, "", 0),
        (6, 0, 0, 0, None, 0),
    ]
    words = timed(1, 0, many) + timed(2, 0, "Aa bb. Cc")
    single = timed(2, 0, "Aa bb. Cc dd.") + timed(2, 1, "Ee ff. Gg", 3_000)
    got = {}
    for r in sequence.eos_waterfall(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(words, WORDS), spark.createDataFrame(single, WORDS)).collect():
        got.setdefault((r.episode_id, r.source), []).append(r.t_ms)
    got = {k: sorted(v) for k, v in got.items()}
    assert set(got) == {(1, "episode+enhanced"), (2, "segment"), (3, "fallback"), (4, "segment_boundary"), (5, "gap_fallback")}
    assert len(got[1, "episode+enhanced"]) == 40 and got[2, "segment"] == [550, 3_550]
    assert got[3, "fallback"] == [3_636, 9_090, 10_000, 18_000, 20_000]
    assert got[4, "segment_boundary"] == [5_000, 9_000] and got[5, "gap_fallback"] == [1_000, 3_000, 3_500]


def test_without_words(spark):
    segments = spark.createDataFrame([(3, 0, 0, 10_000, "Only. Text!", 2)], SEGMENTS)
    assert {r.source for r in sequence.eos_waterfall(segments).collect()} == {"fallback"}


def test_thin_marks_either_way(spark):
    marks = spark.createDataFrame([(e, (i * i * 37) % 5_000) for e in range(3) for i in range(60)] + [(1, None)], "episode_id long, t_ms long")
    fold, stream = (sorted(map(tuple, sequence.thin_marks(marks, large_group=n).collect())) for n in (1_000, 0))
    assert fold == stream and len(fold) > 20


@pytest.fixture
def talks(tmp_path):
    """Episode 1 has words enough; 2 to 4 have not, and so few marks that gaps join them, in 2 and 4 at times that the text marks too."""
    turns = {1: ["One two three four. Five"] * 30, 2: ["a b c d e f g"] * 3 + ["H. i j!"], 3: ["Aa bb. Cc"], 4: ["a. b c d e f g"] * 2 + ["h i j k l m n o"], 5: ["", None]}
    rows = [(e, i, "user", t) for e, ts in turns.items() for i, t in enumerate(ts)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(pa.array, zip(*rows))))), tmp_path / "conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("joined", ["10485760", "-1"])
@pytest.mark.parametrize("parts", ["8", "3"])
def test_index_has_each_mark_once_from_the_best_source(spark, talks, parts, joined):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    try:
        rows = [tuple(r) for r in catalog.queries()["c10_eos_index"](spark, talks).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    end = lambda i: 300 * i + 550 * (i // 7) + 250
    at = lambda first, last, pos, size: end(first) - 250 + (end(last) - end(first) + 250) * pos // size
    want = {(1, end(i), "words") for i in range(149) if i % 5 == 3 or i % 7 == 6}
    want |= {(2, end(i), "text") for i in (6, 13, 20, 23)} | {(2, at(21, 23, pos, 7), "text") for pos in (1, 6)}
    want |= {(3, at(0, 2, 5, 9), "text"), (3, end(2), "text")}
    want |= {(4, end(i), "text") for i in (6, 13, 21)} | {(4, at(i, i + 6, 1, 14), "text") for i in (0, 7)}
    assert len(rows) == len(want) and set(rows) == want


def test_index_counts_words_by_their_gaps_and_searches_few_texts(spark, talks, monkeypatch):
    kept, write = {}, sequence.written
    monkeypatch.setattr(sequence, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    found = catalog.queries()["c10_eos_index"](spark, talks)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.episode_id for r in kept["few-words"].collect()} == {2, 3, 4} and kept["gaps"].count() == 150 + 24 + 3 + 22
    assert set(kept) == {"gaps", "few-words", "best-marks"}
