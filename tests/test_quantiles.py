"""Exact quantiles against DuckDB, on both sides of the switch and over several refinements."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cliploom.operators import quantiles as Q
from cliploom.operators import stats


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r[:2]))


@pytest.fixture(scope="module")
def values(spark):
    make = random.Random(6)
    draw = (lambda: make.random(), lambda: make.choice([0.25, 0.5, 0.5]), lambda: 10 ** make.uniform(-12, 9), lambda: make.gauss(0, 1) * (1e6 if make.random() < 0.01 else 1), lambda: 3.0)
    rows = []
    for g in [None, *range(9)]:
        for _ in range(make.choice([1, 2, 7, 400, 3_000])):
            rows.append((g, make.choice(["a", None]), make.choice([None, *[draw[(g or 0) % 5]() for _ in range(30)]])))
    rows += [(99, "a", None), (3, "a", float("nan"))]
    return spark.createDataFrame(rows, "g int, h string, v double").cache()


def test_quantiles_equal_sql(spark, values, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    monkeypatch.setattr(Q, "BUCKETS", 16)
    shares = (0.0, 0.1, 0.25, 0.5, 0.6, 0.999, 1.0)
    names = [f"q{i}" for i in range(len(shares))]
    pdf = values.where("not coalesce(isnan(v), false)").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("t", pdf)
    sql = "select case when isnan(g::double) then null else g::int end as g, h, " + ", ".join(f"quantile_cont(v, {q}) as {n}" for q, n in zip(shares, names))
    want = sorted(con.sql(sql + " from t where v is not null and not isnan(v) group by 1, 2").fetchall(), key=lambda r: tuple((x is None, str(x)) for x in r[:2]))
    for limit in (1_000_000, 0, 300):
        got = rows_of(Q.quantiles(values, ["g", "h"], "v", shares, names, limit))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert all(a == pytest.approx(b, rel=1e-12, abs=1e-15) for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))
    monkeypatch.setattr(Q, "BROADCAST_RANGES", 0)
    assert rows_of(Q.quantiles(values, ["g", "h"], "v", shares, names, 0)) == got


def test_one_group_of_a_million(spark):
    df = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    want = sorted(r.v for r in df.collect())
    found = Q.order_statistics(df, [], "v", lambda n: [F.floor(n * k / 4) for k in (0, 1, 2, 3, 4)]).first()
    assert found.n == 1_000_000 and found["at"] == [want[0], want[250_000], want[500_000], want[750_000], want[-1]]


def test_bands_and_gates_the_same_either_way(spark):
    make = random.Random(8)
    rows = [(i % 5, f"c{i}", (s := make.randint(0, 3_000_000)), s + make.choice([9_000, 16_000, 22_000, 29_000, 45_000, 90_000]), make.choice([0.4, make.random()])) for i in range(2_000)]
    clips = spark.createDataFrame(rows, "episode_id long, clip_id string, start_ms long, end_ms long, final_score double")
    for run in (
        lambda n: stats.band_norm(clips, [], large_group=n), lambda n: stats.band_norm(clips, ["episode_id"], large_group=n),
        lambda n: stats.calibrate(clips, "final_score", "median", large_group=n), lambda n: stats.calibrate(clips, "final_score", "median", "episode_id", large_group=n),
        lambda n: stats.percentile_gate(clips, "episode_id", large_group=n),
    ):
        assert sorted(map(repr, run(10_000).collect())) == sorted(map(repr, run(50).collect()))


def test_empty(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert Q.quantiles(empty, ["g"], "v", (0.5,), ("m",)).count() == 0 and Q.quantiles(empty, ["g"], "v", (0.5,), ("m",), 0).count() == 0
