"""Similar vectors and what is kept of them, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import joins, selection, vectors


def made(seed=3):
    make = np.random.default_rng(seed)
    rows, ident = [], 0
    for g in (None, 1, 2, 3):
        centres = make.normal(size=(4, 12))
        for i in range(110 if g != 3 else 2):
            kind = make.integers(0, 10)
            x = make.normal(size=12) if kind < 3 else centres[kind % 4] + make.normal(size=12) * make.choice([0.05, 0.2, 0.5])
            rows.append((g, ident, x.round(3).tolist()))
            ident += 1
        rows += [(g, ident + i, centres[0].round(3).tolist()) for i in range(7)]
        ident += 7
    rows += [(1, ident, [0.0] * 12), (1, ident + 1, None), (2, ident + 2, []), (2, ident + 3, [1.0, 2.0]), (2, ident + 4, [2.0, 4.0]), (None, None, [1.0] * 12)]
    return rows


def plain(rows, least):
    unit = [(g, i, np.array(x) / np.linalg.norm(x)) for g, i, x in rows if x and any(x) and i is not None]
    return {(g, a, b): float(x @ y) for g, a, x in unit for h, b, y in unit if g == h and a < b and len(x) == len(y) and x @ y >= least}


@pytest.fixture(scope="module")
def data(spark):
    rows = made()
    return rows, spark.createDataFrame(rows, "label long, vec_id long, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>")).cache()


@pytest.mark.parametrize("least", [0.2, 0.7, 0.95])
@pytest.mark.parametrize("block_rows, pivot_bytes", [(10, 1 << 20), (10, 0), (2_000, 1 << 20)])
def test_pairs_equal_all_pairs(data, monkeypatch, least, block_rows, pivot_bytes):
    rows, df = data
    rows = [(g, i, [float(np.float32(v)) for v in x] if x is not None else None) for g, i, x in rows]
    monkeypatch.setattr(vectors, "PIVOT_BYTES", pivot_bytes)
    monkeypatch.setattr(joins, "similar_pairs", lambda r, n: vectors.similar_pairs(r, n, block_rows))
    monkeypatch.setattr(selection, "similar_pairs", lambda r, n: vectors.similar_pairs(r, n, block_rows))
    want = plain(rows, least)
    got = {(r.label, r.a, r.b): r.similarity for r in joins.cosine_pairs(df, "vec_id", "label", "embedding", least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 50
    gone = set()
    for g, a, b in sorted(want, key=lambda k: (k[2], k[1])):
        if (g, a) not in gone:
            gone.add((g, b))
    kept = {(r.label, r.vec_id) for r in selection.semantic_dedupe(df, "vec_id", "label", "embedding", least).collect()}
    assert kept == {(g, i) for g, i, _ in rows} - gone


def test_blocks_far_apart_do_not_meet(spark):
    make = np.random.default_rng(1)
    centres = make.normal(size=(8, 16))
    rows = [(1, i, (centres[i % 8] + make.normal(size=16) * 0.01).tolist()) for i in range(800)]
    unit = vectors.distinct_vectors(spark.createDataFrame(rows, "label long, vec_id long, embedding array<double>"), "vec_id", "label", "embedding")
    pivots = vectors.pivots_of(unit, unit.groupBy("g").agg(F.count("*").alias("n")), 20)
    blocks = vectors.in_blocks(unit, pivots, 20).cache()
    n = blocks.select("cell", "part").distinct().count()
    met = vectors.meetings(blocks, pivots, 0.95).select("pair").distinct().count()
    assert blocks.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 60 and n >= 20 and met < n * (n + 1) / 2 / 3


def test_chain_is_settled_in_order(spark):
    links = spark.createDataFrame([(None, i, i + 1) for i in range(9)] + [(1, 5, 6), (1, 5, 7), (1, 6, 8)], "g long, a long, b long")
    assert {tuple(r) for r in vectors.first_kept(links).collect()} == {(None, i) for i in (1, 3, 5, 7, 9)} | {(1, 6), (1, 7)}
    assert vectors.first_kept(links.limit(0)).count() == 0


def test_pairs_come_in_slices(monkeypatch):
    """At a low limit most pairs of a block are alike; no more of them are held than a slice, whatever the block's size."""
    import pyarrow as pa

    from cliploom.operators import vectors

    monkeypatch.setattr(vectors, "COSINES", 600)
    monkeypatch.setattr(vectors, "PAIRS", 100)
    make = np.random.default_rng(4)
    x = make.normal(size=(60, 5)) + 1
    x /= np.linalg.norm(x, axis=1)[:, None]
    for sides in ([2] * 60, [0] * 25 + [1] * 35):
        rows = [(s, 1_000 - i, v) for i, (s, v) in enumerate(zip(sides, x))]
        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
        slices = list(vectors.pairs_of(left, right, 0.2, pa.int64()))
        assert len(slices) > 5 and all(len(a) == len(b) == len(c) <= 100 for a, b, c in slices)
        got = {(p, q): c for a, b, cs in slices for p, q, c in zip(a.to_pylist(), b.to_pylist(), cs)}
        want = {(min(p, q), max(p, q)): v @ w for s, p, v in left for t, q, w in right if (s != 2 or p < q) and v @ w >= 0.2}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vectors_of_a_sliced_batch():
    import pyarrow as pa

    from cliploom.operators import vectors

    column = pa.array([[1.0, 2.0], [], [3.0], [4.0, 5.0, 6.0]], pa.list_(pa.float64()))[1:]
    assert [v.tolist() for v in vectors.arrays_of(column)] == [[], [3.0], [4.0, 5.0, 6.0]]
