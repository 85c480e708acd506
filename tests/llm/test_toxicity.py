"""Toxicity: exact neighbours against all cosines, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np

from cliploom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_neighbours_equal_brute_force():
    make = random.Random(2)
    terms = 60
    at = [sorted(make.sample(range(terms), make.choice([0, 1, 1, 2, 3, 8]))) for _ in range(700)]
    n = [[make.randint(1, 4) for _ in a] for a in at]
    idf = np.array([1 + make.random() * 5 for _ in range(terms)])
    index = toxicity.BlockMaxIndex(list(range(700)), [i % 2 for i in range(700)], at, n, idf, block=16)
    dense = np.zeros((len(index.ids), terms))
    for place, i in enumerate(index.ids):
        dense[place, at[i]] = toxicity.weights(at[i], n[i], idf)
    for i in range(0, 700, 3):
        if not at[i]:
            continue
        query = np.zeros(terms)
        query[at[i]] = toxicity.weights(at[i], n[i], idf)
        cosine = np.round(dense @ query, 6)
        for without in (None, i):
            found = index.search(at[i], n[i], 15, without)
            allowed = cosine[index.ids != without] if without is not None else cosine
            assert np.allclose([c for c, _ in found], sorted(allowed[allowed > 0], reverse=True)[:15], atol=2e-6)
            assert all(abs(cosine[e] - c) < 2e-6 and index.ids[e] != without for c, e in found) and len({e for _, e in found}) == len(found)


def test_curve_rises_through_the_shares():
    votes, labels = np.array([0.1, 0.1, 0.2, 0.4, 0.4, 0.9, 0.9]), np.array([0, 0, 1, 0, 0, 1, 1])
    x, y = toxicity.isotonic(votes, labels, np.array([1, 1, 1, 1, 1, 2, 3]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] == 0 and y[-1] == 1
    assert np.interp(0.4, x, y) == 1 / 3


def test_curve_keeps_equal_votes_together():
    """Votes that part the labels but for two clean examples among toxic ones: the curve once fell into one pool, and no text was toxic."""
    for votes, labels, times in (([0.0, 1.0, 1.0], [0, 0, 1], [15_000, 2, 1_700]), ([1.0, 0.0, 1.0, 0.0], [1, 1, 0, 0], [1_700, 3, 2, 15_000])):
        x, y = toxicity.isotonic(np.array(votes), np.array(labels), np.array(times))
        assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and np.interp(0.0, x, y) < 0.01
        assert np.isclose(np.interp(1.0, x, y), 1_701 / 1_703)
    x, y = toxicity.isotonic(np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    assert list(np.interp([0.0, 1.0], x, y)) == [0.0, 1.0]


def test_held_out_accuracy(spark):
    model, counted = toxicity.fit(spark, *(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    got = {r.doc_id: (r.score, r.evidence) for r in toxicity.score(spark, counted, model).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= s <= 1 for s, _ in got.values())
    held = [(got[i][0], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0 and i in got]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum(s >= 0.5 for s in bad) >= 0.85 * len(bad) and sum(s >= 0.5 for s in good) <= 0.02 * len(good)
    assert all(zlib.crc32(str(e.doc_id).encode()) % 5 and labels[e.doc_id] == e.toxic for _, found in got.values() for e in found)


def test_odd_rows(spark):
    words = ["calm", "river", "stone", "cloud", "grass"]
    make = random.Random(3)
    rows = [(i, " ".join(make.choices(words, k=8)) + (" awfulword vileword" if i % 3 == 0 else ""), 5, 1, "x") for i in range(120)]
    rows += [(None, "awfulword vileword", 0, 0, "x"), (500, None, 0, 0, "x"), (501, "", 0, 0, "x"), (3, "river " * 200_000, 0, 0, "x"), (502, "AWFULWORD Vileword", 0, 0, "x"), (502, "AWFULWORD Vileword", 0, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, n int, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(3, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    model, counted = toxicity.fit(spark, docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.score(spark, counted, model).collect()]
    assert len(got) == len(rows)
    assert all(s > 0.9 for i, s in got if i in (None, 502)) and all(s < 0.1 for i, s in got if i in (500, 501))
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0))):
        model, counted = toxicity.fit(spark, d, l)
        assert {r.score for r in toxicity.score(spark, counted, model).collect()} <= {0.0}


def test_frequencies_move_once_a_term(spark):
    """Many copies of texts with all the terms: rows grow with the terms and batches, not with what the copies hold."""
    at = [list(range(40))] * 900 + [[3], [], [7, 39]] * 100
    counted = spark.createDataFrame([(a,) for a in at], "at array<int>").coalesce(2)
    moved = toxicity.document_frequencies(counted, 41)
    assert moved.count() <= 2 * 41
    df = np.array([900 + 100 * (t == 3) + 100 * (t in (7, 39)) for t in range(40)] + [0])
    assert np.allclose(toxicity.idf_of(counted, 41, len(at)), np.log((1 + len(at)) / (1 + df)) + 1)


def test_few_words_in_long_texts(spark):
    """Long texts are toxic more often, so common words pass the G test; two telling words among thousands of these must still decide."""
    make = random.Random(5)
    common, calm, bad = [f"com{i}mon" for i in range(30)], [f"ca{i}lm" for i in range(300)], ["awful", "vile", "nasty"]
    rows, labels = [], []
    for i in range(3000):
        toxic = make.random() < 0.1
        long = make.random() < (0.6 if toxic else 0.2)
        words = make.choices(common, [1 / (k + 1) for k in range(30)], k=600) if long else make.choices(calm, k=12)
        for word in make.sample(bad, 2) if toxic else ():
            words.insert(make.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, counted = toxicity.fit(spark, docs, known)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(spark, counted, model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.02 * len(held)
