"""Cases of the training-data operators that need the whole job done."""

import random
from collections import Counter

from cliploom.llm import minhash


def edited_copies(n=60, words=140, seed=6):
    """Copies of one text, which is not among them, with two words changed in each: some pairs are similar, most are just not."""
    make = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        copy = list(base)
        for at in make.sample(range(5, words - 5), 2):
            copy[at] = f"x{k}at{at}"
        out.append(copy)
    return out


def test_every_pair_of_a_band_counts(spark):
    docs = edited_copies()
    bags = [Counter(tuple(d[i : i + 5]) for i in range(len(d) - 4)) for d in docs]
    root = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(docs)


def test_one_document_of_each_class(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("e")), (None, text("e")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in minhash.stage(spark, docs, "").collect())
    assert kept == Counter([(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (None, None)])
    keys = {r.class_key for r in minhash.classes(docs).where("text_key is not null").collect()}
    assert len(keys) == 5


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, "x", 3), (2, "a b c", 2, "y", 3), (3, None, None, None, None)], "doc_id int, text string, kept_id int, whole string, node int")
    kept = minhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.kept_id) for r in kept.collect() if r.text) == [(1, 1)]
    assert minhash.stage(spark, docs.limit(0), "").count() == 0
