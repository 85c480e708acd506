"""Lexicons as tables: the hits of one expression for each term, whatever their number."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom.operators import joins, phrases, scores

WORDS = "the cat sat on a mat it's été 42 house household of".split()


@pytest.fixture(scope="module")
def docs(spark):
    make = random.Random(3)
    rows = [(i, make.choice([" ", ", ", "  "]).join(w.upper() if make.random() < 0.2 else w for w in make.choices(WORDS, k=make.randint(0, 30)))) for i in range(150)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "the cat sat " * 3000)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def lexicon(spark):
    make = random.Random(4)
    terms = {" ".join(make.choices(WORDS, k=make.randint(1, 4))) for _ in range(130)} | {"a", "old of", "the  cat"}
    return [(f"l{i % 3}", t, ["token", "substring"][i % 2] if " " not in t else "substring", float(i % 5)) for i, t in enumerate(sorted(terms))]


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("per_automaton", [200, 1 << 20])
def test_lexicon_and_genres_the_same_either_way(spark, docs, lexicon, monkeypatch, per_automaton):
    table = spark.createDataFrame(lexicon, "lexicon string, term string, match_mode string, weight double")
    one, two = rows_of(joins.lexicon_match(docs, table, "doc_id")), None
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", per_automaton)
    assert rows_of(joins.lexicon_match(docs, table, "doc_id")) == one
    genres = rows_of(scores.detect_genre(docs, table, "doc_id"))
    monkeypatch.setattr(phrases, "FEW", 10_000)
    two = rows_of(joins.lexicon_match(docs, table, "doc_id"))
    assert one == two and len(one) > 100 and rows_of(scores.detect_genre(docs, table, "doc_id")) == genres


def test_trends_the_same_either_way(spark, docs, lexicon, monkeypatch):
    make = random.Random(5)
    rows = [(c, t.upper() if make.random() < 0.3 else t, w, [make.choice(lexicon)[1], "the cat sat"] if make.random() < 0.3 else None) for c, t, _, w in lexicon]
    table = spark.createDataFrame(rows, "category string, term string, weight double, aliases array<string>")
    joined = rows_of(joins.trend_hits(docs, table, "doc_id"))
    monkeypatch.setattr(phrases, "FEW", 10_000)
    assert joined == rows_of(joins.trend_hits(docs, table, "doc_id")) and len(joined) > 100


def test_plan_does_not_grow_with_terms(spark, docs):
    def plan(n):
        terms = spark.range(n).select(F.concat(F.lit("zq"), "id", F.lit(" "), (F.col("id") + 1)).alias("term"), F.lit("c").alias("category"), F.lit(1.0).alias("weight"), F.lit(None).cast("array<string>").alias("aliases"))
        terms = terms.unionByName(spark.createDataFrame([("the cat", "c", 1.0, None)], terms.schema))
        trend = joins.trend_hits(docs, terms, "doc_id")
        genre = scores.detect_genre(docs, terms.select(F.col("category").alias("lexicon"), "term"), "doc_id")
        return trend, genre, [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (trend, genre)]

    _, _, small = plan(1_000)
    trend, genre, large = plan(100_000)
    assert all(abs(a - b) < 200 for a, b in zip(small, large))
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    side_by_side = {i for i, t in texts.items() if "the cat" in " ".join(re.findall(r"[^\W_]+(?:'[^\W_]+)*", t))}
    assert {r.doc_id for r in trend.collect()} == side_by_side and side_by_side
    inside = {i for i, t in texts.items() if "the cat" in t}
    assert {r.doc_id for r in genre.where("hits = 2").collect()} == inside == {r.doc_id for r in genre.where("hits > 0").collect()} and inside
