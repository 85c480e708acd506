"""Emotion under negation, n-gram tables and NFKC: worked values and plain versions."""

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from cliploom.operators import emotion, stats
from cliploom.sources import transcripts as T

TEXTS = [
    "I am not happy.", "I am happy, never sad.", "unhappy", "not one two three happy", "not one two happy", "cannothappy", "don't ever crave love", "Happy happy joy", "I'm nothappy", "",
    None, "ok", "It was great. It was a nightmare of pain.", "WOW!! NASA OK... 🔥🔥", "ÉAUXREÉ JOY", "I felt it. It hurts", "not\x01happy",
]


def plain(text):
    """Signed hits of each family, and the raw value, word by word."""
    text = (text or "").replace("\x01", " ")
    toks, out, n = re.findall("[A-Za-z']+", text.lower()), {}, 0
    for name, pattern in emotion.FAMILIES.items():
        out[name] = 0
        for m in re.finditer(pattern, text, re.I):
            at = len(re.findall("[A-Za-z']+", text[: m.start()].lower()))
            out[name] += -1 if set(toks[max(0, at - 3) : at]) & set(emotion.NEGATORS) else 1
            n += 1
    sentences = re.split(r"(?<=[.!?])\s+", text.strip())
    polarity = lambda s: math.tanh(0.6 * (len(re.findall(emotion.GOOD, s, re.I)) - len(re.findall(emotion.BAD, s, re.I))))
    arc = min(1.0, abs(polarity(sentences[-1]) - polarity(sentences[0]))) if len(sentences) > 1 else 0.0
    pos, neg = (max(0, sum(out[f] for f in fs)) for fs in (emotion.POSITIVE, emotion.NEGATIVE))
    loud = min(0.14, 0.4 * bool(re.search("!{2,}", text)) + 0.1 * bool(re.search(r"\.{3,}", text)) + 0.25 * min(1, len(re.findall(r"\b[A-Z]{2,}\b", text)) / 3) + 0.15 * min(1, len(re.findall(emotion.EMOJI, text)) / 3))
    balance = (math.tanh(0.6 * (pos - neg) / max(1, pos + neg)) + 0.54) / 1.08
    parts = [0.45 * math.tanh(0.35 * n), 0.2 * balance, 0.15 * loud, 0.12 * arc, 0.08 * bool(re.search(emotion.EMPATHY, text, re.I))]
    raw = 1 - math.prod(1 - max(0, min(1, p)) for p in parts)
    return out, 0.0 if len(text.strip()) < 3 else raw


def test_emotion_equals_a_plain_version(spark):
    rows = emotion.emotion_columns(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")).orderBy("id").collect()
    for r, text in zip(rows, TEXTS):
        hits, raw = plain(text)
        assert {n: r[f"emotion_{n}"] for n in hits} == hits, text
        assert math.isclose(r.emotion_raw, raw, abs_tol=1e-9), text
    assert [r.emotion_joy for r in rows[:8]] == [-1, 1, 1, 1, -1, 1, -1, 3] and rows[0].emotion_raw < rows[1].emotion_raw


def test_ngram_table(spark):
    texts = ["The cat of the cat", "", None, "one", "a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = Counter()
    for t in texts:
        ws = re.findall(r"[^\W_']+", (t or "").lower())
        for n in (1, 2, 3):
            want.update((n, " ".join(ws[i : i + n])) for i in range(len(ws) - n + 1) if "the" not in (ws[i], ws[i + n - 1]))
    assert {(r.n, r.ngram): r["count"] for r in stats.ngram_table(docs, stop=("the",)).collect()} == dict(want)
    assert stats.ngram_table(docs, key="doc_id", least=2).where("doc_id = 4").count() == 3 + 2 + 1


def test_nfkc(spark):
    texts = ["été", "ﬁsh ① １２３ ½", "plain", "", None, "‘a’ “b” — …  x", "Ｗｏｗ！", "Åẛ̣"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.normalize_text(F.col("text")).alias("t")).orderBy("id").collect()
    table = str.maketrans("‘’‚“”„‐‑‒–—− ", "'''\"\"\"------ ")
    assert [r.t for r in rows] == [None if t is None else unicodedata.normalize("NFKC", t).translate(table).replace("…", "...") for t in texts]
    assert rows[0].t == "été" and rows[1].t.startswith("fish 1 123")


def test_ngrams_leave_a_slice_once(spark, monkeypatch):
    """Copies are counted before they move, and slices cut between texts add up."""
    docs = spark.createDataFrame([("one two one two",), ("",), ("two",), (None,)] * 500, "text string").coalesce(1)
    want = {(1, "one"): 1_000, (1, "two"): 1_500, (2, "one two"): 1_000, (2, "two one"): 500, (3, "one two one"): 500, (3, "two one two"): 500}
    for size in (stats.NGRAM_BYTES, 100):
        monkeypatch.setattr(stats, "NGRAM_BYTES", size)
        found = stats.ngram_table(docs)
        assert {(r.n, r.ngram): r["count"] for r in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
