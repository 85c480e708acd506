"""Emotion of a text with scope: families of words under negation, balance, intensity, arc and empathy.

One expression of built-in functions over a text. The matches of a family are taken from left to right in one fold that
carries the last words read, so a negation counts for the three words after it and no prefix is read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators.evidence import flag, python_trim, whole
from cliploom.operators.features import clamp, saturate

# Families, negations, polar words, marks and weights.
FAMILIES = {
    "anger": r"angry|furious|mad|irritat(?:ed|ing)|rage|pissed|enrag(?:e|ed)",
    "fear": r"afraid|terrified|scared|anxious|panic|frighten(?:ed)?|horror|nightmare|terrifying",
    "sad": r"sad|devastat(?:ed|ing)|heartbroken|depress(?:ed|ing)|mourning|grief|heartbreaking",
    "joy": r"happy|thrilled|excited|joy|delight(?:ed)?|proud|relief|relieved|love|exciting|beautiful|hilarious",
    "surprise": r"shocked|jaw[-\s]?dropped|stunned|unbelievable|insane|crazy|wow|mind[-\s]?blown|🤯|shocking",
    "disgust": r"disgust(?:ed|ing)|gross|nauseat(?:ed|ing)|repuls(?:e|ed)",
    "desire": r"want|crave|obsessed|hungry for|itch(?:ing)? to|ambitious|driven|aspire",
    "shame": r"ashamed|embarrass(?:ed|ing)|humiliat(?:ed|ing)|guilty|regret",
    "awe": r"awe(?:some)?|awe[-\s]?inspiring|majestic|breathtaking|staggering|incredible|amazing|unbelievable|mind-blowing",
}
POSITIVE, NEGATIVE = ("joy", "awe", "desire"), ("anger", "fear", "sad", "disgust", "shame")
NEGATORS = ("not", "no", "never", "isnt", "isn't", "dont", "don't", "cannot", "can't", "wont", "won't")
GOOD, BAD = r"\b(great|love|happy|proud|amazing|wow|relief)\b", r"\b(hate|scared|sad|angry|annoying|nightmare|pain)\b"
EMPATHY = r"\b(i felt|made me (feel|cry|smile)|it hurts|i'm proud|i am proud|i'm terrified|i was terrified)\b"
EMOJI = "[😂🤣😭😡😱😍❤💔🤯✨🔥]"
NEGATION_WORDS, CAPS, INTENSITY_CAP, AUDIO_CAP = 3, 3, 0.08 + 0.06, 0.08
WEIGHTS = {"families": 0.45, "valence": 0.20, "intensity": 0.15, "arc": 0.12, "empathy": 0.08}

MARK = "\x01"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), 0)


def signed_hits(text: Column, pattern: str) -> Column:
    """(sum, n): matches of the pattern, each -1 where a negation is among the three words before it, and how many there are.

    A match inside a word counts that word as the first of the three. Texts without a match cost one search.
    """
    last = lambda ws, n: F.slice(ws, F.greatest(F.size(ws) - (n - 1), F.lit(1)), n)
    ends_inside = lambda t: F.right(t, F.lit(1)).rlike("[A-Za-z']")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (evaluates `value` once)

    def after(before: Column, piece: Column, total: Column) -> Column:
        """The last four words of what has been read, whether it ends inside a word, and the sum."""
        return once(tokens(F.concat(before, piece)), lambda ws: F.struct(last(ws, 4).alias("ws"), ends_inside(piece).alias("inside"), total.alias("sum")))

    def step(s: Column, piece: Column) -> Column:
        # Inside a word, the unfinished word is the nearest of the three and no negation itself.
        near = F.when(s["inside"], last(F.slice(s["ws"], 1, F.greatest(F.size(s["ws"]) - 1, F.lit(0))), NEGATION_WORDS - 1)).otherwise(last(s["ws"], NEGATION_WORDS))
        sign = F.when(F.exists(near, lambda w: w.isin(*NEGATORS)), -1).otherwise(1)
        return after(F.concat(F.array_join(s["ws"], " "), F.when(s["inside"], "").otherwise(" ")), piece, s["sum"] + sign)

    def fold(pieces: Column) -> Column:
        start = after(F.lit(""), F.get(pieces, F.lit(0)), F.lit(0))
        return F.struct(F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda s: s["sum"]).alias("sum"), (F.size(pieces) - 1).alias("n"))

    pieces = F.split(F.regexp_replace(F.translate(text, MARK, " "), f"(?i)({pattern})", f"{MARK}$1"), MARK)
    return F.when(text.rlike(f"(?i){pattern}"), once(pieces, fold)).otherwise(F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")))


def intensity(text: Column) -> Column:
    caps = F.least(F.lit(CAPS), F.regexp_count(text, F.lit(r"\b[A-Z]{2,}\b")))
    marks = 0.4 * text.rlike("!{2,}").cast("int") + 0.1 * text.rlike(r"\.{3,}").cast("int")
    return F.least(marks + 0.25 * caps / CAPS + 0.15 * F.least(F.lit(1.0), F.regexp_count(text, F.lit(EMOJI)) / 3), F.lit(INTENSITY_CAP))


def arc(text: Column) -> Column:
    """How far the polarity of the last sentence is from that of the first."""
    sentences = F.split(python_trim(text), r"(?<=[.!?])\s+")
    polarity = lambda s: F.tanh(0.6 * (F.regexp_count(s, F.lit(f"(?i){GOOD}")) - F.regexp_count(s, F.lit(f"(?i){BAD}"))))
    moved = F.abs(polarity(F.element_at(sentences, -1)) - polarity(F.element_at(sentences, 1)))
    return F.when(F.size(sentences) >= 2, F.least(moved, F.lit(1.0))).otherwise(0.0)


def emotion_columns(df: DataFrame, text: str = "text", audio: str | None = None) -> DataFrame:
    """`df` with emotion_<family> (signed hits), emotion_intensity, emotion_arc, emotion_empathy and emotion_raw from 0 to 1.

    emotion_raw is 1 - (1 - a)(1 - b)... over the weighted parts; `audio` is a column of at most 0.08 that joins them.
    Texts of under three characters have 0. Null counts as empty.
    """
    t = whole(F.col(text))
    rows = df.withColumns({f"_{name}": signed_hits(t, pattern) for name, pattern in FAMILIES.items()})
    hits = reduce(lambda a, b: a + b, (F.col(f"_{n}.n") for n in FAMILIES))
    rows = rows.withColumns({f"emotion_{n}": F.col(f"_{n}.sum") for n in FAMILIES} | {"_hits": hits}).drop(*(f"_{n}" for n in FAMILIES))
    rows = rows.withColumns({"emotion_intensity": intensity(t), "emotion_arc": arc(t), "emotion_empathy": flag(t, EMPATHY)})
    summed = lambda names: F.greatest(F.lit(0), reduce(lambda a, b: a + b, (F.col(f"emotion_{n}") for n in names)))
    pos, neg = summed(POSITIVE), summed(NEGATIVE)
    balance = (F.tanh(0.6 * (pos - neg) / F.greatest(F.lit(1), pos + neg)) + 0.54) / 1.08
    parts = {"families": F.tanh(0.35 * F.col("_hits")), "valence": balance, "intensity": F.col("emotion_intensity"), "arc": F.col("emotion_arc"), "empathy": F.col("emotion_empathy")}
    weighed = [clamp(parts[n] * w) for n, w in WEIGHTS.items()]
    if audio:
        weighed.append(clamp(F.least(F.coalesce(F.col(audio), F.lit(0.0)), F.lit(AUDIO_CAP))))
    raw = F.when(F.length(python_trim(t)) < 3, 0.0).otherwise(clamp(saturate(weighed)))
    return rows.withColumn("emotion_raw", raw).drop("_hits")
