"""Columns that weigh evidence in a text: payoffs, questions and lists, hooks, confidence, genre patterns, endings.

All are expressions of built-in functions over one text, so any number of them is one scan. Null texts give the value
of an empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.features import any_hit, clamp, hits, noun_burst, saturate, sigmoid, words
from cliploom.operators.patterns import range_join
from cliploom.operators.quantiles import quantiles

# --- fixed values ------------------------------------------------------------------------------------------------

#: Cue phrases and patterns of the payoff rules.
UNCERTAIN = ("maybe", "might", "could", "kinda", "sort of", "somewhat", "probably", "possibly", "perhaps", "i think", "i guess", "i feel like")
RESOLVED = (
    r"(so|therefore|thus|as a result|consequently)|(the answer is|the solution is|here's how)|(that's why|which explains|this means)"
    r"|(in conclusion|to sum up|the bottom line)"
)
VALUE = (
    r"(here's what|the key|the secret|the trick)|(you should|you need to|you must|you have to)|(this will|this can|this helps|this makes)"
    r"|(the benefit|the advantage|the upside)"
)
SPORTS = r"(start|bench|target|avoid|sleeper|bust)|(this week|next week|playoffs|season)|(league winner|championship|title)"
ANSWERS = ("answer", "solution", "here's", "the key")
SHOWN = (
    r"here('?s)? (how|why|the deal|what you need)|the (solution|answer|truth|key)|because|so that|which means|in other words|this means"
    r"|the (lesson|takeaway|insight|bottom line)|(therefore|thus|that's why)|turns out"
)
RESOLUTION = r"\b(because|so that|which means|so you can|therefore|as a result|that's why)\b"
PAYOFF_LEADS = (
    r"\bthe (?:bottom|top) line\b", r"\btl;?dr\b", r"\bhere(?:'|')?s (?:the|what)\b", r"\bso (?:the|what this) (?:means|is)\b", r"\bnet[-\s]?net\b",
    r"\bkey takeaway\b", r"\bin (?:short|summary)\b", r"\bthe answer is\b", r"\bthe play (?:here|now) is\b", r"\bmy advice\b", r"\bpro tip\b",
    r"\bdo this\b", r"\byou should\b", r"\bthe trick is\b", r"\bhere(?:'|')?s how\b", r"\bstep(?:s)? to\b", r"\bstop doing\b", r"\bstart doing\b",
    r"\btherefore\b", r"\bbecause\b",
)
PAYOFF_NOT = (r"\bsubscribe\b", r"\bfollow\b", r"\bsmash (?:that )?like\b", r"\bcheck (?:the )?link\b", r"\bjoin (?:my|our)\b")
AMOUNT = r"(?:\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b|\b\d+%|\$\d+(?:\.\d+)?)"
CONCLUDES = r"\b(so|hence|therefore|that means|in short)\b"

#: Patterns of the question and list rules.
QUESTION_WORDS = r"\b(what|why|how|when|where|which|who)\b"
COMPARED = r"\b(vs\.?|versus|better than|worse than|compare(?:d)? to)\b"
CHOICE = r"\b(which|pick|choose|would you rather|either|or)\b"
RHETORICAL = r"\b(you know|right|isn't it|don't you think|agree)\b"
CLIFF = r"\b(what if|imagine|suppose|what would happen|what do you think)\b"
GENUINE = r"\b(genuinely|honestly|really|truly|actually)\b"
LIST_WORDS = r"\b(first|second|third|fourth|fifth|last|finally|next|then|also|additionally|moreover|furthermore)\b"
LIST_ITEM = r"\d+\.\s+[^.!?]+[.!?]?"
BAIT = r"\b(you won't believe|shocking|amazing|incredible|unbelievable|mind-blowing)\b"
VACUOUS = r"\b(what do you think|what's your opinion|agree\?|right\?|you know\?)\b"
GENRE_TWEAKS = {"education": (0.00, 0.03), "entertainment": (0.03, 0.00), "linkedin": (0.00, 0.02)}

#: Kinds of evidence of the hook, its starters and fillers.
HOOK_EVIDENCE = {
    "numbers": r"\b\d+(?:\.\d+)?(?:%|k|m|b|\$)?\b",
    "comparisons": r"\b(?:vs\.?|versus|more than|less than|bigger than|smaller than|better than|worse than)\b",
    "contrasts": r"\b(?:but actually|however|on the contrary|surprisingly|unexpectedly|turns out)\b",
    "causal": r"\b(?:because|therefore|so|which means|as a result|consequently)\b",
    "imperatives": r"\b(?:must|should|need to|have to|don't|stop|start|always|never)\b",
    "specifics": r"\b(?:specifically|exactly|precisely|particularly)\b",
    "transitions": r"\b(first|second|third|then|next|finally|additionally)\b",
    "definitions": r"\b(means|defined as|refers to|is when|called)\b",
}
INTRO = r"\b(hey|hi|hello|welcome|thanks for|what's up|good (morning|afternoon|evening))\b"
HOOK_FILLERS = ("uh", "um", "er", "ah", "like", "you", "know", "so", "well", "okay", "ok")
HOOK_STARTERS = ("what", "why", "how", "here's", "listen", "the", "truth", "nobody", "you", "let", "here", "this", "stop", "remember")

#: What raises or lowers confidence in a statement.
CONFIDENCE = (
    (r"(most (people|folks)|everyone|nobody).{0,40}\b(actually|but|instead)\b", 0.10, True), (r"\b\d+(?:\.\d+)?(?:%|k|m|b)?\b", 0.10, True),
    (r"\b(vs\.?|versus|more than|less than|bigger than|smaller than)\b", 0.05, True), (r"\b(because|therefore|so|which means)\b", 0.05, False),
    (r"\b(try|avoid|do|don'?t|stop|start|focus|use|measure|swap|choose|should|need|must)\b", 0.10, False),
    (r"\b(maybe|probably|i think|i guess|kinda|sort of)\b", -0.10, False),
)

#: Fixed values: (genre, feature, weight of a pattern, most, patterns); each pattern counts once.
GENRE_PATTERNS = (
    ("true_crime", "mystery_score", 0.1, 1.0, ("mystery", "case", "investigation", "evidence", "clue", "witness", "suspect", "victim", "crime scene")),
    ("true_crime", "resolution_score", 0.15, 1.0, ("turns out", "the truth", "discovered", "revealed", "finally", "at last", "the answer")),
    ("true_crime", "viral_trigger_boost", 0.1, 0.5, ("the shocking truth", "what they didn't tell you", "the real story", "behind the scenes", "the untold story")),
    ("business", "authority_score", 0.2, 1.0, ("i built", "i founded", "i sold", "i invested", "my company", "my startup", "my experience")),
    ("business", "specificity_score", 0.15, 1.0, (r"\$\d+", r"\d+%", r"\d+ years", r"\d+ months", "revenue", "profit", "customers", "employees")),
    ("educational", "curiosity_score", 0.25, 1.0, ("did you know", "surprisingly", "contrary to", "most people think", "the truth is")),
    ("educational", "clarity_score", 0.2, 1.0, ("here's why", "the reason is", "this means", "in other words", "simply put")),
    ("health", "credibility_score", 0.15, 1.0, ("doctor", "physician", "therapist", "nutritionist", "trainer", "expert", "specialist", "certified", "licensed")),
    ("health", "transformation_score", 0.1, 1.0, ("transform", "change", "improve", "boost", "enhance", "better", "stronger", "healthier", "happier")),
    ("health", "viral_trigger_boost", 0.1, 0.5, ("doctors don't want you to know", "the secret to", "transform your", "natural remedy", "proven method")),
    ("news", "urgency_score", 0.2, 1.0, ("breaking", "just in", "developing", "urgent", "immediate", "right now", "this moment", "critical")),
    ("news", "controversy_score", 0.15, 1.0, ("controversial", "scandal", "outrage", "fury", "anger", "protest", "backlash", "criticism")),
    ("news", "viral_trigger_boost", 0.1, 0.5, ("breaking:", "the real reason", "what nobody's saying", "the truth about", "behind the headlines")),
)
#: Fixed values: (genre, flag, pattern).
GENRE_FLAGS = (
    ("true_crime", "has_case_details", "case|investigation|evidence|witness"), ("true_crime", "has_timeline", r"in \d{4}|when|then|after|before"),
    ("true_crime", "has_resolution", "turns out|the truth|discovered|revealed"), ("health", "has_credentials", "doctor|physician|therapist|nutritionist|trainer"),
    ("health", "has_benefits", "benefits|improve|boost|enhance|better"), ("health", "has_actionable", "here's how|try this|start with|focus on"),
    ("news", "has_breaking", "breaking|just in|developing"), ("news", "has_timeline", "today|yesterday|this week|recently"),
    ("news", "has_sources", "according to|reports|sources say|official"),
)

#: Cues of a complete thought and of curiosity at the end of a text.
END_CUES = ("that's why", "so that's", "and that's", "which means", "this shows", "proves that", "the point is", "bottom line", "in the end", "finally", "as a result", "so in short", "long story short")
CURIOUS = ("but", "however", "here's why", "the catch", "what you don't", "what no one", "?", "…")


# --- pieces ------------------------------------------------------------------------------------------------------


def flag(text: Column, pattern: str) -> Column:
    """1 where the pattern occurs, in either case."""
    return text.rlike(f"(?i){pattern}").cast("int")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def python_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- payoff ------------------------------------------------------------------------------------------------------


def uncertainty(text: Column) -> Column:
    """Uncertain phrases for each word."""
    found = reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(p)) for p in UNCERTAIN))
    return found / F.greatest(F.regexp_count(text, F.lit("[a-z0-9']+")), F.lit(1))


def unanswered(t: Column) -> Column:
    return (t.contains("?") & ~any_hit(t, ANSWERS)).cast("int")


def payoff_v1(text: Column, genre: Column | None = None) -> Column:
    """Resolution 0.2, value 0.15, sport 0.1 (of its genre); less 0.2 where the middle of a text of 12 words or more is
    not surer than its start by over 0.02, and 0.1 for a question without an answer; texts under 8 characters 0."""
    text = whole(text)
    t, ws = F.lower(text), words(text)
    n = F.size(ws)
    cut = lambda share: F.floor(n * share).cast("int")
    part = lambda a, b: F.lower(F.array_join(F.slice(ws, a + 1, b - a), " "))
    surer = uncertainty(part(F.lit(0), cut(0.40))) - uncertainty(part(cut(0.40), cut(0.70)))
    score = F.when((n >= 12) & (surer <= 0.02), -0.2).otherwise(0.0) + t.rlike(RESOLVED).cast("int") * 0.2 + t.rlike(VALUE).cast("int") * 0.15 - unanswered(t) * 0.1
    if genre is not None:
        score += ((genre == "fantasy_sports") & t.rlike(SPORTS)).cast("int") * 0.1
    return F.when(F.length(python_trim(text)) < 8, 0.0).otherwise(clamp(score))


def tail_hits(text: Column, pattern: str, start: Column, weight: float, more: float, most: int = 5) -> Column:
    """weight for each of the first `most` matches, and `more` for those that begin at `start` or later."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(F.slice(between, 1, most).alias("gap"), F.transform(F.slice(found, 1, most), F.length).alias("size"))
    first = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def add(s: Column, x: Column) -> Column:
        begins = s["at"] + x["gap"]
        here = F.when(begins >= start, weight + more).otherwise(weight)
        return F.struct((begins + F.coalesce(x["size"], F.lit(0))).alias("at"), (s["sum"] + F.when(x["size"].isNotNull(), here).otherwise(0.0)).alias("sum"))

    return F.aggregate(steps, first, add)["sum"]


def payoff_v2(text: Column) -> Column:
    """Struct of score and label (lead, numeric, qa, conclusion or none). Leads 0.25 and amounts 0.12, five of a pattern,
    more in the last 35 %; a question with an answer after it 0.22 or 0.32; a concluding last sentence 0.15; calls to
    act -0.20 each. Above 0.75 a quarter counts. Texts over 1,800 characters are judged by their first and last 900, as
    the rule has it; those under 24 are 0. The text is cut and joined once, as the only element of an array."""
    raw = whole(text)
    long_ = F.concat(F.substring(raw, 1, 900), F.lit(" ... "), F.substring(raw, -900, 900))
    once = F.array(F.array_join(words(F.when(F.length(raw) > 1800, long_).otherwise(raw)), " "))
    none = F.struct(F.lit(0.0).alias("score"), F.lit("none").alias("label"))
    return F.when(F.length(raw) < 24, none).otherwise(F.transform(once, weigh_payoff)[0])


def weigh_payoff(t: Column) -> Column:
    n = F.length(t)
    tail = F.floor(n * 0.65)
    places = lambda p, w, more: F.when(t.rlike(p), tail_hits(t, p, tail, w, more)).otherwise(0.0)
    any_lead = t.rlike("(?i)" + "|".join(PAYOFF_LEADS))
    lead = F.when(any_lead, reduce(lambda a, b: a + b, (places(f"(?i){p}", 0.25, 0.15) for p in PAYOFF_LEADS))).otherwise(0.0)
    at = F.instr(t, "?") - 1
    rest = F.trim(F.substring(t, at + 2, n))
    answered = (at >= 0) & (at < n - 5) & (F.length(rest) > 15) & ~rest.contains("?")
    last = F.element_at(F.filter(sentences(t), lambda s: s != ""), -1)
    ends = F.coalesce(last.rlike(f"(?i){CONCLUDES}"), F.lit(False))
    more = F.when(answered, F.when(at >= F.floor(n * 0.4), 0.32).otherwise(0.22)).otherwise(0.0) + ends.cast("int") * 0.15
    score = clamp(lead + places(AMOUNT, 0.12, 0.08) + more - reduce(lambda a, b: a + b, (flag(t, p) for p in PAYOFF_NOT)) * 0.20)
    score = F.transform(F.array(score), lambda x: F.when(x > 0.75, 0.75 + 0.25 * (x - 0.75)).otherwise(x))[0]
    label = F.when(any_lead, "lead").when(t.rlike(AMOUNT), "numeric").when(answered, "qa").when(ends, "conclusion").otherwise("none")
    return F.struct(score.alias("score"), label.alias("label"))


def payoff_presence(text: Column, markers=()) -> Column:
    """General payoff 0.25, one of the markers 0.15, value 0.15, less 0.1 for a question without an answer."""
    text = whole(text)
    t = F.lower(text)
    marked = any_hit(t, [m.lower() for m in markers]).cast("int") if markers else F.lit(0)
    score = t.rlike(SHOWN).cast("int") * 0.25 + marked * 0.15 + t.rlike(VALUE).cast("int") * 0.15 - unanswered(t) * 0.1
    return F.when(F.length(python_trim(text)) < 8, 0.0).otherwise(clamp(score))


def resolution_bonus(text: Column) -> Column:
    return F.lower(whole(text)).rlike(RESOLUTION).cast("int") * 0.08


def answer_bump(text: Column) -> Column:
    """0.1 where a sentence but the last one asks and the last one ends."""
    s = sentences(whole(text))
    asked = F.exists(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda x: x.endswith("?"))
    return (asked & F.element_at(s, -1).rlike("[.!?]$")).cast("int") * 0.1


# --- questions, emotion, confidence ------------------------------------------------------------------------------


def question_list_v2(text: Column, genre: str = "general") -> Column:
    """Questions and lists, each taking its part of what is left, less bait (0.25 at most) and empty questions (0.20);
    texts under 6 words 0.35, empty ones 0."""
    text = whole(text)
    parts = F.split(python_trim(text), r"[.!?]+\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    mark = last.rlike(r"\?\s*$").cast("int")
    asked = [
        0.6 * mark + 0.4 * F.greatest(flag(last, QUESTION_WORDS), flag(first, QUESTION_WORDS)), 0.3 * flag(text, COMPARED), 0.25 * flag(text, CHOICE),
        0.15 * flag(text, RHETORICAL), 0.15 * flag(last, CLIFF) * mark,
    ]
    more_q, more_l = GENRE_TWEAKS.get(genre, (0.0, 0.0))
    n = F.regexp_count(text, F.lit(LIST_ITEM))
    density = F.when(n == 0, 0.0).when(n.between(3, 7), 1.0).when(n < 3, 0.3 + 0.7 * (n / 3)).otherwise(F.greatest(F.lit(0.3), 1.0 - 0.1 * (n - 7)))
    questions = saturate([clamp(x) for x in asked]) + 0.10 * flag(text, GENUINE) + more_q
    lists = density + 0.2 * flag(text, LIST_WORDS) + more_l
    bait = F.least(F.lit(0.25), 0.1 * F.regexp_count(text, F.lit(f"(?i){BAIT}"))) + F.least(F.lit(0.20), 0.05 * F.regexp_count(text, F.lit(f"(?i){VACUOUS}")))
    score = clamp(saturate([clamp(questions), clamp(lists)]) - bait)
    return F.when(text == "", 0.0).when(F.regexp_count(text, F.lit("[A-Za-z0-9']+")) < 6, 0.35).otherwise(score)


def emotion_rate(text: Column, keywords, arousal: Column | None = None) -> Column:
    """Twenty times the keywords for each word, 1 at most; 0.25 at least where the arousal is 0.65 and two occur."""
    t, n = F.lower(whole(text)), F.size(words(whole(text)))
    found = hits(t, keywords)
    base = F.least(found / n * 20, F.lit(1.0))
    if arousal is not None:
        base = F.when((arousal >= 0.65) & (found >= 2), F.greatest(base, F.lit(0.25))).otherwise(base)
    return F.when(n == 0, 0.0).otherwise(base)


def calibrate_by_median(df: DataFrame, by: str, column: str, out: str, a: float = 1.5) -> DataFrame:
    """Sigmoid of the distance from the group's median in units of its quartile range / 1.349 (1 where that is none)."""
    q = quantiles(df, [by], column, (0.25, 0.5, 0.75), ("_q1", "_q2", "_q3"))
    spread = (F.col("_q3") - F.col("_q1")) / 1.349
    value = sigmoid(a * (F.col(column) - F.col("_q2")) / F.when(spread > 1e-6, spread).otherwise(1.0))
    return df.join(q, by).withColumn(out, F.round(value, 6)).drop("_q1", "_q2", "_q3")


def evidence_confidence(text: Column) -> tuple[Column, Column]:
    """Whether there is hard evidence (contrast, number, comparison), and a confidence of 0.5 to 0.9."""
    t = python_trim(whole(text))
    found = [(flag(t, p), w, hard) for p, w, hard in CONFIDENCE]
    score = 0.6 + reduce(lambda a, b: a + b, (f * w for f, w, _ in found)) + noun_burst(t).cast("int") * 0.05
    return reduce(lambda a, b: a + b, (f for f, _, hard in found if hard)) >= 1, clamp(score, 0.5, 0.9)


def insight_by_confidence(score: Column, confidence: Column, low: float = 0.9, high: float = 1.2, bounds: tuple[float, float] = (0.5, 0.9)) -> Column:
    """The score times a factor that goes from `low` to `high` with the confidence, 1 at most; as it is without one."""
    factor = clamp(low + (high - low) * ((confidence - bounds[0]) / (bounds[1] - bounds[0])), low, high)
    return F.when(confidence.isNull(), score).otherwise(F.least(F.lit(1.0), score * factor))


# --- hook --------------------------------------------------------------------------------------------------------


def hook_v5_enhanced(
    text: Column, families: list[tuple[str, str, float]], arousal: Column | None = None, q_list: Column | None = None, k: float = 5.0, most: int = 40, early: int = 12
) -> Column:
    """Families (name, pattern, weight) found in five-word windows, weaker with every word (exp(-i / k)) and saturating;
    more for a strong start within six words, less for hedges (half of that before strong words) and greetings; 0.20
    at most without evidence; a little more for arousal and questions. Texts under 8 characters 0."""
    text = F.translate(whole(text), "‘’‛‚", "''''")
    toks = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9%$'()*+,\-.]+"), 0), 1, most)
    # The rule reads the tokens inside lambdas, which would cut the text again for every token; as a lambda's variable they are cut once.
    cut = F.array(F.struct(text.alias("text"), toks.alias("toks")))
    return F.get(F.transform(cut, lambda x: _hook_of_tokens(x["text"], x["toks"], families, arousal, q_list, k, early)), 0)


def _hook_of_tokens(text: Column, toks: Column, families: list[tuple[str, str, float]], arousal: Column | None, q_list: Column | None, k: float, early: int) -> Column:
    window = lambda i: F.array_join(F.slice(toks, F.greatest(i - 1, F.lit(1)), i + 3 - F.greatest(i - 2, F.lit(0))), " ")
    found = lambda p: total(F.transform(toks, lambda w, i: F.when(window(i).rlike(f"(?i){p}"), 0.25 * F.exp(-i / k)).otherwise(0.0)))
    sums = [(found(p), w) for _, p, w in families]
    base = reduce(lambda a, b: a + b, (w * s / (1.0 + 0.6 * s) for s, w in sums))

    two = lambda w, i: F.concat_ws(" ", w, F.get(toks, i + 1))
    starts = F.transform(F.slice(toks, 1, 7), lambda w, i: F.when(w.isin(*HOOK_STARTERS) | two(w, i).rlike("truth|need|nobody"), i))
    base += F.least(F.lit(0.015), 0.008 * F.coalesce(F.array_min(starts), F.lit(0)))
    hedged = F.exists(F.slice(toks, 1, 3), lambda w: w.isin(*HOOK_FILLERS))
    strong = F.exists(F.slice(toks, 4, 5), lambda w: ((F.length(w) > 2) & ~w.isin(*HOOK_FILLERS)) | w.isin(*HOOK_STARTERS))
    base = F.when(hedged, F.greatest(F.lit(0.0), base - F.when(strong, 0.015).otherwise(0.03))).otherwise(base)
    base -= flag(F.substring(F.element_at(F.split(text, r"[.!?]\s+", 2), 1), 1, 180), INTRO) * 0.05

    kinds = reduce(lambda a, b: a + b, (flag(text, p) for p in HOOK_EVIDENCE.values()))
    head = F.array_join(F.slice(toks, 1, early), " ")
    shown = (kinds >= 2) | head.rlike(r"\b(how|why|what)\b|\b\d+(?:\.\d+)?%?\b|\b(?:vs\.?|versus|more than|less than)\b")
    base = F.when(shown, base).otherwise(F.least(base, F.lit(0.20)))
    more = [F.when(x >= 0.60, 0.02 * F.least(F.lit(1.5), 1.0 + (x - 0.60) / 0.40)).otherwise(0.0) for x in (arousal, q_list) if x is not None]
    base += F.least(F.lit(0.08), reduce(lambda a, b: a + b, more)) if more else F.lit(0.0)
    return F.when(F.length(python_trim(text)) < 8, 0.0).otherwise(clamp(base))


# --- genres and ends ---------------------------------------------------------------------------------------------


def genre_patterns(text: Column) -> dict[str, Column]:
    """Scores and flags, named <genre>_<feature>."""
    t = F.lower(whole(text))
    scores = {f"{g}_{n}": F.least(reduce(lambda a, b: a + b, (t.rlike(p).cast("int") for p in ps)) * w, F.lit(most)) for g, n, w, most, ps in GENRE_PATTERNS}
    return scores | {f"{g}_{n}": t.rlike(p) for g, n, p in GENRE_FLAGS}


def semantic_end_bonus(tail: Column) -> Column:
    """0.25 for a cue of a complete thought, 0.12 for a final mark, -0.15 for a name or number at the very end."""
    t = python_trim(F.lower(whole(tail)))
    return any_hit(t, END_CUES).cast("int") * 0.25 + t.rlike(r"[.!?]\z").cast("int") * 0.12 - whole(tail).rlike(r"\b([A-Z][a-z]+|[0-9]+)$").cast("int") * 0.15


def ends_curious(tail: Column) -> Column:
    return any_hit(F.lower(whole(tail)), CURIOUS)


def quiet_start(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(episode_id, clip_id, quiet): clips with 0.6 s or more without speech in their first second, and those of 50 ms or less."""
    head = clips.select("episode_id", "clip_id", F.col("start_ms").alias("c_start"), F.least(F.col("start_ms") + 1000, "end_ms").alias("c_end"))
    spoken = segments.select("episode_id", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    touch = lambda a, b: (F.col("s_start") < F.col("c_end")) & (F.col("s_end") > F.col("c_start"))
    pairs = range_join(head, spoken, "episode_id", ("c_start", "c_end"), ("s_start", "s_end"), touch)
    common = F.least("s_end", "c_end") - F.greatest("s_start", "c_start")
    covered = pairs.groupBy("episode_id", "clip_id").agg(F.sum(common).alias("covered"))
    rows = head.join(covered, ["episode_id", "clip_id"], "left")
    span = F.col("c_end") - F.col("c_start")
    return rows.select("episode_id", "clip_id", ((span <= 50) | (span - F.coalesce("covered", F.lit(0)) >= 600)).alias("quiet"))


# --- titles ------------------------------------------------------------------------------------------------------


def title_vectors(titles: DataFrame, by: str, key: str, title: str = "title") -> DataFrame:
    """(by, key, vector): tf-idf of a title's words among its group's titles, as a map."""
    terms = titles.select(by, key, F.explode(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), 0)).alias("w")).groupBy(by, key, "w").agg(F.count("*").alias("c"))
    sizes = titles.groupBy(by).agg(F.count("*").alias("n"))
    seen = terms.groupBy(by, "w").agg(F.count("*").alias("df"))
    size = F.sum("c").over(Window.partitionBy(by, key))
    weighed = terms.withColumn("size", size).join(seen, [by, "w"]).join(sizes, by)
    weighed = weighed.withColumn("x", F.col("c") / F.col("size") * (F.log((F.col("n") + 1) / (1 + F.col("df"))) + 1.0))
    return weighed.groupBy(by, key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", "x")))).alias("vector"))


def map_cosine(a: Column, b: Column) -> Column:
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda x: x * x)))
    dot = total(F.transform(F.map_keys(a), lambda k: F.try_element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def diversify_titles(titles: DataFrame, by: str = "episode_id", key: str = "clip_id", score: str = "final_score", title: str = "title", share: float = 0.75) -> DataFrame:
    """(by, key, pick): the best title first, then always the one with the most of share * score less (1 - share) *
    the tf-idf cosine to the nearest one picked; ties by score and key. A fold over each group's finalists."""
    rows = titles.select(by, key, score, title).join(title_vectors(titles, by, key, title), [by, key], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    row = F.struct((-F.col(score)).alias("m"), F.col(key).alias("id"), F.coalesce("vector", none).alias("v"))
    arrays = rows.groupBy(by).agg(F.collect_list(row).alias("all"))

    def pick(done: Column, _: Column) -> Column:
        left = F.filter("all", lambda x: ~F.exists(done, lambda d: d["id"] == x["id"]))
        near = lambda x: F.aggregate(done, F.lit(0.0), lambda m, d: F.greatest(m, map_cosine(d["v"], x["v"])))
        value = lambda x: F.when(F.size(done) > 0, -F.round(-share * x["m"] - (1 - share) * near(x), 9)).otherwise(F.lit(0.0))
        best = F.array_min(F.transform(left, lambda x: F.struct(value(x).alias("value"), x["m"].alias("m"), x["id"].alias("id"))))
        return F.concat(done, F.filter(left, lambda x: x["id"] == best["id"]))

    picked = F.aggregate(F.sequence(F.lit(1), F.size("all")), F.filter("all", lambda x: F.lit(False)), pick)
    return arrays.select(by, F.posexplode(picked).alias("at", "x")).select(by, F.col("x.id").alias(key), (F.col("at") + 1).cast("long").alias("pick"))
