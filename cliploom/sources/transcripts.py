"""Reading transcripts and clips into the canonical tables.

Times are whole milliseconds. Missing numbers read as 0 and missing text as "" where a rule below says so; rows
that cannot be placed in time are dropped.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

SPACES = "[ \\t\\n\\r]+"
#: A word's length, in seconds for each character, where its end is missing.
SECONDS_PER_CHAR = 0.06

WORD = StructType([StructField(n, StringType()) for n in ("w", "word", "token", "text", "t", "d", "start", "end", "s", "e", "ts", "te", "prob")])
SEGMENT = StructType([
    StructField("episode_id", LongType()), StructField("seg_idx", LongType()), StructField("start", DoubleType()),
    StructField("end", DoubleType()), StructField("text", StringType()), StructField("confidence", DoubleType()),
    StructField("words", ArrayType(WORD)),
])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    """Whitespace tokens, none of them empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_start(number: Column) -> Column:
    """Synthetic time of an episode's n-th word: 300 ms a word, and 550 ms more after every seventh."""
    return number * 300 + F.floor(number / 7) * 550


# --- sources -----------------------------------------------------------------------------------------------------


def load_segments(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Segment records (start, end, text, confidence, nested words) of one schema, whatever the file holds."""
    if form == "json":
        return spark.read.schema(SEGMENT).json(path)
    return spark.read.schema(SEGMENT).format(form).load(path)


def segments_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as segments: a turn is a segment; times follow from word numbers.

    Only word counts are windowed over an episode; no text is moved twice.
    """
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("ws", tokens(F.col("text"))).withColumn("n_words", F.size("ws").cast("long")).where("n_words > 0")
    before = F.sum("n_words").over(Window.partitionBy("episode_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first_word", F.coalesce(before, F.lit(0)))
    return rows.select(
        "episode_id", "seg_idx", "speaker", "text", "ws", "n_words", "first_word",
        word_start(F.col("first_word")).alias("start_ms"), (word_start(F.col("first_word") + F.col("n_words") - 1) + 250).alias("end_ms"),
    )


def words_of_segments(segments: DataFrame) -> DataFrame:
    """One row for each word of segments with a `ws` array and a `first_word` number."""
    rows = segments.select("episode_id", "seg_idx", "first_word", F.posexplode("ws").alias("pos", "w"))
    start = word_start(F.col("word_idx"))
    rows = rows.withColumn("word_idx", F.col("first_word") + F.col("pos"))
    return rows.select("episode_id", "word_idx", "seg_idx", "w", start.alias("start_ms"), (start + 250).alias("end_ms"))


def synthesize_words(segments: DataFrame) -> DataFrame:
    """Words spread evenly over each segment's time, where a recogniser gave none."""
    rows = segments.select("episode_id", "seg_idx", "start_ms", "end_ms", tokens(F.col("text")).alias("ws"))
    step = (F.col("end_ms") - F.col("start_ms")) / F.size("ws")
    rows = rows.select("episode_id", "seg_idx", "start_ms", step.alias("step"), F.posexplode("ws").alias("pos", "w"))
    at = lambda i: F.floor(F.col("start_ms") + i * F.col("step")).cast("long")
    return rows.select("episode_id", "seg_idx", "pos", "w", at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"))


def sentences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as segments in bulk: a sentence is a segment."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.expr(r"regexp_extract_all(text, '[^.!?]+[.!?]*', 0)").alias("s"))
    return rows.select("episode_id", F.posexplode("s").alias("seg_idx", "text"))


# --- schema normalisation ----------------------------------------------------------------------------------------


def canonical_words(segments: DataFrame) -> DataFrame:
    """Word records of any spelling as (episode_id, seg_idx, word_idx, w, start_ms, end_ms, prob).

    Text from w, word, token or text; start from t, start, s or ts; end from end, e or te, else start + d, else
    start + 0.06 s a character. Rows without text or start, or that end before they start, are dropped.
    """
    rows = segments.select("episode_id", "seg_idx", F.posexplode("words").alias("word_idx", "x"))
    number = lambda *names: F.coalesce(*(F.col(f"x.{n}").try_cast("double") for n in names))
    text = F.trim(F.coalesce("x.w", "x.word", "x.token", "x.text"))
    start = number("t", "start", "s", "ts")
    end = F.coalesce(number("end", "e", "te"), start + number("d"), start + F.length(text) * SECONDS_PER_CHAR)
    ms = lambda c: F.round(c * 1000).cast("long")
    rows = rows.select("episode_id", "seg_idx", "word_idx", text.alias("w"), ms(start).alias("start_ms"), ms(end).alias("end_ms"), number("prob").alias("prob"))
    return rows.where("w != '' and start_ms is not null and end_ms >= start_ms")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """Each distinct text of a batch once."""
    coded = texts.dictionary_encode()
    return pa.array([unicodedata.normalize("NFKC", t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """Compatible forms in their usual characters (NFKC), then curly quotes, dashes and ellipses in plain ones.

    Spark has no NFKC, so texts that are not all ASCII pass an Arrow function; the others do not leave the JVM.
    """
    if nfkc:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    text = F.translate(text, "‘’‚“”„‐‑‒–—−\u00a0", "'''\"\"\"------ ")
    return F.replace(text, F.lit("…"), F.lit("..."))


def preflight(segments: DataFrame) -> DataFrame:
    """Segments with words never null, text rebuilt from words where it is missing, tokens, and an id."""
    words = F.coalesce("words", F.array().cast(ArrayType(WORD)))
    own = F.filter(F.transform(words, lambda x: F.trim(F.coalesce(x["w"], x["word"], x["token"], x["text"], F.lit("")))), lambda w: w != "")
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.array_join(own, " "))
    fallback = F.concat(F.lit("seg_"), F.col("seg_idx").cast("string"))
    return segments.withColumns({"words": words, "text": text, "tokens": tokens(text), "id": fallback})


CLIP_FIELDS = {
    "id": ("id", "clip_id"), "start": ("start", "startTime", "start_time"), "end": ("end", "endTime", "end_time"),
    "text": ("text", "transcript"), "score": ("score", "clip_score_100", "final_score"),
}


def clips_of_json(df: DataFrame, column: str = "body") -> DataFrame:
    """Clips from JSON texts: an array, or an object with `clips`, `items` or `data`; several spellings of the fields."""
    body = F.try_parse_json(column)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    array = F.coalesce(*(get(body, p, "array<variant>") for p in ("$.clips", "$.items", "$.data", "$")))
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.posexplode(array).alias("clip_no", "x"))
    field = lambda name, kind: F.coalesce(*(get(F.col("x"), f"$.{p}", kind) for p in CLIP_FIELDS[name]))
    return rows.select(
        *others, "clip_no", field("id", "string").alias("id"), field("start", "double").alias("start"), field("end", "double").alias("end"),
        F.coalesce(field("text", "string"), F.lit("")).alias("text"), field("score", "double").alias("score"),
    )


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    return clips_of_json(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body"))


def list_history(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The newest records of a JSON-lines log by `ts`; lines that do not parse are passed over."""
    return spark.read.option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("ts")).limit(limit)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables as one, each key's row with the greatest `order`; a change wins over an equal base row."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def get_clips(clips: DataFrame, episode_id: int | None = None) -> DataFrame:
    return clips if episode_id is None else clips.where(F.col("episode_id") == episode_id)


def extract_titles(pages: DataFrame, limit: int = 80, skip: int = 1) -> DataFrame:
    """(page_id, no, title) of the `<title>` texts of a page or feed; the first (the feed's own) is passed over."""
    found = F.expr("regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    rows = pages.select("page_id", F.posexplode(F.slice(found, skip + 1, limit)).alias("no", "raw"))
    title = F.trim(F.regexp_replace("raw", "<[^>]+>", ""))
    return rows.select("page_id", (F.col("no") + skip).cast("long").alias("no"), title.alias("title")).where("title != ''")


def clamp_spans(clips: DataFrame, episodes: DataFrame, least_ms: int = 500) -> DataFrame:
    """Clips inside their episode, of `least_ms` at least where the episode is that long."""
    rows = clips.join(episodes.select("episode_id", "duration_ms"), "episode_id")
    start = F.least(F.greatest(F.col("start_ms"), F.lit(0)), F.greatest(F.col("duration_ms") - least_ms, F.lit(0)))
    end = F.least(F.greatest(F.col("end_ms"), F.col("start_ms") + least_ms), F.col("duration_ms"))
    return rows.withColumn("start_ms", start).withColumn("end_ms", end).drop("duration_ms")


def clip_id(episode_id: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", episode_id.cast("string"), start_ms.cast("string"), end_ms.cast("string"))), 1, 16)


def assign_clip_ids(clips: DataFrame) -> DataFrame:
    return clips.withColumn("clip_id", clip_id(F.col("episode_id"), F.col("start_ms"), F.col("end_ms")))


def valid_clip_id(column: Column) -> Column:
    return F.coalesce(column.rlike("^[0-9a-f]{16}$"), F.lit(False))


def caption_lines(words: DataFrame, n: int = 5) -> DataFrame:
    """Lines of `n` words."""
    rows = words.withColumn("line", F.floor((F.row_number().over(Window.partitionBy("episode_id").orderBy("word_idx")) - 1) / n))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "w"))), lambda x: x["w"]), " ")
    return rows.groupBy("episode_id", "line").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))


def vtt_time(ms: Column) -> Column:
    part = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3_600_000), 2), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def captions_to_vtt(cues: DataFrame, by: str = "episode_id") -> DataFrame:
    """One caption document for each key, from cues (start_ms, end_ms, text)."""
    cue = F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", cue.alias("cue")))), lambda x: x["cue"])
    return cues.groupBy(by).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(listed, "\n\n"), F.lit("\n")).alias("vtt"))


def episode_duration(episodes: DataFrame, words: DataFrame, segments: DataFrame, clips: DataFrame) -> DataFrame:
    """The first positive of the stated duration and the last end among words, segments and clips."""
    last = lambda df, name: df.groupBy("episode_id").agg(F.max("end_ms").alias(name))
    rows = episodes.select("episode_id", "duration_ms")
    for name, df in (("w", words), ("s", segments), ("c", clips)):
        rows = rows.join(last(df, name), "episode_id", "full")
    positive = [F.when(F.col(c) > 0, F.col(c)) for c in ("duration_ms", "w", "s", "c")]
    return rows.select("episode_id", F.coalesce(*positive, F.lit(0)).cast("long").alias("duration_ms"))


def collect_hashtags(text: Column, tags: Column | None = None, limit: int = 8) -> Column:
    """`#tags` of a text and a tag array, lower case, each once, the first `limit`."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\w+)"), 1), F.lower)
    if tags is not None:
        plain = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.ltrim(t, F.lit("#"))))
        found = F.concat(found, F.filter(plain, lambda t: t != ""))
    return F.slice(F.array_distinct(found), 1, limit)
