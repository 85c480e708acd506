"""Statistics over sets: normalisation, calibration, gates, keyword counts, usage and metric summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from cliploom.operators.features import clamp, sigmoid
from cliploom.operators.large import LARGE_GROUP
from cliploom.operators.quantiles import order_statistics, quantiles
from cliploom.operators.written import written

#: Bytes of text whose runs of words are counted together inside a task.
NGRAM_BYTES = 8 << 20


def znorm(df: DataFrame, by: str, column: str = "final_score") -> DataFrame:
    """sigmoid(2 z) of a column in its group; min-max where it hardly varies, 0.5 where it does not."""
    w = Window.partitionBy(by)
    mean, dev = F.avg(column).over(w), F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0))
    low, high = F.min(column).over(w), F.max(column).over(w)
    value = F.when(dev > 1e-6, sigmoid(2 * (F.col(column) - mean) / dev)).when(high - low < 1e-6, 0.5).otherwise((F.col(column) - low) / (high - low))
    return df.withColumn("norm", F.round(value, 6))


def minmax_pct(df: DataFrame, by: str, column: str = "final_score") -> DataFrame:
    """0 to 100 by the group's range; 50 + 15 z of the composite where the range is none."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    z = (F.col("composite") - F.avg("composite").over(w)) / F.nullif(F.stddev_pop("composite").over(w), F.lit(0.0)) if "composite" in df.columns else F.lit(0.0)
    value = F.when(high - low > 1e-9, 100 * (F.col(column) - low) / (high - low)).otherwise(clamp(50 + 15 * F.coalesce(z, F.lit(0.0)), 0.0, 100.0))
    return df.withColumn("pct", F.round(value, 6))


#: Ends of the duration bands in milliseconds.
BAND_ENDS = (12_500, 18_500, 24_500, 30_500, 60_000)


def band(ms: Column) -> Column:
    out = F.lit(len(BAND_ENDS))
    for i, end in reversed(list(enumerate(BAND_ENDS))):
        out = F.when(ms < end, i).otherwise(out)
    return out


def band_norm(df: DataFrame, by: list[str], column: str = "final_score", large_group: int = LARGE_GROUP) -> DataFrame:
    """Score in its duration band: (v - (median - iqr)) / 2 iqr, 0.05 at least; quartiles are the values at ranks
    n/4, n/2 and 3n/4, exact in bands of any size. One small table of bands is joined back."""
    rows = df.withColumn("band", band(F.col("end_ms") - F.col("start_ms")))
    v = F.col(column) * 100
    stats = order_statistics(rows, [*by, "band"], v, lambda n: [F.floor(n * k / 4) for k in (1, 2, 3)], large_group)
    at = lambda k: F.get("at", F.lit(k - 1))
    stats = stats.select(*by, "band", at(2).alias("mid"), F.greatest(at(3) - at(1), F.lit(1e-6)).alias("iqr"))
    joined = rows.join(stats if by else F.broadcast(stats), [*by, "band"])
    span, low = 2 * F.col("iqr"), F.col("mid") - F.col("iqr")
    value = F.when(span < 1e-6, sigmoid((v - 0.35) / 0.08)).otherwise((v - low) / span)
    return joined.withColumn("band_score", F.round(clamp(value, 0.05, 1.0), 6)).drop("mid", "iqr")


def calibrate(df: DataFrame, column: str, method: str = "mean", by: str | None = None, gain: float = 1.0, large_group: int = LARGE_GROUP) -> DataFrame:
    """sigmoid of a z score over the set: mean and population deviation, or median and iqr / 1.349 (exact, for sets of any size)."""
    keys = [by] if by else []
    if method == "mean":
        stats = df.groupBy(*keys).agg(F.avg(column).alias("_c"), F.stddev_pop(column).alias("_d"))
    else:
        found = quantiles(df, keys, column, (0.5, 0.75, 0.25), ("_c", "_q3", "_q1"), large_group)
        stats = found.select(*keys, "_c", ((F.col("_q3") - F.col("_q1")) / 1.349).alias("_d"))
    rows = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))
    z = F.when(F.col("_d") > 1e-9, (F.col(column) - F.col("_c")) / F.col("_d")).otherwise(0.0)
    return rows.withColumn(f"{column}_cal", F.round(sigmoid(gain * z), 6)).drop("_c", "_d")


def nearest_rank(array: Column, q: float) -> Column:
    return F.get(array, F.rint(F.lit(q) * (F.size(array) - 1)).cast("int"))


def calibrator(scores: DataFrame, df: DataFrame, keep: int = 500, column: str = "final_score") -> DataFrame:
    """display: scores against the p10 and p90 of the last `keep` scores (score, ts), mapped to 35, 80 and 92."""
    last = scores.where(F.col("score").between(0, 1)).orderBy(F.desc("ts"), F.desc("score")).limit(keep)
    stats = last.agg(F.sort_array(F.collect_list("score")).alias("a")).select(nearest_rank(F.col("a"), 0.10).alias("p10"), nearest_rank(F.col("a"), 0.90).alias("p90"))
    x, p10, p90 = F.col(column), F.coalesce("p10", F.lit(0.3)), F.coalesce("p90", F.lit(0.7))
    low = F.when(p10 == 0, 0.0).otherwise(35 * x / p10)
    high = 80 + 12 * F.least(F.lit(1.0), (x - p90) / F.greatest(1 - p90, F.lit(1e-6)))
    value = F.when(x <= p10, low).when(x >= p90, high).otherwise(35 + 45 * (x - p10) / (p90 - p10))
    return df.crossJoin(F.broadcast(stats)).withColumn("display", F.bround(clamp(value, 0.0, 100.0)).cast("long")).drop("p10", "p90")


def percentile_gate(df: DataFrame, by: str, column: str = "final_score", top: int = 3, large_group: int = LARGE_GROUP) -> DataFrame:
    """Clips kept: short ones from their p70 on, middle ones from p60 (p55 in episodes of over 25 minutes), the cutoff
    0.80 at most, and always the best three. The highest tenth is left out of a percentile over more than ten."""
    ms = F.col("end_ms") - F.col("start_ms")
    rows = df.withColumn("size", F.when(ms < 14_000, "micro").when(ms <= 28_000, "normal").otherwise("long"))
    group = Window.partitionBy(by, "size")
    order = Window.partitionBy(by, "size").orderBy(F.desc(column), "clip_id")
    n, place = F.count("*").over(group), F.row_number().over(order)
    rows = rows.withColumn("_n", n).withColumn("_place", place)
    used = (F.col("_n") <= 10) | (F.col("_place") > F.greatest(F.lit(1), F.floor(F.col("_n") * 0.10)))
    long_episode = F.max("end_ms").over(Window.partitionBy(by)) - F.min("start_ms").over(Window.partitionBy(by)) > 25 * 60_000
    rows = rows.withColumn("_long", long_episode).withColumn("_v", F.when(used, F.col(column)))
    cuts = quantiles(rows, [by, "size"], "_v", (0.70, 0.60, 0.55), ("p70", "p60", "p55"), large_group)
    cut = F.when(F.col("size") == "micro", F.col("p70")).when(F.col("_long"), F.col("p55")).otherwise(F.col("p60"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(column), "clip_id")) <= top
    rows = rows.withColumn("_best", best).join(cuts, [by, "size"])
    keep = F.col("_best") | ((F.col("size") != "long") & (F.col(column) >= F.least(cut, F.lit(0.80)) - 1e-12))
    return rows.where(keep).drop("_n", "_place", "_v", "_long", "_best", "p70", "p60", "p55")


def quality_floor(df: DataFrame, by: str, floor: float = 0.45, mode: str = "strict", least: int = 4, column: str = "final_score") -> DataFrame:
    """Clips from the floor (less a margin) on, and the next best ones up to `least`."""
    margin = 0.04 if mode == "strict" else 0.02
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(column), "clip_id"))
    return df.withColumn("place", place).where((F.col(column) >= floor - margin) | (F.col("place") <= least))


# --- words -------------------------------------------------------------------------------------------------------


def doc_terms(docs: DataFrame, key: str, text: str = "text", pattern: str = r"[\p{L}0-9']+") -> DataFrame:
    """(key, term, n): words of each text, lower case."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    return docs.select(key, F.explode(ws).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def tfidf(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tfidf): share in the text times ln((N + 1) / (1 + df)) + 1.

    Texts move by key before they become words, so a text's terms and their total are counted where it lies; the counts
    are written once and read for the frequencies and for the shares.
    """
    terms = doc_terms(docs.select(key, text).repartition(key), key, text)
    terms = written(terms.withColumn("size", F.sum("n").over(Window.partitionBy(key))), "terms")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    rows = terms.where(F.col(key).isNotNull()).join(df, "term").crossJoin(F.broadcast(total))
    return rows.select(key, "term", F.round(F.col("n") / F.col("size") * (F.log((F.col("total") + 1) / (1 + F.col("df"))) + 1), 6).alias("tfidf"))


def tfidf_cosine(vectors: DataFrame, key: str, by: str) -> DataFrame:
    """(by, a, b, similarity) of the pairs of a group that share a term."""
    norms = vectors.groupBy(by, key).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    one = vectors.select(by, "term", F.col(key).alias("a"), F.col("tfidf").alias("x"))
    two = vectors.select(by, "term", F.col(key).alias("b"), F.col("tfidf").alias("y"))
    dots = one.join(two, [by, "term"]).where("a < b").groupBy(by, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    left, right = norms.select(by, F.col(key).alias("a"), F.col("norm").alias("na")), norms.select(by, F.col(key).alias("b"), F.col("norm").alias("nb"))
    return dots.join(left, [by, "a"]).join(right, [by, "b"]).select(by, "a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


def top_keywords(docs: DataFrame, key: str, k: int = 10, stop: tuple[str, ...] = (), least_chars: int = 3) -> DataFrame:
    """(key, rank, term, score): frequency, plus 5 for a capital, 3 for digits and a tenth a letter.

    Texts move by key before they become words; the terms are counted and ranked where the text lies.
    """
    ws = docs.select(key, "text").repartition(key).select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}0-9']+"), 0)).alias("at", "w"))
    capital = F.max((F.col("w").rlike(r"^\p{Lu}") & (F.col("at") > 0)).cast("int"))
    terms = ws.withColumn("term", F.lower("w")).where(F.length("term") >= least_chars)
    if stop:
        terms = terms.where(~F.col("term").isin(*stop))
    terms = terms.groupBy(key, "term").agg(F.count("*").alias("n"), capital.alias("cap"), F.min("at").alias("at"))
    score = F.col("n") + 5 * F.col("cap") + 3 * F.col("term").rlike("[0-9]").cast("int") + 0.1 * F.length("term")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "at", "term"))
    return terms.withColumn("score", F.round(score, 6)).withColumn("rank", rank).where(F.col("rank") <= k).select(key, F.col("rank").cast("long").alias("rank"), "term", "score")


def ngrams(docs: DataFrame, n: int, key: str | None = None, stop: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(key, ngram, n): runs of `n` words whose ends are no stop words."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}0-9']+"), 0)
    keys = [key] if key else []
    rows = docs.select(*keys, ws.alias("ws")).where(F.size("ws") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: F.slice("ws", i, n))
    if stop:
        runs = F.filter(runs, lambda r: ~F.element_at(r, 1).isin(*stop) & ~F.element_at(r, -1).isin(*stop))
    rows = rows.select(*keys, F.explode(F.transform(runs, lambda r: F.array_join(r, " "))).alias("ngram"))
    return rows.groupBy(*keys, "ngram").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ngram_table(docs: DataFrame, lengths: tuple[int, ...] = (1, 2, 3), key: str | None = None, stop: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(key, n, ngram, count): runs of each of `lengths` words whose ends are no stop words, from one pass over the texts.

    Spark cuts the words. Runs are numbered and counted in slices of the Arrow batches, so each distinct run of a slice leaves
    it once, with its count; one exchange sums them.
    """
    said = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}0-9']+", " "))
    keys = [key] if key else []
    schema = StructType([*(docs.schema[k] for k in keys), StructField("n", IntegerType()), StructField("ngram", StringType()), StructField("count", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("said")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(NGRAM_BYTES, ends[-1] if len(ends) else 0, NGRAM_BYTES)) + 1, len(texts)])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for n, row, ngram, times in _ngrams(texts.slice(low, high - low), lengths, bool(key), stop):
                    kept = [batch.column(k).take(pa.array(row + low)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(times), n, np.int32)), ngram, pa.array(times, pa.int64())], names=schema.names)

    listed = docs.select(*keys, said.alias("said")).mapInArrow(count, schema)
    return listed.groupBy(*keys, "n", "ngram").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def _ngrams(texts: pa.Array, lengths: tuple[int, ...], apart: bool, stop: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(n, row, ngram, count) of the distinct runs of words in texts of words between single spaces; of each text, if `apart`."""
    lists = pc.split_pattern(texts, " ")
    words, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    spoken = pc.not_equal(words, "")
    words, owner = words.filter(spoken), owner[spoken.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    inner = ~pc.is_in(coded.dictionary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[code]
    run = code
    for n in range(1, max(lengths) + 1):
        if n > 1:
            # A run of n words is one of n - 1, by its number, with the next word.
            pair = run[: max(len(code) - n + 1, 0)] * size + code[n - 1 :]
            run = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        at = np.flatnonzero((owner[: len(run)] == owner[n - 1 :]) & inner[: len(run)] & inner[n - 1 :])
        if n not in lengths or not len(at):
            continue
        name = run[at] + owner[at] * (int(run.max()) + 1) if apart else run[at]
        _, first, times = np.unique(name, return_index=True, return_counts=True)
        first = at[first]
        yield n, owner[first], pc.binary_join_element_wise(*(words.take(pa.array(first + i)) for i in range(n)), " ") if n > 1 else words.take(pa.array(first)), times


def anchor_phrases(docs: DataFrame, key: str, anchors: dict[str, str], stop: tuple[str, ...] = (), reach: int = 6) -> DataFrame:
    """(key, phrase, points): anchor words by their name, with the nearest capitalised word among the `reach` before (4 points), or
    alone (2). `anchors` is a short list of words in lower case; words are runs of letters, and stop words are no names."""
    ws = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}]+"), 0)
    rows = docs.select(key, ws.alias("ws"))
    names = F.create_map(*(F.lit(x) for pair in anchors.items() for x in pair))

    def phrase(i: Column) -> Column:
        before = F.slice("ws", F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach)))
        nouns = F.filter(before, lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*stop)) if stop else F.filter(before, lambda w: w.rlike(r"^\p{Lu}"))
        name = names[F.lower(F.get("ws", i - 1))]
        found = F.size(nouns) > 0
        return F.struct(F.when(found, F.concat_ws(" ", F.get(nouns, F.size(nouns) - 1), name)).otherwise(name).alias("phrase"), F.when(found, 4).otherwise(2).cast("long").alias("points"))

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("ws"), F.lit(1))), lambda i: F.coalesce(F.lower(F.get("ws", i - 1)).isin(*anchors), F.lit(False)))
    listed = rows.select(key, F.explode(F.transform(places, phrase)).alias("x"))
    return listed.groupBy(key, "x.phrase").agg(F.sum("x.points").alias("points"))


def build_trends(titles: DataFrame, stop: tuple[str, ...] = (), top: int = 150) -> DataFrame:
    """(category, term, n, weight) of titles (category, title): the top terms of each category, weighted
    min(1, 0.25 + 0.05 n); and as category 'global' the number of categories that hold a term."""
    ws = titles.select("category", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}0-9']+"), 0)).alias("term")).where(F.length("term") >= 3)
    if stop:
        ws = ws.where(~F.col("term").isin(*stop))
    counts = ws.groupBy("category", "term").agg(F.count("*").alias("n"))
    whole = counts.groupBy("term").agg(F.count("*").alias("n")).select(F.lit("global").alias("category"), "term", "n")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "term"))
    best = counts.unionByName(whole).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("category", "term", "n", F.round(F.least(F.lit(1.0), 0.25 + 0.05 * F.col("n")), 3).alias("weight"))


# --- events ------------------------------------------------------------------------------------------------------


def metric_summary(events: DataFrame, since: Column, until: Column) -> DataFrame:
    """Count, range, mean, median and deviation of each metric (name, value, ts) in a time window."""
    v = F.col("value")
    return events.where((F.col("ts") >= since) & (F.col("ts") < until)).groupBy("name").agg(
        F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"),
        F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("deviation"),
    )


def timing_summary(events: DataFrame, keep: int = 100, least: int = 20) -> DataFrame:
    """Mean, median and exclusive p95 of each operation's last `keep` values (name, value, ts, id)."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("id")))
    rows = events.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("name").agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("a"))
    n = F.size("a")
    at = 0.95 * (n + 1)
    low = F.least(F.greatest(F.floor(at).cast("int"), F.lit(1)), n - 1)
    exact = F.element_at("a", low) + (at - low) * (F.element_at("a", low + 1) - F.element_at("a", low))
    mid = (F.element_at("a", F.floor((n + 1) / 2).cast("int")) + F.element_at("a", F.floor(n / 2).cast("int") + 1)) / 2
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    return rows.select("name", n.cast("long").alias("n"), F.round(total / n, 6).alias("mean"), F.round(mid, 6).alias("median"), F.round(F.when(n >= least, exact), 6).alias("p95"))


def error_summary(events: DataFrame) -> DataFrame:
    """(kind, n, first_message, last_message) of each kind, and over all of them (kind null)."""
    order = F.struct("ts", "id")
    return events.rollup("kind").agg(F.count("*").alias("n"), F.min_by("message", order).alias("first_message"), F.max_by("message", order).alias("last_message"))


def usage(events: DataFrame, users: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Uploads and clips of each user in the month of `as_of`, the plan's limit and what is left (null: no limit)."""
    month = events.where((F.col("ts") >= F.date_trunc("month", as_of)) & (F.col("ts") < as_of))
    counts = month.groupBy("user_id").agg(F.count_if(F.col("action") == "upload").alias("uploads"), F.count_if(F.col("action") == "clip").alias("clips"))
    rows = users.join(counts, "user_id", "left").join(plans, "plan", "left")
    used = F.coalesce("uploads", F.lit(0))
    left = F.greatest(F.col("upload_limit") - used, F.lit(0))
    return rows.select("user_id", "plan", used.alias("uploads"), F.coalesce("clips", F.lit(0)).alias("clips"), left.alias("remaining"), (F.col("upload_limit").isNull() | (left > 0)).alias("can_upload"))


def job_stats(jobs: DataFrame, by: str = "kind", statuses: tuple[str, ...] = ("queued", "running", "completed", "failed")) -> DataFrame:
    """A row for each kind with its jobs by status."""
    return jobs.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count("*").alias("total"))


def queue_order(jobs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("priority"), "created", "job_id"))
    return jobs.withColumn("place", rank.cast("long"))


def storage(files: DataFrame) -> DataFrame:
    return files.groupBy("area").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


def expired(rows: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return rows.where(F.col("ts") < as_of - F.expr(f"interval {hours} hours"))


def reason_counts(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def histogram(clips: DataFrame) -> DataFrame:
    return clips.groupBy(band(F.col("end_ms") - F.col("start_ms")).cast("long").alias("band")).agg(F.count("*").alias("n"))


def finish_ratio(clips: DataFrame, by: str) -> DataFrame:
    return clips.groupBy(by).agg(F.count("*").alias("n"), F.count_if("finished").alias("n_finished"), F.round(F.avg(F.col("finished").cast("double")), 6).alias("ratio"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, present, missing, share) of each column, from one aggregate."""
    wide = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns if c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(c) if c in df.columns else F.lit(0)).cast("long").alias("present")) for c in columns))
    rows = wide.select("_n", F.explode(cells).alias("x"))
    return rows.select("x.feature", "x.present", (F.col("_n") - F.col("x.present")).alias("missing"), F.round(F.try_divide("x.present", "_n"), 6).alias("share"))


def rate_gate(df: DataFrame, fillers: float = 0.6, hesitations: float = 0.3) -> DataFrame:
    """Rows whose filler and um/uh rates a second pass; a quarter more is allowed where the payoff is high."""
    s = F.greatest((F.col("end_ms") - F.col("start_ms")) / 1000, F.lit(0.001))
    count = lambda p: F.regexp_count(F.lower("text"), F.lit(p)) / s
    room = F.when(F.coalesce("payoff_score", F.lit(0.0)) >= 0.5, 1.25).otherwise(1.0)
    rows = df.withColumn("filler_rate", F.round(count(r"\b(like|so|you know|right)\b"), 6)).withColumn("um_rate", F.round(count(r"\b(um|uh)\b"), 6))
    return rows.withColumn("passes", (F.col("filler_rate") <= fillers * room) & (F.col("um_rate") <= hesitations * room))


def episode_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("episode_id").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
