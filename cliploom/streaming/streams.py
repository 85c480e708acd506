"""Structured Streaming jobs and their batch twins.

A stream and its twin give the same rows on the same events. Time is event time `ts`; rows later than the watermark
are dropped. Rules that look at earlier accepted rows are ordered folds in the twin and keyed state with event-time timers
in the stream (keyed.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.patterns import ordered_fold
from cliploom.streaming.keyed import STAGES, TERMINAL, THROTTLE_POINTS, THROTTLE_S, Calibrator, FirstSeen, Progress, RateLimit, in_order

PROGRESS = "array<struct<stage: string, percent: bigint, at_s: bigint>>"


def progress(events: DataFrame, by: str = "episode_id", ttl_s: int | None = None) -> DataFrame:
    """Accepted updates (by, stage, percent, at_s) of (by, stage, percent, ts, id): the stage never goes back, the
    percentage never falls, small or fast updates of one stage are passed over, nothing follows a terminal stage.
    With `ttl_s`, a job may begin anew after so many seconds without an accepted update."""
    order = F.array(*map(F.lit, STAGES))
    rows = events.select(by, F.lower(F.trim("stage")).alias("stage"), F.least(F.greatest("percent", F.lit(0)), F.lit(100)).cast("long").alias("percent"), F.unix_timestamp("ts").alias("at_s"), "id")
    rows = rows.withColumn("stage", F.when(F.array_contains(order, F.col("stage")), F.col("stage")).otherwise("processing"))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        place = lambda s: F.array_position(order, s)
        frozen = last["stage"].isin(*TERMINAL)
        back = (place(x["stage"]) < place(last["stage"])) | (x["percent"] < last["percent"])
        same = (x["stage"] == last["stage"]) & ((x["percent"] - last["percent"] < THROTTLE_POINTS) | (x["at_s"] - last["at_s"] < THROTTLE_S))
        one = F.struct(x["stage"].alias("stage"), x["percent"].alias("percent"), x["at_s"].alias("at_s"))
        known = (F.size(done) > 0) & (F.lit(True) if ttl_s is None else x["at_s"] - last["at_s"] <= ttl_s)
        return F.when(known & (frozen | back | same), done).otherwise(F.concat(done, F.array(one)))

    folded = ordered_fold(rows, by, [F.col("at_s"), F.col("id")], ["stage", "percent", "at_s"], f"cast(array() as {PROGRESS})", step, "done")
    return folded.select(by, F.posexplode("done").alias("no", "x")).select(by, F.col("no").cast("long").alias("no"), "x.*")


def progress_stream(events: DataFrame, by: str = "episode_id", ttl_s: int = 86_400, watermark: str = "10 minutes") -> DataFrame:
    """The rows of progress() with the same `ttl_s`, once the watermark has passed them; a job is forgotten after that time."""
    return in_order(events, by, Progress(ttl_s), watermark)


#: Accepted requests and seconds of each operation.
LIMITS = {"upload": (5, 300), "title": (3, 600), "clip": (10, 300)}


def rate_limit(requests: DataFrame, by: str, limit: int, seconds: int) -> DataFrame:
    """(by, id, at_s, accepted): a request is accepted if fewer than `limit` accepted ones lie in the time before it.
    Refused requests do not count, so this is a fold and no range count; it keeps only times still in the window."""
    rows = requests.select(by, F.unix_timestamp("ts").alias("at_s"), "id")
    kind = "struct<open: array<bigint>, out: array<struct<id: bigint, at_s: bigint, accepted: boolean>>>"

    def step(s: Column, x: Column) -> Column:
        recent = F.filter(s["open"], lambda t: t > x["at_s"] - seconds)
        yes = F.size(recent) < limit
        row = F.struct(x["id"].alias("id"), x["at_s"].alias("at_s"), yes.alias("accepted"))
        return F.struct(F.when(yes, F.concat(recent, F.array(x["at_s"]))).otherwise(recent).alias("open"), F.concat(s["out"], F.array(row)).alias("out"))

    start = f"cast(named_struct('open', cast(array() as array<bigint>), 'out', cast(array() as array<struct<id: bigint, at_s: bigint, accepted: boolean>>)) as {kind})"
    folded = ordered_fold(rows, by, [F.col("at_s"), F.col("id")], ["id", "at_s"], start, step, "s")
    return folded.select(by, F.explode("s.out").alias("x")).select(by, "x.*")


def rate_limit_stream(requests: DataFrame, by: str, limit: int, seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """The rows of rate_limit(), once the watermark has passed them; a key is forgotten when its window is empty."""
    return in_order(requests, by, RateLimit(limit, seconds), watermark)


def first_seen(events: DataFrame, key: str = "key", ttl_s: int = 900) -> DataFrame:
    """(key, id, at_s): rows that come first, or after no accepted row of their key for `ttl_s` seconds."""
    rows = events.select(key, F.unix_timestamp("ts").alias("at_s"), "id")
    kind = "array<struct<id: bigint, at_s: bigint>>"

    def step(done: Column, x: Column) -> Column:
        fresh = (F.size(done) == 0) | (x["at_s"] - F.get(done, F.size(done) - 1)["at_s"] > ttl_s)
        return F.when(fresh, F.concat(done, F.array(F.struct(x["id"].alias("id"), x["at_s"].alias("at_s"))))).otherwise(done)

    folded = ordered_fold(rows, key, [F.col("at_s"), F.col("id")], ["id", "at_s"], f"cast(array() as {kind})", step, "done")
    return folded.select(key, F.explode("done").alias("x")).select(key, "x.*")


def first_seen_stream(events: DataFrame, key: str = "key", ttl_s: int = 900, watermark: str = "10 minutes") -> DataFrame:
    """The rows of first_seen(), once the watermark has passed them; a key is forgotten after `ttl_s`."""
    return in_order(events, key, FirstSeen(ttl_s), watermark)


def metrics(events: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(start, name, n, mean, errors) of tumbling windows; for a stream, with a watermark."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "name").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("name") == "error").alias("errors")
    )
    return grouped.select(F.col("w.start").alias("start"), "name", "n", "mean", "errors")


def rolling_calibrator(scores: DataFrame, keep: int = 500) -> DataFrame:
    """(n, p10, p90) of the last `keep` scores (score, ts, id)."""
    last = scores.where(F.col("score").between(0, 1)).orderBy(F.desc("ts"), F.desc("id")).limit(keep)
    a = last.agg(F.sort_array(F.collect_list("score")).alias("a"))
    at = lambda q: F.get("a", F.rint(F.lit(q) * (F.size("a") - 1)).cast("int"))
    return a.select(F.size("a").cast("long").alias("n"), at(0.10).alias("p10"), at(0.90).alias("p90"))


def calibrations(scores: DataFrame, by: str, keep: int = 500, ttl_s: int = 86_400) -> DataFrame:
    """(by, id, at_s, n, p10, p90) after each score from 0 to 1 of (by, score, ts, id): over the last `keep` scores of its key that
    are not older than `ttl_s`."""
    rows = scores.where(F.col("score").between(0, 1)).select(by, "id", F.unix_timestamp("ts").alias("at_s"), F.col("score").cast("double").alias("score"))
    last = Window.partitionBy(by).orderBy("at_s", "id").rowsBetween(1 - keep, 0)
    recent = F.filter(F.collect_list(F.struct("at_s", "score")).over(last), lambda x: x["at_s"] >= F.col("at_s") - ttl_s)
    rows = rows.withColumn("a", F.sort_array(F.transform(recent, lambda x: x["score"])))
    at = lambda q: F.get("a", F.rint(F.lit(q) * (F.size("a") - 1)).cast("int"))
    return rows.select(by, F.col("id").cast("long").alias("id"), "at_s", F.size("a").cast("long").alias("n"), at(0.10).alias("p10"), at(0.90).alias("p90"))


def calibrator_stream(scores: DataFrame, by: str, keep: int = 500, ttl_s: int = 86_400, watermark: str = "10 minutes") -> DataFrame:
    """The rows of calibrations(), once the watermark has passed them; a key's scores are forgotten `ttl_s` after its last one."""
    return in_order(scores, by, Calibrator(keep, ttl_s), watermark)


def trend_window(titles: DataFrame, as_of: Column | None = None, half_life_days: float = 7.0, watermark: str | None = None) -> DataFrame:
    """(day, term, n, decayed): words of titles (title, ts) by day; decayed to `as_of` when it is read."""
    rows = titles.withWatermark("ts", watermark) if watermark else titles
    ws = rows.select("ts", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}0-9']{3,}"), 0)).alias("term"))
    days = ws.groupBy(F.window("ts", "1 day").alias("w"), "term").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "term", "n")
    if as_of is None:
        return days
    age = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp("day")) / 86_400, F.lit(0.0))
    return days.withColumn("decayed", F.round(F.col("n") * F.exp(-F.log(F.lit(2.0)) * age / half_life_days), 6))


def sessions(events: DataFrame, by: str, gap: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """(by, start, end, n): runs of events with less than `gap` between them; `end` is the last event plus the gap."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, created, started, finished) of job events (job_id, status, ts, id)."""
    order = F.struct("ts", "id")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.min("ts").alias("created"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("finished"),
    )


def job_state_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    return job_state(events.withWatermark("ts", watermark))

