"""Experiments and feedback: buckets, jitter, choices, click rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_number(key: Column, digits: int) -> Column:
    """The first hex digits of a key's md5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, digits), 16, 10).cast("long")


def ab_bucket(key: Column, pct: int, control: float = 0.0) -> Column:
    """1 in the treatment's share of the buckets, else the control's scale; no key, no effect."""
    if pct >= 100:
        return F.lit(1.0)
    return F.when(key.isNull() | (key.cast("string") == ""), 0.0).when(hash_number(key, 6) % 100 < pct, 1.0).otherwise(control)


def hash_jitter(key: Column, scale: float) -> Column:
    """A fixed number from -scale to scale for each key."""
    return (hash_number(key, 8) / float(0xFFFFFFFF) * 2 - 1) * scale


def ab_summary(choices: DataFrame) -> DataFrame:
    """(test_id, n, a, b, a_share): wins of each version."""
    rows = choices.groupBy("test_id").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == "a").alias("a"), F.count_if(F.col("choice") == "b").alias("b"))
    return rows.withColumn("a_share", F.round(F.try_divide("a", F.col("a") + F.col("b")), 6))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(reason, n, mean_rating, mean_score)."""
    return feedback.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.avg("score"), 6).alias("mean_score"))


def title_ctr(events: DataFrame) -> DataFrame:
    """(title_id, impressions, clicks, ctr); no impressions, no rate."""
    rows = events.groupBy("title_id").agg(F.count_if(F.col("action") == "view").alias("impressions"), F.count_if(F.col("action") == "click").alias("clicks"))
    return rows.withColumn("ctr", F.round(F.try_divide("clicks", "impressions"), 6))


def choices(df: DataFrame) -> DataFrame:
    """Choice records of one schema; those without an id or a choice go."""
    return df.select(F.col("test_id").cast("string"), F.lower("choice").alias("choice"), F.col("ts").cast("timestamp")).where("test_id is not null and choice is not null")
