"""Four patterns that the operators share: range join, as-of join, islands, ordered greedy selection.

All of them partition by a key (an episode), so a corpus runs in one job. None makes a cross join: the range join
is an equi-join on time bins, the as-of join a window over the union of both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators import large

#: Width of a time bin of the range join. An interval is repeated for each bin it touches.
BIN_MS = 30_000
#: Bins whose ranges meet their rows together in `gather`.
HOME_BINS = 4


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def range_join(
    left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str],
    condition: Callable[[DataFrame, DataFrame], Column], bin_ms: int = BIN_MS, how: str = "inner",
) -> DataFrame:
    """Pairs of rows whose intervals touch and that meet `condition`; column names of the sides must differ but for `by`.

    Both sides are put into time bins and joined on (key, bin); a pair is taken in the first bin that both touch,
    so it comes once. Long keys (a single very long episode) spread over their bins. For how="left", rows that met
    nothing are found by their values (equal rows meet the same), so a task that runs again finds the same ones.

    The sides are sorted and merged: how many rows an interval becomes is not in Spark's estimate, so a side that looks
    small enough to be sent to every task may not be.
    """
    a = left.withColumn("_bin", F.explode(_bins(F.col(left_span[0]), F.col(left_span[1]), bin_ms)))
    b = right.withColumnRenamed(by, "_key").withColumn("_other", F.explode(_bins(F.col(right_span[0]), F.col(right_span[1]), bin_ms)))
    first = F.greatest(F.floor(F.col(left_span[0]) / bin_ms), F.floor(F.col(right_span[0]) / bin_ms))
    joined = a.join(b.hint("merge"), (F.col(by) == F.col("_key")) & (F.col("_bin") == F.col("_other")) & (F.col("_bin") == first) & condition(a, b))
    joined = joined.drop("_bin", "_other", "_key")
    if how == "inner":
        return joined
    met = joined.select(*(F.col(c).alias(f"_met_{c}") for c in left.columns)).distinct()
    missing = left.join(met, reduce(lambda x, y: x & y, (left[c].eqNullSafe(met[f"_met_{c}"]) for c in left.columns)), "left_anti")
    return joined.unionByName(missing, allowMissingColumns=True)


def gather(
    left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str], fields: Sequence[str], bin_ms: int = BIN_MS, home_bins: int = HOME_BINS
) -> DataFrame:
    """`right` with `_near`: the rows of `left` (structs of `fields`, sorted) that may touch it, null where there are none.

    For ranges that overlap each other, where `range_join` would move a copy of a row for each range: ranges that begin in the
    same `home_bins` bins meet once all rows that any of them reaches, so a row moves once for its bin and once or twice for
    its homes. A home holds the rows of its time only, so an episode of any length spreads over tasks. The caller filters
    `_near` by its own condition, which must ask that the intervals touch.
    """
    first = lambda span: F.floor(F.col(span[0]) / bin_ms)
    last = lambda span: F.floor(F.greatest(*span) / bin_ms)
    spans = right.withColumn("_home", F.floor(first(right_span) / home_bins))
    regions = spans.groupBy(F.col(by).alias("_key"), F.col("_home").alias("_to_home")).agg(F.min(first(right_span)).alias("_from"), F.max(last(right_span)).alias("_to"))
    regions = regions.withColumn("_other", F.explode(F.sequence("_from", "_to"))).drop("_to")
    rows = left.select(by, F.struct(*fields).alias("_row"), first(left_span).alias("_first"), F.explode(_bins(F.col(left_span[0]), F.col(left_span[1]), bin_ms)).alias("_bin"))
    sent = rows.join(regions.hint("merge"), (F.col(by) == F.col("_key")) & (F.col("_bin") == F.col("_other")) & (F.col("_bin") == F.greatest("_first", "_from")))
    near = sent.groupBy("_key", "_to_home").agg(F.sort_array(F.collect_list("_row")).alias("_near"))
    return spans.join(near.hint("merge"), (F.col(by) == F.col("_key")) & (F.col("_home") == F.col("_to_home")), "left").drop("_home", "_key", "_to_home")


def asof_join(
    left: DataFrame, marks: DataFrame, by: str, left_time: str, mark_time: str, forward: bool = True, strict: bool = False, out: str = "mark_ms"
) -> DataFrame:
    """Each row of `left` with the next (or last) mark of its key; null where there is none.

    forward: the first mark at or after the row's time (after it, if strict); else the last mark at or before it
    (before it, if strict). One sort of the union of both sides by key and time.
    """
    names = left.columns
    rows = left.withColumn("_time", F.col(left_time)).withColumn("_mark", F.lit(None).cast("long")).withColumn("_is_mark", F.lit(0))
    points = marks.select(F.col(by), F.col(mark_time).cast("long").alias("_mark")).withColumn("_time", F.col("_mark")).withColumn("_is_mark", F.lit(1)).distinct()
    both = rows.unionByName(points, allowMissingColumns=True)
    # among equal times, a mark comes where the row may see it, or where it may not if strict
    marks_first = forward == strict
    order = [F.col("_time"), F.desc("_is_mark") if marks_first else F.asc("_is_mark")]
    window = Window.partitionBy(by).orderBy(*order)
    if forward:
        found = F.first("_mark", ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    else:
        found = F.last("_mark", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(out, found).where("_is_mark = 0").select(*names, out)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], begins: Column, out: str = "island") -> DataFrame:
    """Number the runs of rows of each key; a run begins where `begins` is true (and at the first row)."""
    window = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(begins.cast("int"), F.lit(0))
    return df.withColumn(out, F.sum(flag).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column, hull: bool = False) -> Column:
    """Overlap of two intervals over their union (or hull); swapped ends are put right, empty or null ones give 0."""
    s1, e1, s2, e2 = F.least(a_start, a_end), F.greatest(a_start, a_end), F.least(b_start, b_end), F.greatest(b_start, b_end)
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    common = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    whole = (F.greatest(e1, e2) - F.least(s1, s2)) if hull else (e1 - s1) + (e2 - s2) - common
    return F.when(known & (common > 0) & (whole > 0), common / whole).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 for two empty ones."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def greedy_keep(
    df: DataFrame, by: str, order: Sequence[Column], fields: Sequence[str], conflict, limit: int | None = None, large_group: int = large.LARGE_GROUP
) -> DataFrame:
    """Rows kept when each key's rows are taken in order and one that conflicts with a kept row is passed over.

    `conflict` is a rule of operators.large. Groups of up to `large_group` rows are folded inside the JVM over one sorted
    array; larger ones are read in order with an index of the kept rows. A count of the groups decides. A plain function
    (kept, candidate) of two structs of `fields` is taken too; it always folds, so its groups must be small.
    """
    if hasattr(conflict, "kept"):
        fold = lambda rows: _fold_keep(rows, by, order, fields, conflict.clash, limit)
        return large.by_size(df, by, fold, lambda rows: large.keep_large(rows, by, order, fields, conflict, limit), large_group)
    return _fold_keep(df, by, order, fields, conflict, limit)


def _fold_keep(df: DataFrame, by: str, order: Sequence[Column], fields: Sequence[str], conflict: Callable[[Column, Column], Column], limit: int | None) -> DataFrame:
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    row = F.struct(*keys, *fields)
    arrays = df.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("_all"))
    empty = F.filter("_all", lambda x: F.lit(False))

    def step(kept: Column, c: Column) -> Column:
        full = (F.size(kept) >= limit) if limit else F.lit(False)
        return F.when(full | F.exists(kept, lambda k: conflict(k, c)), kept).otherwise(F.concat(kept, F.array(c)))

    kept = arrays.select(by, F.posexplode(F.aggregate("_all", empty, step)).alias("_rank", "_row"))
    return kept.select(by, *(F.col(f"_row.{f}").alias(f) for f in fields), (F.col("_rank") + 1).cast("long").alias("pick"))


def ordered_fold(df: DataFrame, by: str, order: Sequence[Column], fields: Sequence[str], start: str, step: Callable[[Column, Column], Column], out: str = "state") -> DataFrame:
    """One value for each key: the rows in order, folded from the SQL literal `start`."""
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    arrays = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*keys, *fields))).alias("_all"))
    return arrays.select(by, F.aggregate("_all", F.expr(start), step).alias(out))
