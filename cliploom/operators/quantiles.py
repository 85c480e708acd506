"""Exact quantiles of groups of any size.

Groups of up to `large_group` rows are sorted as one array each. In larger ones a rank is found by histogram refinement: count, least
and greatest value of each of `BUCKETS` equal slices of the range are summed on the map side, the slice that holds the rank
becomes the next range (by its own least and greatest value, so empty parts go at once), until the slice holds one value
or so few rows that they are sorted. No task sees more of a group than its share of the input, or `FEW` rows.

Null and NaN values are left out; infinite ones are not expected. Null keys are a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators import large
from cliploom.operators.written import written

BUCKETS = 512
#: A slice of so many rows is sorted.
FEW = 2_000
#: So many ranges (of 60 bytes each) are broadcast; beyond it they are joined.
BROADCAST_RANGES = 20_000


def order_statistics(df: DataFrame, by: Sequence[str], value: str | Column, ranks: Callable[[Column], Sequence[Column]], large_group: int = large.LARGE_GROUP) -> DataFrame:
    """(by, n, at array<double>): the values of each group at the ranks (from 0) that `ranks` gives for its size."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    group = F.to_json(F.struct(*by, F.lit(0).alias("_"))).alias("_g")
    rows = df.select(*by, group, v.alias("_v")).where("_v is not null and not isnan(_v)")
    keys = [*(F.first(k).alias(k) for k in by), F.count("*").alias("n")]

    def clipped(n: Column) -> Column:
        return F.transform(F.array(*(r.cast("long") for r in ranks(n))), lambda r: F.greatest(F.lit(0), F.least(r, n - 1)))

    def small(rows: DataFrame) -> DataFrame:
        arrays = rows.groupBy("_g").agg(*keys, F.sort_array(F.collect_list("_v")).alias("vs"))
        return arrays.select(*by, "n", F.transform(clipped(F.col("n")), lambda r: F.get("vs", r.cast("int"))).alias("at"))

    def refined(rows: DataFrame) -> DataFrame:
        rows = written(rows, "values")
        sizes = rows.groupBy("_g").agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        ranges = written(sizes.select("_g", "c", "lo", "hi", F.posexplode(clipped(F.col("c"))).alias("t", "rank")), "ranges")
        while True:
            open_ = ranges.where(f"lo < hi and c > {FEW}")
            n = open_.count()
            if not n:
                break
            inside = rows.select("_g", "_v").join(_side(open_, n), "_g").where("_v between lo and hi")
            slot = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
            counts = inside.groupBy("_g", "t", "rank", slot.alias("slot")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            upto = F.sum("c").over(Window.partitionBy("_g", "t").orderBy("slot"))
            found = counts.withColumn("upto", upto).where("rank < upto and rank >= upto - c").withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c")))
            ranges = written(ranges.where(f"not (lo < hi and c > {FEW})").unionByName(found.select(ranges.columns)), "ranges")
        few = ranges.where("lo < hi")
        inside = rows.select("_g", "_v").join(_side(few, few.count()), "_g").where("_v between lo and hi")
        sorted_ = inside.groupBy("_g", "t", "rank").agg(F.sort_array(F.collect_list("_v")).alias("vs")).select("_g", "t", F.get("vs", F.col("rank").cast("int")).alias("value"))
        every = ranges.where("lo = hi").select("_g", "t", F.col("lo").alias("value")).unionByName(sorted_)
        at = every.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("at"))
        return rows.groupBy("_g").agg(*keys).join(at, "_g").select(*by, "n", "at")

    return large.by_size(rows, "_g", small, refined, large_group, df.select(group))


def _side(ranges: DataFrame, n: int) -> DataFrame:
    ranges = ranges.select("_g", "t", "rank", "lo", "hi")
    return F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, shares: Sequence[float], names: Sequence[str], large_group: int = large.LARGE_GROUP) -> DataFrame:
    """(by, names): quantiles with linear interpolation between the two ranks around share * (n - 1)."""
    spot = lambda n, q: F.lit(float(q)) * (n - 1)
    ranks = lambda n: [r for q in shares for r in (F.floor(spot(n, q)), F.ceil(spot(n, q)))]
    found = order_statistics(df, by, value, ranks, large_group)

    def between(i: int, q: float) -> Column:
        low, high, at = F.get("at", F.lit(2 * i)), F.get("at", F.lit(2 * i + 1)), spot(F.col("n"), q)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*by, *(between(i, q).alias(name) for i, (q, name) in enumerate(zip(shares, names))))
