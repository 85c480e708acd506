"""Sharding by histogram sort (operator 1), law `bytes`: shards of nearly equal size.

Rows are ordered by (hash of the text, hash of the id, id), so equal texts lie side by side. Each round counts,
over all partitions, the exact bytes in `PROBES` equal slices of every bracket that holds a wanted boundary, and
keeps the slice with the boundary as the next bracket. A boundary is settled once its bracket holds no more than
`tolerance` of a shard, or a single key; a group of equal texts is thus cut only where it is larger than that.
Rows then learn their shard from the settled boundaries and are exchanged once.

Null text has no bytes and the checksum of none. A null id sorts before all others. Rows alike in text and id
cannot be told apart and share a shard. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import stash, table

SHARDS = 24
PROBES = 256
TOLERANCE = 0.005
LOWEST = -(1 << 63)
KEYS = ("text_key", "id_key")


@dataclass
class Bracket:
    """A range [low, high) of one key part, after `fixed` values of the parts before it."""

    target: float
    fixed: list[int] = field(default_factory=list)
    low: int = LOWEST
    high: int = 1 << 63
    below: int = 0
    settled: tuple[int, ...] | None = None

    def place(self) -> tuple:
        return (tuple(self.fixed), self.low, self.high)


def narrow(docs: DataFrame) -> DataFrame:
    """Keys, size and checksum of each row, without its text."""
    text, doc_id = F.col("text"), F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64(F.coalesce(doc_id, F.lit(LOWEST)), F.lit(1)).alias("id_key"),
    )


def slice_of(bracket: Bracket) -> Column:
    """Which of the bracket's slices a row inside it is in, in whole numbers."""
    key = KEYS[len(bracket.fixed)]
    width = -(-(bracket.high - bracket.low) // PROBES)
    if bracket.high - bracket.low == 1 << 64:  # distances do not fit a long; the leading bits tell the slice
        return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(LOWEST)), 56).cast("int")
    distance = f"({key} + 9223372036854775807L) + 1L" if bracket.low == LOWEST else f"{key} - ({bracket.low}L)"
    return F.expr(f"cast(({distance}) div {width}L as int)")


def inside(bracket: Bracket) -> Column:
    key = F.col(KEYS[len(bracket.fixed)])
    found = key.between(F.lit(bracket.low), F.lit(bracket.high - 1))
    for name, value in zip(KEYS, bracket.fixed):
        found &= F.col(name) == F.lit(value)
    return found


def refine(rows: DataFrame, brackets: list[Bracket]) -> dict[tuple, dict[int, int]]:
    """Exact bytes in each slice of each open bracket: one aggregation, at most brackets times `PROBES` rows."""
    which, piece = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(brackets))):
        which = F.when(inside(b), F.lit(i)).otherwise(which)
        piece = F.when(inside(b), slice_of(b)).otherwise(piece)
    counts = rows.select(which.alias("b"), piece.alias("s"), "size").where("b is not null").groupBy("b", "s").agg(F.sum("size").alias("n"))
    found: dict[tuple, dict[int, int]] = {b.place(): {} for b in brackets}
    for r in counts.collect():
        found[brackets[r.b].place()][r.s] = int(r.n)
    return found


def advance(bracket: Bracket, counts: dict[int, int], slack: float) -> None:
    """Move to the slice with the boundary; settle where that is near enough."""
    width = -(-(bracket.high - bracket.low) // PROBES)
    before, at = bracket.below, PROBES - 1
    for i in sorted(counts):
        at = i
        if before + counts[i] >= bracket.target:
            break
        before += counts[i]
    held = counts.get(at, 0)
    low = bracket.low + at * width
    high = min(low + width, bracket.high)
    bracket.below, bracket.low, bracket.high = before, low, high
    nearer_end = before + held - bracket.target < bracket.target - before
    if held <= slack:
        bracket.settled = (*bracket.fixed, high if nearer_end else low)
    elif high - low == 1:
        if len(bracket.fixed) + 1 == len(KEYS):
            bracket.settled = (*bracket.fixed, high if nearer_end else low)
        else:
            bracket.fixed, bracket.low, bracket.high = [*bracket.fixed, low], LOWEST, 1 << 63


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The shards - 1 boundaries; the driver sees slice counts only."""
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    brackets = [Bracket(total * (i + 1) / shards) for i in range(shards - 1)]
    while open_ := [b for b in brackets if b.settled is None]:
        distinct = list({b.place(): b for b in open_}.values())
        counts = refine(rows, distinct)
        for b in open_:
            advance(b, counts[b.place()], tolerance * total / shards)
    return sorted(b.settled for b in brackets)


def reached(boundary: tuple[int, ...]) -> Column:
    """Whether a row lies at or after the boundary."""
    last = F.lit(True) if boundary[-1] <= LOWEST else (F.lit(False) if boundary[-1] >= 1 << 63 else F.col(KEYS[len(boundary) - 1]) >= F.lit(boundary[-1]))
    if len(boundary) == 1:
        return last
    first = F.col(KEYS[0])
    return (first > F.lit(boundary[0])) | ((first == F.lit(boundary[0])) & last)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Shard and slot of each row of `docs` (doc_id, text); slots run without gaps in each shard.

    A shard's rows are dealt out to cells by id, numbered there, and moved up by the counts of the cells before.
    """
    rows = stash(narrow(docs), "sizes")
    number = F.lit(0)
    for boundary in splitters(rows, shards, tolerance):
        number = number + reached(boundary).cast("int")
    cells = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("shard", number.cast("int")).withColumn("cell", F.pmod(F.hash("id_key"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("cell_rows"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("before"))
    in_cell = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*KEYS, "doc_id"))
    return (
        rows.withColumn("in_cell", in_cell)
        .join(counts, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("in_cell") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
