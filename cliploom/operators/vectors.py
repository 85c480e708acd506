"""Similar vectors of a group, all of them: blocks around pivots, bounds on the angle, exact products.

Equal vectors are taken as one. A group of more than `BLOCK_ROWS` vectors is split around pivots (vectors of its own, drawn by
hash), and a pivot's cell into blocks of about `BLOCK_ROWS`. Angles obey the triangle inequality, so two blocks hold no similar
pair if the angle of their pivots less both radii exceeds the limit's angle; the others meet, a pair of blocks in a
task, as one matrix product. Nothing is missed at any limit; how many blocks meet depends on how the data cluster
(evenly spread vectors at a low limit all meet, which costs the square of a group in arithmetic, though not in rows).

Null, empty and zero vectors are similar to nothing; vectors are compared with those of their own length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cliploom.operators.written import written

BLOCK_ROWS = 2_000
#: Cosines that a task holds at once, and pairs of a batch that it sends on.
COSINES = 500_000
PAIRS = 50_000
#: Pivots of one group, and bytes of all pivots that may be sent to executors; beyond these bytes blocks are drawn by hash alone.
MOST_PIVOTS = 256
PIVOT_BYTES = 64 << 20


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distinct_vectors(embeddings: DataFrame, key: str, block: str, vector: str) -> DataFrame:
    """(g, id, x, ids): the vectors of each group once, of length 1, under their least key; `ids` counts their rows."""
    rows = embeddings.select(F.col(block).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    once = rows.groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("ids"))
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    return once.withColumn("_n", length).where("_n > 0 and not isnan(_n)").select("g", "id", "ids", F.transform("v", lambda e: e / F.col("_n")).alias("x"))


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a batch as arrays of doubles, without a Python number for each element."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
    return [values[low:high] for low, high in zip(np.r_[0, ends[:-1]], ends)]


def pairs_of(left: list[tuple], right: list[tuple], least: float, ident: pa.DataType) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(a, b, cosine) of rows (side, id, vector) of two sides with cosine `least` or more, a slice of the product at a time.
    Rows of side 2 stand on both sides and are paired with larger ids only."""
    ids = sorted({r[1] for r in left} | {r[1] for r in right})
    place, known = {v: i for i, v in enumerate(ids)}, pa.array(ids, ident)
    one, two = (np.array([place[r[1]] for r in side], np.int64) for side in (left, right))
    inside = np.array([r[0] == 2 for r in left])
    first, second = np.array([r[2] for r in left]), np.array([r[2] for r in right]).T
    step = max(1, COSINES // len(right))
    for at in range(0, len(left), step):
        cosines = first[at : at + step] @ second
        i, j = np.nonzero(cosines >= least - 1e-12)
        a, b = one[at + i], two[j]
        kept = np.flatnonzero(~inside[at + i] | (a < b))
        for low in range(0, len(kept), PAIRS):
            k = kept[low : low + PAIRS]
            yield known.take(pa.array(np.minimum(a[k], b[k]))), known.take(pa.array(np.maximum(a[k], b[k]))), cosines[i[k], j[k]]


def pivots_of(rows: DataFrame, sizes: DataFrame, block_rows: int) -> dict:
    """Pivots of the groups that need more than one block (group to matrix); bounded, else none."""
    wanted = sizes.where(F.col("n") > block_rows).select(F.col("g").alias("_g"), F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / block_rows)).alias("k"), "n")
    drawn = rows.join(wanted, rows.g.eqNullSafe(F.col("_g"))).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("k") / F.col("n") * (1 << 30))
    bytes_ = drawn.agg(F.sum(8 * F.size("x"))).first()[0] or 0
    if bytes_ > PIVOT_BYTES:
        return {}
    out: dict = {}
    for r in drawn.select("g", "id", "x").orderBy("id").collect():
        if not out.get(r.g) or len(out[r.g][0]) == len(r.x):
            out.setdefault(r.g, []).append(r.x)
    return {g: np.array(m) for g, m in out.items()}


def in_blocks(rows: DataFrame, pivots: dict, block_rows: int) -> DataFrame:
    """(g, id, x, cell, angle, part): each vector with its nearest pivot, the angle to it, and its block of the cell."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, vectors = batch.column("g").to_pylist(), arrays_of(batch.column("x"))
            cell, angle = [-1] * len(groups), [math.pi] * len(groups)
            held: dict = {}
            for i, (g, x) in enumerate(zip(groups, vectors)):
                if g in sent.value and sent.value[g].shape[1] == len(x):
                    held.setdefault(g, []).append(i)
            for g, at in held.items():
                cosines = np.array([vectors[i] for i in at]) @ sent.value[g].T
                best = cosines.argmax(1)
                turned = np.arccos(np.clip(cosines[np.arange(len(at)), best], -1, 1))
                for i, c, a in zip(at, best.tolist(), turned.tolist()):
                    cell[i], angle[i] = c, a
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "id", "x")), pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["g", "id", "x", "cell", "angle"])

    g, ident = (rows.schema[c].dataType.simpleString() for c in ("g", "id"))
    celled = written(rows.select("g", "id", "x").mapInArrow(near, f"g {g}, id {ident}, x array<double>, cell int, angle double"), "cells")
    parts = celled.groupBy(F.col("g").alias("_g"), F.col("cell").alias("_cell")).agg(F.ceil(F.count("*") / block_rows).alias("_parts"))
    joined = celled.join(parts, celled.g.eqNullSafe(F.col("_g")) & (celled.cell == F.col("_cell")))
    return joined.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_parts")).cast("int")).drop("_g", "_cell", "_parts")


def meetings(blocks: DataFrame, pivots: dict, least: float) -> DataFrame:
    """(pair, g, cell, part, side): the blocks of each pair of blocks of a group that may hold similar vectors."""
    spark = blocks.sparkSession
    table = blocks.groupBy("g", "cell", "part").agg(F.max("angle").alias("radius"))
    g = blocks.schema["g"].dataType.simpleString()
    known = spark.createDataFrame([(k, i, p.tolist()) for k, m in pivots.items() for i, p in enumerate(m)], f"_g {g}, _cell int, pivot array<double>")
    table = table.join(F.broadcast(known), table.g.eqNullSafe(F.col("_g")) & (table.cell == F.col("_cell")), "left").drop("_g", "_cell")
    table = written(table, "blocks")
    one = table.select("g", *(F.col(c).alias(f"{c}1") for c in ("cell", "part", "radius", "pivot")))
    two = table.select(F.col("g").alias("_g"), *(F.col(c).alias(f"{c}2") for c in ("cell", "part", "radius", "pivot")))
    turned = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("pivot1"), F.col("pivot2")))))
    far = F.coalesce((F.col("cell1") != F.col("cell2")) & (turned - F.col("radius1") - F.col("radius2") > math.acos(least) + 1e-9), F.lit(False))
    ordered = (F.col("cell1") < F.col("cell2")) | ((F.col("cell1") == F.col("cell2")) & (F.col("part1") <= F.col("part2")))
    met = one.join(two, F.col("g").eqNullSafe(F.col("_g")) & ordered & ~far)
    name = F.concat_ws(":", F.coalesce(F.col("g").cast("string"), F.lit("")), F.col("g").isNull().cast("string"), "cell1", "part1", "cell2", "part2")
    met = met.select(name.alias("pair"), "g", "cell1", "part1", "cell2", "part2")
    first = met.select("pair", "g", F.col("cell1").alias("cell"), F.col("part1").alias("part"), F.when((F.col("cell1") == F.col("cell2")) & (F.col("part1") == F.col("part2")), 2).otherwise(0).alias("side"))
    second = met.where("cell1 != cell2 or part1 != part2").select("pair", "g", F.col("cell2").alias("cell"), F.col("part2").alias("part"), F.lit(1).alias("side"))
    return first.unionByName(second)


def similar_pairs(rows: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(g, a, b, similarity) with a < b of distinct unit vectors (g, id, x) with cosine `least` (-1 to 1) or more."""
    rows = written(rows, "vectors")
    pivots = pivots_of(rows, rows.groupBy("g").agg(F.count("*").alias("n")), block_rows)
    blocks = in_blocks(rows, pivots, block_rows)
    met = meetings(blocks, pivots, least).select("pair", "side", F.col("g").alias("_g"), F.col("cell").alias("_cell"), F.col("part").alias("_part"))
    dealt = blocks.join(met, blocks.g.eqNullSafe(F.col("_g")) & (blocks.cell == F.col("_cell")) & (blocks.part == F.col("_part"))).select("pair", "side", "g", "id", "x")
    g, ident = (rows.schema[c].dataType.simpleString() for c in ("g", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meeting() -> Iterator[list[tuple]]:
            group: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "g", "id")), arrays_of(batch.column("x"))):
                    if group and group[-1][0] != row[0]:
                        yield group
                        group = []
                    group.append(row)
            if group:
                yield group

        for group in meeting():
            by_length: dict[int, list[tuple]] = {}
            for _, side, _, id_, x in group:
                by_length.setdefault(len(x), []).append((side, id_, x))
            for part in by_length.values():
                left, right = [r for r in part if r[0] != 1], [r for r in part if r[0] != 0]
                if left and right:
                    for one, two, cosine in pairs_of(left, right, least, schema.field("a").type):
                        yield pa.RecordBatch.from_arrays([pa.array([group[0][2]] * len(one), schema.field("g").type), one, two, pa.array(cosine)], schema=schema)

    ddl = f"g {g}, a {ident}, b {ident}, similarity double"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    return dealt.repartition("pair").sortWithinPartitions("pair", "side", "id").mapInArrow(run, ddl)


def first_kept(pairs: DataFrame) -> DataFrame:
    """(g, id): rows that are passed over when rows are taken by id and one similar to a kept row is not kept.

    `pairs` are (g, a, b) with a < b. In each round the rows without an open earlier neighbour are kept and their neighbours
    go, with all links of both; links are spread over tasks, no component is gathered. Rounds: the longest chain of links
    that hang on each other.
    """
    links, gone = written(pairs.select("g", "a", "b").distinct(), "links"), None
    same = lambda x, y, c, d: x["g"].eqNullSafe(y["_g"]) & (x[c] == y[d])
    while not links.isEmpty():
        later = links.select(F.col("g").alias("_g"), F.col("b").alias("_id")).distinct()
        first = links.select("g", "a").distinct()
        first = first.join(later, same(first, later, "a", "_id"), "left_anti").select(F.col("g").alias("_g"), F.col("a").alias("_id"))
        now = written(links.join(first, same(links, first, "a", "_id"), "left_semi").select(F.col("g").alias("_g"), F.col("b").alias("_id")).distinct(), "gone")
        gone = now if gone is None else gone.unionByName(now)
        links = links.join(now, same(links, now, "a", "_id"), "left_anti")
        links = written(links.join(now, same(links, now, "b", "_id"), "left_anti"), "links")
    if gone is None:
        return pairs.select("g", F.col("a").alias("id")).limit(0)
    return gone.select(F.col("_g").alias("g"), F.col("_id").alias("id"))
