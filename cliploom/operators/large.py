"""Ordered selection in groups that are too large for one array.

A group's rows are sorted inside its partition (the sort spills) and read once in Arrow batches; what is held is an index of
the rows that were kept, never the group. The rules below say which kept row a candidate conflicts with, once as a
Column for the fold over small groups and once as such an index, so both give the same rows.

Spans are held in a grid of levels: one of length n stands in the one or two cells of width 2 ** bits(n) that it touches. An overlap
share of `least` bounds the ratio of lengths, so a candidate looks into the cells of a few levels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Groups of more rows than this are read in order instead of being folded as one array.
LARGE_GROUP = 10_000
#: Rows of one record batch that a task gives back.
BATCH_ROWS = 10_000


#: Cells are 2 ** LEAST_LEVEL milliseconds wide at least.
LEAST_LEVEL = 10


def level_of(length: float) -> int:
    return max(LEAST_LEVEL, int(length).bit_length())


class Cells:
    """Spans by cell of their own level."""

    def __init__(self):
        self.cells: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self.levels: set[int] = set()

    def add(self, start: int, end: int) -> None:
        level = level_of(end - start)
        self.levels.add(level)
        for cell in {start >> level, end >> level}:
            self.cells[level, cell].append((start, end))

    def near(self, start: int, end: int, shortest: float = 0, longest: float | None = None) -> Iterator[tuple[int, int]]:
        """Spans that may touch this one, of levels between those of the two lengths."""
        for level in self.levels:
            if level_of(shortest) <= level and (longest is None or level <= level_of(longest)):
                for cell in range(start >> level, (end >> level) + 1):
                    yield from self.cells.get((level, cell), ())


def spans_overlap(a: tuple[int, int], b: tuple[int, int], hull: bool) -> float:
    common = min(a[1], b[1]) - max(a[0], b[0])
    whole = max(a[1], b[1]) - min(a[0], b[0]) if hull else (a[1] - a[0]) + (b[1] - b[0]) - common
    return common / whole if common > 0 and whole > 0 else 0.0


@dataclass(frozen=True)
class Overlap:
    """Spans share `least` (above 0) of their union or hull. Swapped ends are put right; empty and null spans share nothing."""

    least: float
    hull: bool = False

    def clash(self, k: Column, c: Column) -> Column:
        from cliploom.operators.patterns import iou

        return iou(k["start_ms"], k["end_ms"], c["start_ms"], c["end_ms"], self.hull) >= self.least

    def kept(self) -> "Kept":
        cells = Cells()

        def span(row: dict) -> tuple[int, int] | None:
            s, e = row["start_ms"], row["end_ms"]
            return None if s is None or e is None or s == e else (min(s, e), max(s, e))

        def conflicts(row: dict) -> bool:
            if (own := span(row)) is None:
                return False
            n = own[1] - own[0]
            return any(spans_overlap(own, other, self.hull) >= self.least for other in cells.near(*own, n * self.least - 1, n / self.least + 1))

        def add(row: dict) -> None:
            if own := span(row):
                cells.add(*own)

        return Kept(conflicts, add)


@dataclass(frozen=True)
class Touch:
    """Spans touch, more than at an end: each starts before the other ends, as the ends stand."""

    def clash(self, k: Column, c: Column) -> Column:
        return (k["start_ms"] < c["end_ms"]) & (k["end_ms"] > c["start_ms"])

    def kept(self) -> "Kept":
        cells, swapped = Cells(), []

        def conflicts(row: dict) -> bool:
            s, e = row["start_ms"], row["end_ms"]
            if s is None or e is None:
                return False
            others = cells.near(min(s, e), max(s, e))
            return any(a < e and b > s for a, b in others) or any(a < e and b > s for a, b in swapped)

        def add(row: dict) -> None:
            s, e = row["start_ms"], row["end_ms"]
            if s is not None and e is not None:
                cells.add(s, e) if s <= e else swapped.append((s, e))

        return Kept(conflicts, add)


@dataclass(frozen=True)
class Near:
    """Values of all the columns are at most `tolerance` apart (integers); nulls are near nothing."""

    columns: tuple[str, ...]
    tolerance: int

    def clash(self, k: Column, c: Column) -> Column:
        out = F.lit(True)
        for name in self.columns:
            out &= F.abs(k[name] - c[name]) <= self.tolerance
        return out

    def kept(self) -> "Kept":
        cells, width = defaultdict(list), self.tolerance + 1

        def values(row: dict) -> tuple[int, ...]:
            return tuple(row[name] for name in self.columns)

        def around(at: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
            if not at:
                yield ()
                return
            for rest in around(at[1:]):
                for x in (at[0] - 1, at[0], at[0] + 1):
                    yield (x, *rest)

        def conflicts(row: dict) -> bool:
            own = values(row)
            if None in own:
                return False
            return any(all(abs(a - b) <= self.tolerance for a, b in zip(own, other)) for cell in around(tuple(v // width for v in own)) for other in cells.get(cell, ()))

        def add(row: dict) -> None:
            own = values(row)
            if None not in own:
                cells[tuple(v // width for v in own)].append(own)

        return Kept(conflicts, add)


@dataclass(frozen=True)
class Alike:
    """Sets in `words` have a Jaccard similarity of `least` (above 0) or more and, with `near_ms`, middles that near.

    The index holds 8 bytes for each word of a kept row. Similar sets share one of their first words by hash (as many as
    the limit leaves room for), and only kept rows with such a word are compared.
    """

    words: str
    least: float
    near_ms: int | None = None

    def clash(self, k: Column, c: Column) -> Column:
        from cliploom.operators.patterns import jaccard

        alike = jaccard(k[self.words], c[self.words]) >= self.least
        return alike if self.near_ms is None else alike & (F.abs((k["start_ms"] + k["end_ms"]) - (c["start_ms"] + c["end_ms"])) <= 2 * self.near_ms)

    def kept(self) -> "Kept":
        sets, middles, first = [], [], defaultdict(list)

        def coded(row: dict) -> np.ndarray:
            return np.unique(np.array([hash(w) for w in row[self.words] or ()], np.int64))

        def lead(own: np.ndarray) -> np.ndarray:
            return own[: len(own) - int(np.ceil(self.least * len(own) - 1e-9)) + 1]

        def middle(row: dict) -> int | None:
            if self.near_ms is None:
                return 0
            return None if row["start_ms"] is None or row["end_ms"] is None else row["start_ms"] + row["end_ms"]

        def conflicts(row: dict) -> bool:
            own, at, tried = coded(row), middle(row), set()
            for w in lead(own).tolist():
                for i in first.get(w, ()):
                    if i in tried:
                        continue
                    tried.add(i)
                    if self.near_ms is not None and (at is None or middles[i] is None or abs(middles[i] - at) > 2 * self.near_ms):
                        continue
                    common = len(np.intersect1d(own, sets[i], assume_unique=True))
                    if common / (len(own) + len(sets[i]) - common) >= self.least:
                        return True
            return False

        def add(row: dict) -> None:
            own = coded(row)
            for w in lead(own).tolist():
                first[w].append(len(sets))
            sets.append(own)
            middles.append(middle(row))

        return Kept(conflicts, add)


@dataclass(frozen=True)
class Shared:
    """Sets in `words` have more than `most` words in common. Every kept row is compared: for selections with a limit."""

    words: str
    most: int

    def clash(self, k: Column, c: Column) -> Column:
        return F.size(F.array_intersect(k[self.words], c[self.words])) > self.most

    def kept(self) -> "Kept":
        sets: list[set] = []
        return Kept(lambda row: any(len(s.intersection(row[self.words] or ())) > self.most for s in sets), lambda row: sets.append(set(row[self.words] or ())))


@dataclass(frozen=True)
class AnyOf:
    """One of the rules holds."""

    rules: tuple

    def clash(self, k: Column, c: Column) -> Column:
        out = F.lit(False)
        for rule in self.rules:
            out |= F.coalesce(rule.clash(k, c), F.lit(False))
        return out

    def kept(self) -> "Kept":
        parts = [rule.kept() for rule in self.rules]
        return Kept(lambda row: any(p.conflicts(row) for p in parts), lambda row: [p.add(row) for p in parts] and None)


@dataclass(frozen=True)
class Kept:
    """An index of kept rows."""

    conflicts: Callable[[dict], bool]
    add: Callable[[dict], None]


def ordered_stream(
    df: DataFrame, by: str, order: Sequence[Column | str], fields: Sequence[str], begin: Callable[[], tuple[Callable[[dict], Iterable[tuple]], Callable[[], Iterable[tuple]]]], out: str
) -> DataFrame:
    """(by, `out` columns): each group's rows in order through a pair of functions that `begin` makes for the group.

    The first takes a row and gives rows, the second gives rows at the end of the group. Rows are sorted in their
    partition and read in batches.
    """
    key_type = df.schema[by].dataType.simpleString()
    ddl = f"{by} {key_type}, {out}"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, any_yet, take, finish = None, False, None, None
            for batch in batches:
                keys, columns = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
                for k, *values in zip(keys, *columns):
                    if not any_yet or k != key:
                        if any_yet:
                            yield from ((key, *r) for r in finish())
                        key, any_yet = k, True
                        take, finish = begin()
                    yield from ((key, *r) for r in take(dict(zip(names, values))))
            if any_yet:
                yield from ((key, *r) for r in finish())

        held = []
        for row in rows():
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    columns = [c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select(by, *names, *columns).repartition(by)
    return rows.sortWithinPartitions(by, *(f"_o{i}" for i in range(len(columns))), *names).select(by, *names).mapInArrow(run, ddl)


def by_size(
    df: DataFrame, by: str, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], limit: int = LARGE_GROUP, counted: DataFrame | None = None
) -> DataFrame:
    """`small` of the groups of up to `limit` rows with `large` of the others; one count of the groups decides.

    `counted` may give rows that are cheaper to count (as many of each group or more).
    """
    over = (df if counted is None else counted).groupBy(F.col(by).alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_large")
    if over.isEmpty():
        return small(df)
    same = df[by].eqNullSafe(F.col("_large"))
    a, b = small(df.join(over, same, "left_anti")), large(df.join(over, same, "left_semi"))
    return a.unionByName(b)


def keep_large(df: DataFrame, by: str, order: Sequence[Column], fields: Sequence[str], rule, limit: int | None = None) -> DataFrame:
    """As patterns.greedy_keep, for groups of any size."""

    def begin():
        kept, n = rule.kept(), [0]

        def take(row: dict) -> Iterator[tuple]:
            if (limit is None or n[0] < limit) and not kept.conflicts(row):
                kept.add(row)
                n[0] += 1
                yield (*row.values(), n[0])

        return take, lambda: ()

    types = ", ".join(f"{f} {df.schema[f].dataType.simpleString()}" for f in fields)
    return ordered_stream(df, by, order, fields, begin, f"{types}, pick long")
