"""Conversation structure repair (operator 13).

The roles of a conversation should read: perhaps a system turn, then user and assistant in turn (`(s?(ua)+)?` by
first letters). Edits mend it: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate rows), Insert
an empty user or assistant turn (5); a truncated row that stays costs 5 more. Of the cheapest repairs the one
whose edit letters are least in ASCII order is taken.

A backward pass over the rows computes, for each of four states of the pattern, the least cost of all that follows. It
stores this vector only at checkpoints, about every square root of the rows; the walk forward recomputes the vectors of
one block at a time and takes at each row the least letter whose cost is tight.

Conversations of up to `LARGE_BYTES` are repaired whole in one task, rows in order. Larger ones are cut into blocks by a
range exchange and no task holds more than a block: each block is summed up as a 4 by 4 table of least costs from state to
state, the tables give the cost vectors at the blocks' ends (the checkpoints), each block is walked from its four possible
states, and the walks are joined. Duplicates of such conversations are found by grouping on a hash of the text.

Rows are taken by turn (nulls first), then by role and by SHA-256 of the text. Null role or text is one space. A row whose
`present` is false only names its conversation. Null conversation ids are one conversation. Conversations without
rows have zeros and an empty audit. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import SLICE_BYTES, stash, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation with more text than this is cut into blocks of about `BLOCK_BYTES`.
LARGE_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20
#: What a row counts besides its text.
ROW_BYTES = 64

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant. A new turn can only be a user's, but after a user's the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: State after keeping a row whose role begins with the letter, by state before; None where it does not fit.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NO_FIT = (None,) * 4
LEGAL = {"su", "ua", "au"}
EDITED = "conv_id long, part int, at long, turn long, role string, text string, fault string, ops string"


Costs = tuple[int, int, int, int]
Row = tuple[str, bool, bool]


def with_inserts(costs: Iterable[int]) -> Costs:
    """Costs where turns may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


#: Costs after the last row: an open pattern is closed by inserted turns.
END = with_inserts([0, NEVER, NEVER, 0])


def choices(row: Row, after: Costs, q: int) -> list[tuple[str, int, int]]:
    """Edits of a row (letter of its role, must go, truncated) in state q: letter, cost of it and all that follows, state after."""
    letter, must_go, truncated = row
    found = [("D", DELETE + after[q], q)]
    if not must_go:
        stays = TRUNCATED * truncated
        kept = KEPT.get(letter, NO_FIT)[q]
        if kept is not None:
            found.append(("K", stays + after[kept], kept))
        found.append(("R", stays + REROLE + after[NEXT[q]], NEXT[q]))
    return found


#: Vectors differ by small amounts once their least entry is taken off, so few rows need computing twice.
@lru_cache(1 << 16)
def before(row: Row, after: Costs) -> Costs:
    return with_inserts(min(c[1] for c in choices(row, after, q)) for q in range(4))


@lru_cache(1 << 16)
def relative(row: Row, after: Costs) -> Costs:
    costs = before(row, after)
    return tuple(c - min(costs) for c in costs)


@lru_cache(1 << 16)
def step(row: Row, after: Costs, q: int) -> tuple[int, str]:
    """State after a row and its letters: inserts, then its edit, each the least letter that is tight."""
    costs, letters = before(row, after), ""
    while not letters or letters[-1] == "I":
        found = [*choices(row, after, q), ("I", INSERT + costs[NEXT[q]], NEXT[q])]
        letter, _, q = min(c for c in found if c[1] == costs[q])
        letters += letter
    return q, letters


def checkpoints(rows: list[Row], end: Costs) -> tuple[int, list[Costs]]:
    """Rows of a block, and the cost vector (less its least entry) after each block."""
    size = max(1, math.isqrt(len(rows)))
    vectors, costs = [end], end
    for i in range(len(rows) - 1, 0, -1):
        costs = relative(rows[i], costs)
        if i % size == 0:
            vectors.append(costs)
    return size, vectors[::-1]


def walk(rows: list[Row], end: Costs, starts: Iterable[int]) -> dict[int, tuple[int, list[str]]]:
    """From each starting state: the state after the rows, and the letters of each row."""
    size, vectors = checkpoints(rows, end)
    paths = {q: (q, []) for q in starts}
    for b, low in enumerate(range(0, len(rows), size)):
        block, after = rows[low : low + size], [vectors[b]]
        for row in reversed(block[1:]):
            after.append(relative(row, after[-1]))
        for start, (q, ops) in paths.items():
            for row, costs in zip(block, reversed(after)):
                q, letters = step(row, costs, q)
                ops.append(letters)
            paths[start] = q, ops
    return paths


def closing(q: int) -> str:
    """Inserts after the last row."""
    return {SYSTEM: "II", USER: "I"}.get(q, "")


def fault_of(text: str, seen_before: bool) -> str | None:
    last = text.rstrip(SPACE)[-1:]
    if not last:
        return "blank"
    return "duplicate" if seen_before else None if last in ".!?" else "truncated"


def coded(role: str, fault: str | None) -> Row:
    return role[:1] if role[:1] in KEPT else "", fault in ("blank", "duplicate"), fault == "truncated"


def batches_of(rows: Iterable[tuple], schema: pa.Schema, sized: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded size; `sized` is the place of a text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[sized] or "") if sized is not None else 0)
        if size > SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t.replace("array<long>", "longs").replace("array<string>", "strings")]) for n, t in (c.split() for c in ddl.split(", "))])


def edited_small(rows: DataFrame) -> DataFrame:
    """Rows with fault and letters where whole conversations stay in one task."""
    schema = arrow(EDITED)

    def one(conv: int | None, group: list[tuple]) -> Iterator[tuple]:
        seen, faults = set(), []
        for _, role, text in group:
            key = hashlib.sha256(f"{role}\0{text}".encode()).digest()
            faults.append(fault_of(text, key in seen))
            seen.add(key)
        q, ops = walk([coded(r[1], f) for r, f in zip(group, faults)], END, [START])[START]
        for i, ((turn, role, text), fault) in enumerate(zip(group, faults)):
            yield conv, 0, i, turn, role, text, fault, ops[i]
        yield conv, 0, len(group), None, None, None, None, closing(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            group, conv, any_yet = [], None, False
            for c, turn, role, text, present in rows_in(batches):
                if any_yet and c != conv:
                    yield from one(conv, group)
                    group = []
                conv, any_yet = c, True
                if present:
                    group.append((turn, role, text))
            if any_yet:
                yield from one(conv, group)

        yield from batches_of(out(), schema, 5)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.sha2("text", 256))
    return ordered.select("conv_id", "turn", "role", "text", "present").mapInArrow(run, EDITED)


def edited_large(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same where a conversation may be larger than a task can hold; rows with `present` false are left out."""
    rows = rows.where("present").withColumn("key", F.sha2("text", 256))
    size = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    parts = max(2, -(-size // block_bytes))
    placed_as, block_as = "conv_id long, part int, at long, turn long, role string, text string, key string, first_fault string", "conv_id long, part int, at long, n long, costs array<long>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield from batches_of(((c, part, i, t, r, x, k, fault_of(x, False)) for i, (c, t, r, x, k) in enumerate(rows_in(batches))), arrow(placed_as), 5)

    # Equal rows are dealt by chance, so that many copies of one row do not meet in one block.
    by = ["conv_id", "turn", "role", "key", "salt"]
    ordered = rows.withColumn("salt", F.rand(13)).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stash(ordered.select("conv_id", "turn", "role", "text", "key").mapInArrow(place, placed_as), "placed")
    firsts = placed.groupBy("conv_id", "role", "key").agg(F.min(F.struct("part", "at")).alias("p")).select("p.part", "p.at", F.lit(True).alias("first"))
    fault = F.when((F.col("first_fault") != "blank") | F.col("first_fault").isNull(), F.when(F.col("first").isNull(), "duplicate").otherwise(F.col("first_fault"))).otherwise("blank")
    placed = placed.join(firsts, ["part", "at"], "left").withColumn("fault", fault).drop("first", "first_fault", "key")
    codes = stash(placed.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("role"), "fault"), "codes")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for row in rows_in(batches):
            if group and (group[-1][0], group[-1][1]) != (row[0], row[1]):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for group in runs(batches):
                columns = []
                for q in range(4):
                    costs = tuple(0 if x == q else NEVER for x in range(4))
                    for row in reversed(group):
                        costs = before(coded(row[3] or "", row[4]), costs)
                    columns += costs
                yield group[0][0], group[0][1], group[0][2], len(group), columns

        yield from batches_of(out(), arrow(block_as))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cost vector at the end of each block; blocks come last first."""

        def out() -> Iterator[tuple]:
            conv, costs, any_yet = None, END, False
            for c, part, at, n, columns in rows_in(batches):
                if not any_yet or c != conv:
                    conv, costs, any_yet = c, END, True
                yield c, part, at, n, costs
                costs = with_inserts(min(columns[4 * to + q] + costs[to] for to in range(4)) for q in range(4))

        yield from batches_of(out(), arrow(block_as))

    in_part = codes.repartition("part").sortWithinPartitions("part", "conv_id", "at")
    blocks = in_part.mapInArrow(tables, block_as)
    vectors = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(ends, block_as)
    walks_as = "conv_id long, part int, at long, n long, costs array<long>, ops array<string>"

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From all four states: the states at the end and the letters; the cost vector of a block comes before its rows."""

        def out() -> Iterator[tuple]:
            for group in runs(batches):
                head, rest = group[0], group[1:]
                found = walk([coded(r[3] or "", r[4]) for r in rest], tuple(head[5]), range(4))
                yield head[0], head[1], rest[0][2], len(rest), [found[q][0] for q in range(4)], [" ".join(found[q][1]) for q in range(4)]

        yield from batches_of(out(), arrow(walks_as))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of each block from the state that the block before leaves; blocks come in order."""

        def out() -> Iterator[tuple]:
            conv, q, last = None, START, None
            for c, part, at, n, states, ops in rows_in(batches):
                if last and c != conv:
                    yield conv, *last, closing(q), True
                    q = START
                yield c, part, at, ops[q], False
                conv, q, last = c, states[q], (part, at + n)
            if last:
                yield conv, *last, closing(q), True

        kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("ops", pa.string()), ("ends", pa.bool_())])
        yield from batches_of(out(), kinds, 3)

    heads = vectors.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("fault"), "costs")
    both = codes.withColumn("costs", F.lit(None).cast("array<long>")).unionByName(heads)
    walked = both.repartition("part").sortWithinPartitions("part", "conv_id", "at").select("conv_id", "part", "at", "role", "fault", "costs").mapInArrow(walks, walks_as)
    chosen = stash(walked.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(joined, "conv_id long, part int, at long, ops string, ends boolean"), "chosen")
    letters = chosen.where("not ends").select("part", "at", F.posexplode(F.split("ops", " ")).alias("i", "ops")).select("part", (F.col("at") + F.col("i")).alias("at"), "ops")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))]
    names = [c.split()[0] for c in EDITED.split(", ")]
    return placed.join(letters, ["part", "at"]).select(*names).unionByName(chosen.where("ends").select("conv_id", "part", "at", *nothing, "ops"))


def edited(rows: DataFrame, large_bytes: int = LARGE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of `rows` (conv_id, turn, role, text, present) with its fault and edit letters (`ops`: inserts before it, then
    its own); a last row of each conversation holds the inserts at the end. Rows of a conversation stand in order in one partition."""
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("size"))
    large = sizes.where(F.col("size") > large_bytes).select(F.col("conv_id").alias("large_id"))
    if large.isEmpty():
        return edited_small(rows)
    marked = rows.join(large, rows.conv_id.eqNullSafe(large.large_id), "left_anti")
    cut = edited_large(rows.join(large, rows.conv_id.eqNullSafe(large.large_id), "left_semi"), block_bytes)
    # One that only has absent rows is not large by its text; its rows are few enough to be named once more here.
    named = rows.join(large, rows.conv_id.eqNullSafe(large.large_id), "left_semi").groupBy("conv_id").agg(F.max("present").alias("any")).where("not any")
    absent = named.select("conv_id", *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))), F.lit(False).alias("present"))
    return edited_small(marked.unionByName(absent)).unionByName(cut).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")


def mended(ops: str, q: int, role: str | None) -> tuple[list[str], bool, int]:
    """Roles that the letters of a row add in state q, whether its text stays, and the state after."""
    roles, stays = [], False
    for letter in ops:
        if letter == "D":
            continue
        if letter == "K":
            q = KEPT[role[:1]][q]
            roles.append(role)
        else:
            q = NEXT[q]
            roles.append("user" if q == USER else "assistant")
        stays = letter != "I"
    return roles, stays, q


def repaired(edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), role, text."""
    as_ = "conv_id long, place long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            q, place = START, 0
            for conv, role, text, ops in rows_in(batches):
                roles, stays, q = mended(ops, q, role)
                for i, new in enumerate(roles):
                    yield conv, place, new, text if stays and i == len(roles) - 1 else ""
                    place += 1
                if role is None:
                    q, place = START, 0

        yield from batches_of(out(), arrow(as_), 3)

    return edits.select("conv_id", "role", "text", "ops").mapInArrow(run, as_)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row for each conversation; rows are read once in order, nothing but the audit grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            fresh = lambda: ({"blank": 0, "duplicate": 0, "truncated": 0}, [], hashlib.sha256())
            faults, audit, digest = fresh()
            q = START
            turns = cost = illegal = started = 0
            least = most = previous = None
            for conv, turn, role, text, fault, ops in rows_in(batches):
                roles, stays, q = mended(ops, q, role)
                for i, new in enumerate(roles):
                    digest.update(f"{chr(10) * started}{new}:{text if stays and i == len(roles) - 1 else ''}".encode())
                    started = 1
                audit.append(ops)
                cost += INSERT * ops.count("I") + DELETE * ops.count("D") + REROLE * ops.count("R") + TRUNCATED * (fault == "truncated" and ops[-1] != "D")
                if role is not None:
                    if fault:
                        faults[fault] += 1
                    illegal += previous is not None and previous + role[:1] not in LEGAL
                    previous = role[:1]
                    if turn is not None:
                        turns += turn != most
                        least, most = turn if least is None else least, turn
                    continue
                gaps = 0 if least is None else most - least + 1 - turns
                yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()
                faults, audit, digest = fresh()
                q = START
                turns = cost = illegal = started = 0
                least = most = previous = None

        yield from batches_of(out(), arrow(REPORT), 7)

    return edits.select("conv_id", "turn", "role", "text", "fault", "ops").mapInArrow(run, REPORT)


def filled(conversations: DataFrame) -> DataFrame:
    """The columns that are read, with one space for null role and text, all rows present."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), F.lit(True).alias("present"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn`: of 20 kinds, 0 drops a row (it stays as an absent one), 1 empties its text,
    2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text: Column = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("copy")
    ).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(edited(damaged(filled(table(spark, sf_dir, "conversations")))))


ORACLE_SQL = r"""
with recursive crc as (
    select list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as codes
    from conversations
), kinds as (
    select conv_id, turn, role, text, xor(list_reduce([4294967295::bigint] || codes, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) % 20 as kind from keyed, crc
), damage as (
    select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case kind when 3 then [0, 1] else [0] end) as copy
    from kinds where kind <> 0
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from damage
), judged as (
    select *, left(role, 1) as r, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault
    from numbered
), totals as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, max(i) as n
    from judged group by conv_id
), pairs as (
    select conv_id, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from (select conv_id, lag(r) over (partition by conv_id order by i) || r as pair from judged) group by conv_id
), folded as (
    select conv_id, 0::bigint as i, {'c': 0::bigint, 'a': '', 'r': []::varchar[]} as s0, null::struct(c bigint, a varchar, r varchar[]) as s1, null::struct(c bigint, a varchar, r varchar[]) as s2, null::struct(c bigint, a varchar, r varchar[]) as s3
    from totals
    union all
    select conv_id, i,
        {'c': s0.c + 2, 'a': s0.a || 'D', 'r': s0.r},
        list_sort(list_filter([case when s1 is not null then {'c': s1.c + 2, 'a': s1.a || 'D', 'r': s1.r} end, case when free and r = 's' then {'c': s0.c + pen, 'a': s0.a || 'K', 'r': s0.r || [line]} end], lambda x: x is not null))[1],
        list_sort(list_filter([{'c': u.c + 2, 'a': u.a || 'D', 'r': u.r}]
            || list_transform(list_filter([s0, s1, a], lambda x: free and x is not null), lambda x: case when r = 'u' then {'c': x.c + pen, 'a': x.a || 'K', 'r': x.r || [line]} else {'c': x.c + pen + 1, 'a': x.a || 'R', 'r': x.r || ['user:' || text]} end), lambda x: x is not null))[1],
        list_sort(list_filter([{'c': a.c + 2, 'a': a.a || 'D', 'r': a.r}, case when free then case when r = 'a' then {'c': u.c + pen, 'a': u.a || 'K', 'r': u.r || [line]} else {'c': u.c + pen + 1, 'a': u.a || 'R', 'r': u.r || ['assistant:' || text]} end end], lambda x: x is not null))[1]
    from (
        select *, list_sort(list_filter([s3, {'c': u.c + 5, 'a': u.a || 'I', 'r': u.r || ['assistant:']}], lambda x: x is not null))[1] as a
        from (
            select f.conv_id, j.i, j.r, j.text, j.role || ':' || j.text as line, j.fault not in ('blank', 'duplicate') as free, case j.fault when 'truncated' then 5 else 0 end as pen, s0, s1, s3,
                list_sort(list_filter([s2] || list_transform(list_filter([s0, s1, s3], lambda x: x is not null), lambda x: {'c': x.c + 5, 'a': x.a || 'I', 'r': x.r || ['user:']}), lambda x: x is not null))[1] as u
            from folded f join judged j on j.conv_id is not distinct from f.conv_id and j.i = f.i + 1
        )
    )
), closed as (
    select conv_id, i, list_sort(list_filter([s0, s3, case when s2 is not null then {'c': s2.c + 5, 'a': s2.a || 'I', 'r': s2.r || ['assistant:']} end,
        case when s1 is not null then {'c': s1.c + 10, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']} end], lambda x: x is not null))[1] as best
    from folded
), ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0)::bigint as blank, coalesce(t.duplicate, 0)::bigint as duplicate, coalesce(t.truncated, 0)::bigint as truncated, coalesce(p.illegal, 0)::bigint as illegal,
    coalesce(c.best.c, 0)::bigint as cost, coalesce(c.best.a, '') as audit, sha256(coalesce(array_to_string(c.best.r, chr(10)), '')) as repaired_sha256
from ids left join totals t on t.conv_id is not distinct from ids.conv_id left join pairs p on p.conv_id is not distinct from ids.conv_id
left join closed c on c.conv_id is not distinct from ids.conv_id and c.i = t.n
"""
