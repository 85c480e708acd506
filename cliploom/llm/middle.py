"""Fill-in-middle transformation (operator 11).

A text is cut at two of its line ends into prefix, middle and suffix, which change places behind markers, so that a
model learns to fill the middle. The cuts are drawn by a hash of seed and document id and are ranks among the lines.
An indexable skip list of the lines finds them: each link of a lane carries how many lines and how many code points
it passes; from the top lane down, links are followed while their lines still fit, which ends exactly at the rank with
the code points before it. Lanes are built from the lane below, `FAN` links to one, so a text of n lines has
log n lanes and a cut costs log n steps. Lines are found in slices, so nothing larger than the text itself is held.

Null text counts as empty. Empty texts, and texts that hold a marker, stay as they are ("plain"). A null id is hashed
as an empty one. Repeated rows are treated each on its own. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import SLICE_BYTES, sizes_of, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT_RATE = 100
SUFFIX_FIRST_RATE = 50
#: Links of a lane that one link of the lane above passes.
FAN = 16


def line_widths(text: str, step: int = SLICE_BYTES) -> np.ndarray:
    """Code points of each line, its line end included."""
    ends = [np.zeros(1, np.int64)]
    for at in range(0, len(text), step):
        codes = np.frombuffer(text[at : at + step].encode("utf-32-le"), np.uint32)
        ends.append(np.flatnonzero(codes == 10) + at + 1)
    ends = np.concatenate(ends)
    return np.diff(ends if ends[-1] == len(text) else np.append(ends, len(text)))


class SkipList:
    """Lines with their code points, reached by rank."""

    def __init__(self, widths: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.lanes = [(np.ones(len(widths), np.int64), widths)]
        while len(self.lanes[-1][0]) > fan:
            units, points = self.lanes[-1]
            heads = np.arange(0, len(units), fan)
            self.lanes.append((np.add.reduceat(units, heads), np.add.reduceat(points, heads)))

    def before(self, rank: int) -> int:
        """Code points of the first `rank` lines."""
        at = passed = 0
        for units, points in reversed(self.lanes):
            at *= self.fan
            while at < len(units) and units[at] <= rank:
                rank -= int(units[at])
                passed += int(points[at])
                at += 1
        return passed


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 that depend on seed and id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4)]


def transformed(doc_id: int | None, text: str, seed: int, cut_rate: int, suffix_first_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle, and the text in its new order."""
    lines = SkipList(line_widths(text))
    n = len(lines.lanes[0][0])
    a, b, cut, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or cut % 100 >= cut_rate:
        return n, "plain", None, None, text
    low, high = sorted((lines.before(a % (n + 1)), lines.before(b % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if order % 100 < suffix_first_rate:
        return n, "spm", low, high - low, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", low, high - low, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_rate: int = CUT_RATE, suffix_first_rate: int = SUFFIX_FIRST_RATE) -> DataFrame:
    """Each row of `docs` (doc_id, text) with its lines, form, lengths and `output`; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for low, high in slices(sizes_of(texts)):
                rows = [transformed(ids[i], texts[i] or "", seed, cut_rate, suffix_first_rate) for i in range(low, high)]
                n, form, prefix, middle, output = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high], pa.int64()), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which `output` was made. A cut text holds each marker once, so its parts lie between them."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
with texts as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
), lines as (
    select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, [('0x' || h[8 * i + 1 : 8 * i + 8])::bigint for i in range(4)] as h from texts
), ranks as (
    select *, len(u)::bigint as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as low, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as high,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain'
            when h[4] % 100 < 50 then 'spm' else 'psm' end as form
    from lines
), parts as (
    select *, array_to_string(u[1:low], '') as p, array_to_string(u[low + 1:high], '') as m, array_to_string(u[high + 1:], '') as s from ranks
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""
