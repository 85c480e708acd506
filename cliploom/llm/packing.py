"""Packing by power-of-two decomposition (operator 2).

A document's token ids (with the end id) are cut into pieces whose lengths are powers of two, `LIMIT` at most:
whole pieces of `LIMIT` first, then one piece for each binary digit of the rest. Pieces of equal length share a
bucket, in which they are numbered; a piece is a sequence of its own, so no sequence crosses documents and none
needs padding.

Null and empty texts give the end id alone. Repeated rows are packed each on its own. Sequence numbers run
without gaps, long pieces first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import SLICE_BYTES, slices, stash, table

LIMIT = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Distinct chunks whose ids a Python worker remembers.
REMEMBERED = 500_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts; a chunk between single spaces is encoded once and remembered.

    Byte-level pre-tokens never go on past a single space between two other characters: the space begins the
    next one. So a text cut before such spaces has the ids of its chunks in a row. Texts with other white space
    side by side, or with what may be a special token, are encoded as a whole. Chunks are encoded from the same
    vocabulary in its rank form, many at a time, which gives the same ids.
    """

    #: Texts that are not cut: white space side by side or at the ends, rare white space, special tokens.
    uneven = r"^[ \n]|[ \n]$|[ \n][ \n]|<\||[\t\v\f\r\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path.replace(".json", ".tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(x) for x in ranks]
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.codes, self.ids = {}, np.zeros(1 << 16, np.uint32)
        self.begins, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def numbers(self, dictionary: pa.Array) -> np.ndarray:
        """Codes of distinct chunks; new ones are encoded end to end, with the space before each.

        A chunk at a text's start has a newline there in place of the space, which makes a token of its own.
        """
        names = dictionary.to_pylist()
        codes = list(map(self.codes.get, names))
        if None in codes:
            new = np.array([x is None for x in codes])
            fresh = [x for x, code in zip(names, codes) if code is None]
            first = np.array([x[0] == "\n" for x in fresh])
            sizes = pc.binary_length(dictionary.filter(pa.array(new))).to_numpy() + ~first
            text = " ".join(fresh).replace(" \n", "\n")
            flat = np.array(self.ranked.encode_ordinary(text if first[0] else " " + text), np.uint32)
            ends = self.ends[-1] + np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(sizes)) + 1
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            self.ids[self.ends[-1] : ends[-1]] = flat
            self.begins = np.concatenate([self.begins, np.r_[self.ends[-1], ends[:-1]] + first])
            self.ends = np.concatenate([self.ends, ends])
            codes = list(map(self.codes.get, names))
        return np.array(codes, np.int64)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text, without the end id; none for null and empty ones."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, self.uneven), pc.equal(pc.binary_length(texts), 0))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        even = texts.filter(pc.invert(odd))
        out: list[np.ndarray] = []
        if len(even):
            parts = pc.split_pattern(pc.binary_join_element_wise("\n", even, ""), " ")
            coded = parts.values.dictionary_encode()
            codes = self.numbers(coded.dictionary)
            begin = self.begins[codes]
            at = coded.indices.to_numpy(zero_copy_only=False)
            begin, n = begin[at], (self.ends[codes + 1] - begin)[at]
            ends = np.cumsum(n)
            ids = self.ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])]
            bounds = np.r_[0, ends][parts.offsets.to_numpy()]
            out = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        whole = self.whole([texts[int(i)].as_py() for i in odd_at])
        every, rest = dict(zip(odd_at.tolist(), whole)), iter(out)
        return [every[i] if i in every else next(rest) for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """`n` as a sum of powers of two, `limit` at most, largest first."""
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1) if n % limit >> k & 1]


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of `docs` (doc_id, text), with their ids as little-endian unsigned 32-bit numbers."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in slices(pc.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                rows = []
                for key, ids in zip(keys[i:j], encode(texts.slice(i, j - i))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(ids), limit):
                        rows.append((key, start, length, len(ids), ids[start : start + length].tobytes()))
                        start += length
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def number(found: DataFrame) -> DataFrame:
    """Number the pieces bucket by bucket, without gaps; adds sequence_id and offset (0: a piece fills its sequence).

    Each bucket is dealt out to cells by a hash, rows are numbered in their cell, and the cells' counts (a few
    for each bucket) give where each cell's numbers begin.
    """
    found = stash(found, "pieces")
    cells = max(32, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.withColumn("cell_no", F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells)).cast("int"))
    counts = found.groupBy("length", "cell_no").agg(F.count("*").alias("cell_rows"))
    order = Window.orderBy(F.desc("length"), "cell_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("cell_rows").over(order), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("length", "cell_no").orderBy("doc_id", "start"))
    return (
        found.withColumn("in_cell", inside)
        .join(counts.select("length", "cell_no", "before"), ["length", "cell_no"])
        .withColumn("sequence_id", F.col("before") + F.col("in_cell") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("before", "in_cell", "cell_no")
    )


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece: its document and place there, its ids, its sequence."""
    return number(pieces(docs, path))


def digest(docs: DataFrame) -> DataFrame:
    found = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(docs)
