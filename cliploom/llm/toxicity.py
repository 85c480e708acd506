"""Toxicity by nearest labelled examples (operator 12).

A text is scored by the `NEIGHBOURS` labelled examples with the highest TF-IDF cosine. Near ones weigh more in the
vote, and the share of the vote is turned into a probability by an isotonic curve that was fitted on the examples
themselves, each held against the others. The neighbours are the evidence. Each term's weight holds how far it tells the labels
apart (the log of its odds ratio), so a few telling words decide in a long text, not the common words beside them.

Search is exact. Each term's postings are cut at blocks of `BLOCK` examples and hold the highest weight of each block; the
sum of these is a bound on the cosine of all examples of a block. Blocks are read from the highest bound down until no
bound exceeds the last neighbour's cosine. Examples that share their heaviest term stand side by side, so bounds are tight.

What is bounded: the examples (about `EXAMPLES` of the labelled documents, by a hash of their id) and the terms
(`TERMS`, those that tell the labels apart best by the G statistic, down to where chance alone gives `CHANCE_TERMS`). The index
of both is the fitted classifier, the only thing sent to executors. Document frequencies are counted over all documents, and every text is scored whole.
Labels, language, source and id are no input of a score.

Null text counts as empty. A text without a known term gets the share of toxic ones among the examples without one.
Of rows with one id, one (least by a hash of the text) is an example, if a label is there; a label that is there twice
counts as toxic if one is. Rows with null toxic or null id teach nothing; a null id is held out. Every row is scored on
its own. Without examples every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import sizes_of, slices, stash, table

#: Bounds of the fitted classifier.
EXAMPLES = 20_000
TERMS = 5_000
#: Terms are taken down to where chance alone gives about so many of those tested.
CHANCE_TERMS = 5
#: Fewest examples that hold a term.
LEAST_EXAMPLES = 3
#: A term's log odds ratio counts as so much at least, so that every known term has a weight.
LEAST_ODDS = 0.01
#: Terms are words and their first letters (as "abcd*"), so that compounds and inflected forms meet.
PREFIXES = (4, 5)
FOLDS = 5
NEIGHBOURS = 15
#: Documents that one task scores.
ROWS_A_TASK = 10_000
BLOCK = 128
#: Blocks read before the bound is looked at again; four times as many each further time.
FIRST_BLOCKS = 4
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(text: str | None) -> set[str]:
    """Words, and the first letters of longer words."""
    words = set(words_of(text))
    return words.union(w[:k] + "*" for w in words for k in PREFIXES if len(w) > k)


def examples_of(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> DataFrame:
    """One row (doc_id, toxic, text) for each of about `bound` labelled ids that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("examples")), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    one = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("key").alias("key"))
    chosen = F.broadcast(one.join(known, "doc_id"))
    return texts.join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")


def term_counts(examples: DataFrame) -> DataFrame:
    """term, toxic, n: examples of each label that hold the term; summed for each batch before it moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                counts.update(zip(terms_of(text), repeat(toxic)))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"]
            )

    return examples.select("toxic", "text").mapInArrow(count, "term string, toxic int, n long")


def vocabulary(examples: DataFrame, bound: int = TERMS) -> tuple[list[str], np.ndarray]:
    """Terms by falling G statistic of term against label (natively computed; the list is bounded), and the size of each one's log odds ratio."""
    sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not bad or not good:
        return [], np.zeros(0)
    total = bad + good
    a, b = F.col("a"), F.col("b")

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    held, without = a + b, total - a - b
    g = 2 * (part(a, held, F.lit(bad)) + part(b, held, F.lit(good)) + part(bad - a, without, F.lit(bad)) + part(good - b, without, F.lit(good)))
    per_term = term_counts(examples).groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("b"))
    scored = per_term.select("term", F.coalesce(a, F.lit(0)).cast("double").alias("a"), F.coalesce(b, F.lit(0)).cast("double").alias("b"))
    odds = F.abs(F.log((a + 0.5) * (good - b + 0.5) / ((b + 0.5) * (bad - a + 0.5))))
    tested = stash(scored.where(held >= LEAST_EXAMPLES).select("term", F.round(g, 6).alias("g"), F.greatest(odds, F.lit(LEAST_ODDS)).alias("odds")), "tested")
    best = tested.where("g > 0").orderBy(F.desc("g"), "term").limit(bound).collect()
    least = 2 * math.log(1 + tested.count() / CHANCE_TERMS)
    best = [r for r in best if r.g >= least]
    return [r.term for r in best], np.array([r.odds for r in best])


def vectors(docs: DataFrame, terms: list[str], carried: str = "doc_id long") -> DataFrame:
    """Counts of the known terms in each text: `carried` columns, at array<int>, n array<int>; whole texts, no shuffle."""
    names = [c.split()[0] for c in carried.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {t: i for i, t in enumerate(terms)}
        starts = [(k, {t[:-1]: i for t, i in words.items() if t.endswith("*") and len(t) == k + 1}) for k in PREFIXES]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in slices(sizes_of(texts)):
                at, n = [], []
                for text in texts[low:high]:
                    found: Counter = Counter()
                    for word, times in Counter(words_of(text)).items():
                        if word in words:
                            found[words[word]] += times
                        for k, known in starts:
                            if len(word) > k and word[:k] in known:
                                found[known[word[:k]]] += times
                    at.append(sorted(found))
                    n.append([found[t] for t in at[-1]])
                kept = [batch.column(c)[low:high] for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=[*names, "at", "n"])

    return docs.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in carried.split(", ")], "text").mapInArrow(count, f"{carried}, at array<int>, n array<int>")


def document_frequencies(counted: DataFrame, size: int) -> DataFrame:
    """t, n: texts of each batch that hold term t. A task gives at most `size` rows a batch, however many terms its texts hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(batch.column("at").flatten().to_numpy(zero_copy_only=False), minlength=size)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], names=["t", "n"])

    return counted.select("at").mapInArrow(count, "t int, n long")


def idf_of(counted: DataFrame, size: int, total: int) -> np.ndarray:
    """Inverse document frequency of each known term, over all `total` documents."""
    df = np.zeros(size)
    for r in document_frequencies(counted, size).groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r.t] = r.n
    return np.log((1 + total) / (1 + df)) + 1


def weights(at: list[int], n: list[int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length; `idf` may hold another factor of each term."""
    w = (1 + np.log(np.asarray(n, float))) * idf[at]
    return w / np.sqrt((w * w).sum())


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges low[i] to high[i] - 1, one after the other."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Postings of unit vectors, cut at blocks of examples, with each block's highest weight."""

    def __init__(self, ids: list[int], toxic: list[int], at: list[list[int]], n: list[list[int]], idf: np.ndarray, block: int = BLOCK):
        rows = [(ids[i], toxic[i], at[i], weights(at[i], n[i], idf)) for i in range(len(ids)) if at[i]]
        rows.sort(key=lambda r: (r[2][int(np.argmax(r[3]))], r[2], r[0]))
        self.block, self.idf = block, idf
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.toxic = np.array([r[1] for r in rows], np.int8)
        self.blocks = -(-len(rows) // block)
        term = np.concatenate([np.asarray(r[2], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.example = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        self.weight = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0)
        order = np.lexsort((self.example, term))
        term, self.example, self.weight = term[order], self.example[order], self.weight[order]
        piece = term * max(self.blocks, 1) + self.example // block
        self.piece_start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
        self.piece_end = np.r_[self.piece_start[1:], len(piece)].astype(np.int64)
        self.piece_max = np.maximum.reduceat(self.weight, self.piece_start) if len(piece) else np.zeros(0)
        self.piece_block = self.example[self.piece_start] // block
        self.first_piece = np.searchsorted(term[self.piece_start], np.arange(len(idf) + 1))

    def search(self, at: list[int], n: list[int], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int]]:
        """The k best (cosine, example) with a cosine above 0, highest first, then by place; `without` leaves an id out."""
        query = weights(at, n, self.idf)
        low, high = self.first_piece[at], self.first_piece[np.asarray(at) + 1]
        pieces, q = ranges(low, high), np.repeat(query, high - low)
        block = self.piece_block[pieces]
        bound = np.bincount(block, q * self.piece_max[pieces], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best_cosine, best = np.zeros(0), np.zeros(0, np.int64)
        done, step = 0, FIRST_BLOCKS
        while done < len(order):
            least = max(best_cosine[-1], 1e-9) if len(best) == k else 1e-9
            take = order[done : done + step]
            take = take[bound[take] >= least - 1e-9]
            if not len(take):
                break
            rank = np.full(self.blocks, -1)
            rank[take] = np.arange(len(take))
            chosen = rank[block] >= 0
            s, e = self.piece_start[pieces[chosen]], self.piece_end[pieces[chosen]]
            spots = ranges(s, e)
            place = np.repeat(rank[block[chosen]] * self.block, e - s) + self.example[spots] % self.block
            cosine = np.round(np.bincount(place, np.repeat(q[chosen], e - s) * self.weight[spots], len(take) * self.block), 9)
            near = np.flatnonzero(cosine >= least)
            example, cosine = take[near // self.block] * self.block + near % self.block, cosine[near]
            if without is not None:
                example, cosine = example[kept := self.ids[example] != without], cosine[kept]
            best_cosine, best = np.r_[best_cosine, cosine], np.r_[best, example]
            first = np.lexsort((best, -best_cosine))[:k]
            best_cosine, best = best_cosine[first], best[first]
            done, step = done + step, 4 * step
        return list(zip(best_cosine.tolist(), best.tolist()))

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours, each weighed by the inverse of its distance."""
        w = np.array([1 / (0.05 + np.sqrt(max(0.0, 2 - 2 * s))) for s, _ in found])
        return float((w * self.toxic[[e for _, e in found]]).sum() / w.sum())


def isotonic(votes: np.ndarray, labels: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through (vote, share of label 1): pools neighbours that fall; a vote of either label is added at the ends.

    Equal votes are summed first: a few clean ones at a vote of toxic ones must not join the pool below before these are counted.
    """
    x, place = np.unique(np.r_[0.0, votes, 1.0], return_inverse=True)
    y = np.bincount(place, np.r_[0.0, labels * times, 1.0])
    pools: list[list[float]] = []
    for at, value, n in zip(x, y, np.bincount(place, np.r_[1, times, 1])):
        pools.append([value, float(n), at, at])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    return np.array([c for p in pools for c in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


class Model:
    """The fitted classifier: index, curve, and the score of texts without a known term."""

    def __init__(self, terms: list[str], index: BlockMaxIndex, curve: tuple[np.ndarray, np.ndarray], empty: float):
        self.terms, self.index, self.curve, self.empty = terms, index, curve, empty

    def score(self, at: list[int], n: list[int]) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.search(at, n) if at and self.index.blocks else []
        if not found:
            return self.empty, []
        return float(np.interp(self.index.vote(found), *self.curve)), found


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The classifier and the counted terms of all documents (doc_id, at, n), written to the shared folder."""
    examples = stash(examples_of(docs, labels), "examples")
    terms, odds = vocabulary(examples)
    counted = stash(vectors(docs, terms), "terms")
    total = counted.count()
    idf = idf_of(counted, len(terms), total) * odds
    # The counts are small beside the time that a search takes, so they are dealt out by rows, not by bytes.
    counted = counted.repartition(max(spark.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK)))
    known = stash(vectors(examples, terms, "doc_id long, toxic int"), "known")
    rows = sorted(known.collect(), key=lambda r: r.doc_id)
    index = BlockMaxIndex([r.doc_id for r in rows], [r.toxic for r in rows], [r.at for r in rows], [r.n for r in rows], idf)
    empty = [r.toxic for r in rows if not r.at]
    share = sum(empty) / (len(empty) + 1)
    sent = spark.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(sent.value.search(r["at"], r["n"], without=r["doc_id"]), r["toxic"]) for r in batch.to_pylist() if r["at"]]
            kept = [(sent.value.vote(f), y) for f, y in found if f]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in kept], pa.float64()), pa.array([y for _, y in kept], pa.int32())], names=["vote", "toxic"])

    seen = known.mapInArrow(votes, "vote double, toxic int").groupBy("vote", "toxic").agg(F.count("*").alias("n")).collect()
    seen.sort()
    curve = isotonic(*(np.array([r[i] for r in seen]) for i in range(3)))
    return Model(terms, index, curve, share), counted


def score(spark: SparkSession, counted: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (neighbours with id, cosine and label, nearest first) for each row of counted terms; no shuffle."""
    sent = spark.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, shown, known = [], [], {}
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                key = (*at, *n)
                if key not in known:
                    known[key] = model.score(at, n)
                value, found = known[key]
                scores.append(value)
                shown.append([{"doc_id": int(model.index.ids[e]), "cosine": s, "toxic": int(model.index.toxic[e])} for s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(shown, evidence)], names=["doc_id", "score", "evidence"])

    return counted.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counted = fit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    done = score(spark, counted, model)
    nearest = F.transform(F.slice("evidence", 1, 3), lambda e: e["doc_id"])
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), nearest.alias("nearest"))
