"""Lexicons of any size as tables: word phrases by a hash join of n-grams, substrings by automata.

A short list (up to `FEW` terms) is one expression for each term inside the JVM. A longer one stays a table. Phrases of words meet
the texts' n-grams of the same lengths in an equi-join. Terms that may begin inside a word go into Aho-Corasick
automata of at most `AUTOMATON_BYTES` of terms each, sent to executors one by one, each read by every text in Arrow
batches; a plan grows by one pass for each `AUTOMATON_BYTES`, never with the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

FEW = 64
AUTOMATON_BYTES = 16 << 20
WORD = r"[\p{L}0-9']+"


def few(terms: DataFrame) -> list | None:
    """The rows of a short table, or None; never more than `FEW` + 1 are fetched."""
    rows = terms.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def ngrams_of(ws: Column, n: Column) -> Column:
    """The distinct n-grams of an array of words, joined by one space."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def phrase_hits(docs: DataFrame, terms: DataFrame, key: str, text: str = "text", form: str = "form") -> DataFrame:
    """(key, columns of `terms`) where the words of `form` (lower case, one space between) stand side by side among the text's words.

    A text gives its n-grams once for each length that the terms have (few; the lengths are one small array). A null form is nowhere.
    """
    wanted = terms.where(F.col(form).isNotNull()).withColumn("_n", F.size(F.split(form, " ", -1)))
    lengths = sorted(r["_n"] for r in wanted.select("_n").distinct().collect())
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    rows = docs.select(F.col(key).alias("_key"), ws.alias("_ws"))
    grams = F.flatten(F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: ngrams_of(F.col("_ws"), n)))
    listed = rows.select("_key", F.explode(F.array_distinct(grams)).alias("_gram"))
    return listed.join(wanted, F.col("_gram") == F.col(form)).select(F.col("_key").alias(key), *terms.columns)


def substring_hits(docs: DataFrame, terms: DataFrame, key: str, text: str = "text", form: str = "term", automaton_bytes: int | None = None) -> DataFrame:
    """(key, columns of `terms`) where `form` stands anywhere in the lower-case text. An empty or null form is nowhere."""
    spark, limit = docs.sparkSession, automaton_bytes or AUTOMATON_BYTES
    forms = terms.select(F.col(form).alias("_f")).where("_f != ''").distinct()
    size = forms.agg(F.sum(F.octet_length("_f"))).first()[0] or 0
    shards = max(1, -(-size // limit))
    forms = forms.withColumn("_shard", F.pmod(F.xxhash64("_f"), F.lit(shards)))
    rows = docs.select(F.col(key).alias("_key"), F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    schema = to_arrow_schema(spark.createDataFrame([], f"_key {docs.schema[key].dataType.simpleString()}, _form string").schema)
    found = None
    for shard in range(shards):
        sent = spark.sparkContext.broadcast([r["_f"] for r in forms.where(F.col("_shard") == shard).select("_f").collect()])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in sent.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                keys, hits = [], []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen = {term for _, term in automaton.iter(text)} if len(automaton) else ()
                    keys += [k] * len(seen)
                    hits += seen
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema.types[0]), pa.array(hits, pa.string())], schema=schema)

        part = rows.mapInArrow(search, f"_key {docs.schema[key].dataType.simpleString()}, _form string")
        found = part if found is None else found.unionByName(part)
    return found.join(terms, F.col("_form") == F.col(form)).select(F.col("_key").alias(key), *terms.columns)
