"""The corpus pipeline: rows of `documents` that pass quality rules, line, near-duplicate and benchmark checks, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import common, lines, minhash, packing, quality, templates

STAGES = [
    ("quality", quality.stage),
    ("line dedup", lines.stage),
    ("near dedup", minhash.stage),
    ("benchmark decontamination", templates.stage),
    ("packing", packing.stage),
]

#: SQL cannot express suffix arrays, signatures or tokenizers; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each reads what the one before it wrote."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stash(docs, name.replace(" ", "-"))
    return docs
