"""Secret scans by character Markov models (operator 8).

Fixed patterns find assignments, access keys and long hex runs. Beyond these, two first-order character models
are compared: one of random strings (keys over usual alphabets, letters alone among them), one of ordinary
identifiers. Every token of 12 characters or more is scored, whatever it is made of; one whose log-likelihood ratio is
high, in all and for each character, is a secret ("markov" spans).

The models are fitted on a labelled sample of bounded size: `SAMPLE` random strings, made from a fixed seed, and
`SAMPLE` words and joined identifiers from the `SAMPLE_DOCS` documents that are first by a hash of their id.
Every text is scored as a whole. Null text counts as empty. Repeated rows are scored each on its own.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import table

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

#: Tokens; "=" separates them, but for the padding at the end of a key.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
SAMPLE = 20_000
SAMPLE_DOCS = 2_000
#: A token is a secret from this ratio on: in all, and for each character (natural logarithms).
LEAST_TOTAL = 12.0
LEAST_EACH = 0.6
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Alphabets of keys.
ALPHABETS = (
    "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/",
    string.ascii_letters, string.ascii_lowercase + string.digits,
)


def random_strings(n: int = SAMPLE, seed: int = 8) -> list[str]:
    """Labelled examples of secrets: keys over usual alphabets, of usual lengths."""
    make = random.Random(seed)
    return ["".join(make.choices(ALPHABETS[i % len(ALPHABETS)], k=make.randint(12, 64))) for i in range(n)]


def identifiers(words: list[str], n: int = SAMPLE, seed: int = 9) -> list[str]:
    """Labelled examples of ordinary strings: words, and words joined as in names, paths and versions."""
    make = random.Random(seed)
    words = sorted({w for w in words if re.fullmatch(r"[A-Za-z]+", w)}) or ["name", "value", "index", "file", "count", "user"]
    joins = (
        lambda a: "_".join(a), lambda a: "-".join(a), lambda a: "".join(x.capitalize() for x in a), lambda a: "/".join(a),
        lambda a: "_".join(a).upper(), lambda a: f"{'-'.join(a)}-{make.randint(0, 2030)}", lambda a: "".join(a),
    )
    return [joins[i % len(joins)](make.choices(words, k=make.randint(1, 5))) for i in range(n)]


def transitions(texts: list[str]) -> np.ndarray:
    """Log-probabilities of each character after each other (add-one); the last row and column stand for the rest."""
    code = {c: i for i, c in enumerate(ALPHABET)}
    size = len(ALPHABET) + 1
    counts = np.ones((size, size))
    for t in texts:
        at = [code.get(c, size - 1) for c in t]
        np.add.at(counts, (at[:-1], at[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def fit(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters; a table of fixed size."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    words = (
        docs.join(F.broadcast(ids), "doc_id", "left_semi")
        .select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,30}"), 0))).alias("w"))
        .distinct()
        .orderBy(F.xxhash64("w"), "w")
        .limit(SAMPLE)
    )
    return transitions(random_strings()) - transitions(identifiers([r.w for r in words.collect()]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(token: str, ratio: np.ndarray, code: dict[str, int]) -> bool:
    """Whether the model of random strings explains the token better."""
    at = [code[c] for c in token]
    total = float(ratio[at[:-1], at[1:]].sum())
    return total >= LEAST_TOTAL and total >= LEAST_EACH * (len(token) - 1)


def more_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray, code: dict[str, int]) -> list[tuple[int, int, int]]:
    """Spans of random tokens that overlap no base span, in one sweep over both."""
    found, k, end = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            end = max(end, base[k][2])
            k += 1
        if end <= m.start() and is_random(m[0], ratio, code):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Spans in each row of `docs` (doc_id, text); no shuffle. `ratio` is the fitted table (68 by 68 numbers)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {c: i for i, c in enumerate(ALPHABET)}
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                extra = more_spans(text, base, ratio, code)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, joined(sorted(base + extra)), len(extra)))
            columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], k) for k in (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *columns],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return docs.select("doc_id", "text").mapInArrow(found, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
