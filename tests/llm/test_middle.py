"""Fill-in-middle against plain slicing of lines, and exact round trips."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from cliploom.llm import middle


def test_ranks_of_the_skip_list():
    make = random.Random(1)
    for n in (0, 1, 2, 15, 16, 17, 255, 256, 257, 5000):
        widths = np.array([make.randint(1, 90) for _ in range(n)], np.int64)
        lines = middle.SkipList(widths)
        assert [lines.before(k) for k in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
    assert len(middle.SkipList(np.ones(5000, np.int64)).lanes) == 4


def test_lines_in_slices():
    make = random.Random(2)
    for _ in range(200):
        text = "".join(make.choice("ab\n\U0001f600é\r\x85") for _ in range(make.randint(0, 60)))
        assert middle.line_widths(text, 7).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


def plain(doc_id, text, cut=100, first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut:
        return len(lines), "plain", None, None, text
    low, high = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = ("".join(lines[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    spm = h[3] % 100 < first
    return len(lines), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_texts_equal_plain_slicing_and_come_back(spark):
    make = random.Random(4)
    texts = [None, "", "\n", "a", "a\n", "x <M> y\nz", "<P", "ä\n\n\U0001f600", "w " * 300_000 + "\n", "same\nsame\n", "same\nsame\n"]
    texts += ["".join(make.choice(["word ", "\n", "é", "<", "S>", "\r\n"]) for _ in range(make.randint(1, 80))) for _ in range(60)]
    rows = [(t, "x", i if i != 3 else None, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text string, output string, doc_id int, n int")
    for cut, first in ((100, 50), (40, 0), (100, 100)):
        done = middle.fill_in_middle(docs, cut_rate=cut, suffix_first_rate=first).withColumn("back", middle.restored(F.col("output"), F.col("form")))
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect()), key=str)
        want = sorted(((i, *plain(i, t, cut, first), t or "") for t, _, i, _ in rows), key=str)
        assert got == want
    assert middle.fill_in_middle(docs.limit(0)).count() == 0
