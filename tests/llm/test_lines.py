"""Line dedup against plain versions."""

from collections import defaultdict

import numpy as np

from cliploom.llm import lines


def edit_distance(s, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(s):
        row, old = [i + 1], row
        for j, d in enumerate(t):
            row.append(min(old[j] + (c != d), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_banded_edit_distance():
    make = np.random.default_rng(3)
    for _ in range(600):
        s = "".join(make.choice(list("ab"), int(make.integers(0, 9))))
        t = "".join(make.choice(list("ab"), int(make.integers(0, 9))))
        for edits in (0, 1, 2):
            assert lines.within(s, t, edits) == (edit_distance(s, t) <= edits), (s, t)


def test_segments_meet():
    make = np.random.default_rng(6)
    for k in range(400):
        size = int(make.integers(20, 45))
        s = list("".join(make.choice(list("abc"), size)))
        t = list(s)
        for _ in range(int(make.integers(1, lines.budget(size) + 1))):
            at, kind = int(make.integers(0, len(t))), int(make.integers(0, 3))
            t[at : at + (kind != 0)] = [] if kind == 2 else ["é"]
        s, t = sorted(("".join(s), "".join(t)), key=len)
        if edit_distance(s, t) > lines.budget(len(s)):
            continue
        owner, keys, sketch = lines.keys(["x", s, "y" * 30, t])
        named = {i: {int(k) >> 1 for k in keys[owner == i]} for i in range(4)}
        own = {int(k) >> 1 for k in keys[owner == 1] if k & 1}
        assert len(own) <= lines.budget(len(s)) + 1 and own & named[3]
        assert not named[0]
        assert bin((int(sketch[1]) ^ int(sketch[3])) & (2**64 - 1)).count("1") <= 2 * edit_distance(s, t)


def plain_drops(docs):
    """(doc_id, text) -> line numbers that go; docs are rows of (doc_id, text)."""
    docs = sorted(set(docs), key=str)
    places = [(d, t, n, x.strip(lines.SPACE)) for d, t in docs if t for n, x in enumerate(t.split("\n")) if x.strip(lines.SPACE)]
    different = sorted({p[3] for p in places})
    root = {x: x for x in different}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in different:
        for b in different:
            if a < b and edit_distance(a, b) <= lines.budget(min(len(a), len(b))):
                root[find(a)] = find(b)
    return places, {x: find(x) for x in different}


def check(spark, docs):
    """The operator's result for `docs` is that of the plain version, up to which of two texts under one id comes first."""
    places, root = plain_drops(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    keyed = {(r.doc_id, r.text): r.text_key for r in lines.keyed(frame).collect()}
    low = lambda p: (p[0] is not None, p[0] or 0, keyed[p[0], p[1]], p[2])
    first, size = {}, defaultdict(int)
    for p in places:
        first[root[p[3]]] = min(first.get(root[p[3]], low(p)), low(p))
        size[root[p[3]]] += docs.count((p[0], p[1]))
    gone, linked = defaultdict(list), defaultdict(int)
    for p in places:
        if low(p) != first[root[p[3]]]:
            gone[p[0], p[1]].append(p[2])
        linked[p[0], p[1]] += size[root[p[3]]] - 1
    found = {(r.doc_id, r.text_key): r for r in lines.drops(frame).collect()}
    for d, t in set(docs):
        r = found.get((d, keyed[d, t]))
        assert (list(r.gone) if r else []) == gone[d, t], (d, t)
        assert (r.n_linked if r else 0) == linked[d, t]
    kept = sorted(((r.doc_id, r.text) for r in lines.stage(spark, frame, "").collect()), key=str)
    cut = lambda d, t: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d, t])
    assert kept == sorted(((d, cut(d, t)) for d, t in docs), key=str)
    return gone


def test_lines(spark):
    make = np.random.default_rng(7)
    sizes = [5, 8, 12, 19, 20, 21, 30, 39, 40, 41, 60, 60]
    base = ["".join(make.choice(list("abcdefgh "), sizes[i % 12])).strip() for i in range(36)]
    docs = []
    for i in range(50):
        mine = []
        for _ in range(5):
            line = list(base[int(make.integers(0, 36))])
            for _ in range(int(make.integers(0, 4))):
                at, kind = int(make.integers(0, len(line))), int(make.integers(0, 3))
                line[at : at + (kind != 0)] = [] if kind == 2 else ["x"]
            mine.append("".join(line))
        docs.append((i, "\n".join([*mine, " short\t", "", " "])))
    docs += [(60, None), (61, ""), (62, "\n\n")]
    assert sum(map(len, check(spark, docs).values())) > 40


def test_a_large_group_of_near_copies(spark):
    """Lines of one origin with a word of their own, some of which are near each other, and one line that all share."""
    make = np.random.default_rng(8)
    head, tail = "this is how all of these lines begin and go on with ", " until they end in the same few words"
    docs = []
    for i in range(70):
        word = "".join(make.choice(list("abcd"), int(make.integers(1, 5))))
        docs.append((i, f"{head}{word}{tail}\none line that is the same everywhere"))
    docs += [(100 + i, f"{head}{''.join(make.choice(list('efghijklm'), 9))}{tail}") for i in range(30)]
    check(spark, docs)


def test_ids_that_do_not_tell_rows_apart(spark):
    a, b = "a line that is shared by several documents", "another line that is shared by several documents"
    docs = [(None, f"{a}\nx1"), (None, f"{a}\nx2"), (5, f"{b}\ny1"), (5, f"{b}\ny2"), (5, f"{b}\ny2"), (7, f"z\n{a}\n{a}\n{b}"), (8, None), (None, None)]
    gone = check(spark, docs)
    assert sum(len(g) for (d, _), g in gone.items() if d is None) == 1
    assert sum(len(g) for (d, _), g in gone.items() if d == 5) == 1


def test_extra_columns(spark):
    names = ["gone", "whole", "first_ids", "n_linked", "text_key", "mine", "n_chars", "short", "root"]
    line = "one line of text that both documents hold"
    docs = spark.createDataFrame([(1, f"{line}\nx", *range(9)), (2, f"{line}\ny", *range(9)), (3, None, *[None] * 9)], f"doc_id long, text string, {', '.join(f'{n} long' for n in names)}")
    got = {r.doc_id: r for r in lines.stage(spark, docs, "").collect()}
    assert got[1].text == f"{line}\nx" and got[2].text == "y" and got[2].n_chars == 1 and got[2].gone == 0 and got[3].text is None
    assert lines.stage(spark, docs, "").columns == docs.columns
    assert lines.stage(spark, docs.limit(0), "").count() == 0
