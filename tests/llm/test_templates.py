"""Template leaks against a plain version."""

from collections import defaultdict

import regex

from cliploom.llm import templates
from cliploom.llm.common import table

SF = "/root/testdata/sf0.01"


def words_of(text):
    """(own words, template words) by a loop over words."""
    own, out, units = [], [], set(templates.UNITS.split())
    for w in regex.split(r"[ \t\n\x0b\f\r]+", (text or "").replace("#", " ")):
        if not regex.search(r"[\p{L}0-9]", w):
            continue
        own.append(w)
        if regex.search("[0-9]", w):
            out.append("#num")
        elif out and out[-1] == "#num" and regex.sub(r"[.,;:!?)]+$", "", w).lower() in units:
            out.append("#unit")
        elif regex.match(r"[^\p{L}]*\p{Lu}", w):
            out.append("#name")
        else:
            out.append(regex.sub(r"[^\p{L}]+", "", w).lower())
    return own, out


def plain_leaks(docs, items):
    width, found = templates.WIDTH, set()
    index = defaultdict(set)
    known = {}

    def window(own, words, i, n):
        part = tuple(words[i : i + n])
        return (n, part) if sum(w[0] != "#" for w in part) >= min(templates.LEAST_PLAIN, n) else (n, "own", tuple(own[i : i + n]))

    for k, (item_id, text) in enumerate(items):
        own, words = known[k] = words_of(text)
        n = min(len(words), width)
        for i in range(len(words) - n + 1) if n else ():
            index[window(own, words, i, n)].add((k, i))
    sizes = {w[0] for w in index}
    bare = lambda w: regex.sub(r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "", w)
    for doc_id, text in docs:
        own, words = words_of(text)
        met = {(k, i - at) for n in sizes for i in range(len(words) - n + 1) for k, at in index.get(window(own, words, i, n), ())}
        for k, shift in met:
            theirs, item = known[k]
            same = [0 <= i + shift < len(words) and words[i + shift] == w for i, w in enumerate(item)]
            if len(item) >= width:
                runs = [i for i in range(len(item) - width + 1) if all(same[i : i + width])]
                agree = sorted({j for i in runs for j in range(i, i + width)})
            else:
                agree = [i for i, x in enumerate(same) if x]
            solid = sum(item[i][0] != "#" for i in agree)
            slots = {(bare(theirs[i]), bare(own[i + shift])) for i in agree if item[i][0] == "#"}
            enough = len(agree) >= min(templates.LEAST_WORDS, len(item))
            much = len(agree) >= templates.LEAST_SHARE * len(item) or solid >= templates.LEAST_WORDS
            if enough and much and len({r for r, _ in slots}) == len(slots):
                found.add((doc_id, items[k][0]))
    return found


def pairs_of(rows):
    got = [(r.doc_id, r.item_id) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_leaks_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = pairs_of(templates.query(spark, SF))
    assert got == plain_leaks(docs, items)
    assert {(d, i) for i, q in items for d, t in docs if q in (t or "")} <= got


TRAIN = "A train leaves Boston at 45 km per hour while another leaves Denver at 60 km per hour, when do they meet if Boston is 900 km away?"
AGAIN = "A train leaves Chicago at 52 km per hour while another leaves Miami at 71 km per hour, when do they meet if Chicago is 840 km away?"
WRONG = AGAIN.replace("if Chicago", "if Paris")
APPLES = "Tom has 3 red apples in his bag. Mary gives him 4 more apples today."


def test_leaks_with_other_values(spark):
    items = [
        (1, TRAIN), (2, "Short one with five words here 7"), (3, APPLES), (4, "Compute 12 + 45 * 3 - 7"), (5, None), (6, ""), (7, "How far is it from Paris to the town near Lyon when we go by car?"),
        (1, TRAIN), (8, "one two"), (None, "an item without an id that is long enough to be found by its own words"),
    ]
    docs = [
        (1, f"Intro text. {AGAIN} End."), (2, f"Intro text. {WRONG} End."), (3, "Something else entirely that has nothing to do with trains or hours at all."), (4, None), (5, ""),
        (6, "Before. Short one with five words here 7 after"), (7, f"{WRONG} And then {AGAIN}"), (8, "x " + APPLES.replace("Tom", "Ann").replace("Mary", "Lucy")),
        (9, "please Compute 12 + 45 * 3 - 7 now"), (10, "please Compute 13 + 45 * 3 - 7 now"), (11, "How far\nis it from\nParis to the town near\nLyon when we go by car?".replace(" ", "\t")),
        (12, "and one two or three"), (None, AGAIN), (1, f"Intro text. {AGAIN} End."), (13, TRAIN.replace("45 km", "45\n\tkm")), (14, "an item without an id that is long enough to be found by its own words"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = pairs_of(templates.leaks(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_leaks(docs, items)
    assert got >= {(1, 1), (6, 2), (7, 1), (8, 3), (9, 4), (11, 7), (12, 8), (None, 1), (13, 1), (14, None)}
    assert not {(2, 1), (10, 4)} & got


def test_extra_columns(spark, tmp_path):
    spark.createDataFrame([(1, TRAIN)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, AGAIN, 5, 6, 7, "x"), (2, None, None, None, None, None), (None, "clean", 1, 2, 3, "y")], "doc_id long, text string, leaked_id int, text_key int, shift int, words string")
    kept = templates.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert templates.stage(spark, docs.limit(0), str(tmp_path)).count() == 0
