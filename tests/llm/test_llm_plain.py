"""Each operator against a plain version on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliploom.llm import html, lines, minhash, packing, phrases, pii, quality, secrets, sharding, templates
from cliploom.llm.common import table, words_of

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_shards(spark, texts):
    rows = sharding.query(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 24, max(r.size for r in rows)
    assert max(abs(x - mean) for x in size.values()) <= largest + 0.01 * mean


def test_packing(spark, texts):
    rows = packing.pack(table(spark, SF, "documents")).collect()
    encoder, seen = packing.Encoder(packing.tokenizer_path()), defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length == len(r.ids) // 4 and r.length & (r.length - 1) == 0 and r.length <= 2048
        seen[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for doc_id, parts in seen.items():
        ids = np.concatenate([x for _, x, _ in sorted(parts, key=lambda p: p[0])])
        plain = encoder.tokenizer.encode(texts[doc_id], add_special_tokens=False).ids
        assert list(ids) == [*plain, 1] and all(n == len(ids) for *_, n in parts)
        assert encoder.tokenizer.decode(list(ids[:-1])) == texts[doc_id]


@pytest.mark.parametrize("text", ["a  b", " x", "q \n y", "", "\n", "a\nb", "a b", "(x y", "a b c", "<|endoftext|> b", "é ,b\n,c d", "x\ty z"])
def test_encoder_edges(text):
    import pyarrow as pa

    encoder = packing.Encoder(packing.tokenizer_path())
    plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [list(x) for x in encoder(pa.array(["w x", text, None, text]))][1] == plain


PLAIN_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN_PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


ODD_PII = [
    None, "", "a@b.c.@d.e", "x@y..z u@v.w", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.256", "4111 1111 1111 1111", "4111-1111  1111-1111",
    "+1 (988) 555-2485 +12", "é+44 20 7946 0958)", "a" * 60_000, "1" * 60_000, "1 " * 30_000, "a." * 30_000 + "@" + "b." * 30_000 + "c",
    "mail x@y.org x@y.org\nx@y.org", "5 +123456789012345678 6", "\U0001f600 t@u.vw",
]


def test_pii_base(spark, texts):
    everything = {**texts, **{-1 - i: t for i, t in enumerate(ODD_PII)}}
    docs = spark.createDataFrame(list(everything.items()), "doc_id long, text string")
    rows = pii.find(docs).collect()
    assert len(rows) == len(everything)
    for r in rows:
        base = plain_pii(everything[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest(), (r.doc_id, joined(base), r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))


def test_pii_learns_patterns(spark):
    rows = [(i, f"some words then mailbox u{i}@x{i}.org and others") for i in range(12)]
    rows += [(50, "some words then mailbox user-1234-77 and others"), (51, "plain words user-1234-78 here"), (52, "mailbox 12 only")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "found:24:36" and got[51] == "" and got[52] == ""


def test_pii_goes_on_until_no_pattern_is_new(spark):
    """Unseen identifiers behind frequent words, reached by chains of patterns of several words and of the right side."""
    rows = [(i, f"call number is u{i}@x{i}.org .") for i in range(30)]
    rows += [(100 + i, f"the number is {i}") for i in range(40)]  # so that neither word alone qualifies
    rows += [(200 + i, f"call number is K-77{i}-4 .") for i in range(4)]  # behind a pattern of seeds
    rows += [(300 + i, f"permit\tof K-77{i % 4}-4 x{i}") for i in range(12)]  # the same strings elsewhere
    rows += [(400 + i, f"permit of  Z-88{i}-4 seen") for i in range(4)]  # new strings behind that pattern
    rows += [(500 + i, f"a{i} Z-88{i}-4 seen") for i in range(4)] + [(510, "b Q-999-1 seen")]  # and on the right of it
    rows += [(600 + i, f"the lot of P-55{i}-4 z{i}") for i in range(20)] + [(None, None), (None, ""), (700, "call number is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    texts = dict(rows)
    found = {k: [texts[k][int(s) : int(e)] for kind, s, e in (x.split(":") for x in v.split(",") if v) if kind == "found"] for k, v in got.items()}
    for first in (200, 300):
        assert [found[first + i] for i in range(4)] == [[f"K-77{i}-4"] for i in range(4)]
    for first in (400, 500):
        assert [found[first + i] for i in range(4)] == [[f"Z-88{i}-4"] for i in range(4)]
    assert found[510] == ["Q-999-1"]
    assert not any(found[k] for k in texts if k is not None and (k < 200 or k >= 600))


def test_quality(spark, texts):
    for r in quality.query(spark, SF).collect():
        w = [x.decode() for x in words_of(texts[r.doc_id])]
        n = len(w)
        counts = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
        covered = {j for i in range(n - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines_, seen, dup = texts[r.doc_id].split("\n"), set(), 0
        for line in lines_:
            dup += bool(words_of(line)) and line in seen
            seen.add(line)
        expected = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 10 or 100 * len(covered) > 20 * n)
        twice = lambda k: {tuple(w[i : i + k]) for i in range(n - k + 1)} if n < k else [t for t, c in Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).items() if c > 1]
        long_ = set(twice(10)) if n >= 10 else set()
        spans = {j for i in range(n - 9) if tuple(w[i : i + 10]) in long_ for j in range(i, i + 10)}
        low, high = 4, n  # the longest repeat, by bisection: a part of a repeat is a repeat
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid < n and twice(mid) else (low, mid)
        longest = low if low >= 5 else 0
        assert (r.n_long_words, r.longest_repeat) == (len(spans), longest)
        assert r.kept == (not r.base_failed and len(spans) <= 0.15 * n and not (longest >= 50 and longest > 0.1 * n))


def test_maximal_repeats():
    import random

    make = random.Random(4)
    for t in range(120):
        part = [" ".join(make.choices("ab" if t % 2 else "abcdefgh", k=make.choice([0, 1, 3, 8, 30, 60]))) for _ in range(4)]
        words = quality.WordTable(part)
        _, _, longest, maximal = quality.repetition(words.codes, words.first)
        for text, got, n in zip(part, longest, maximal):
            w, repeats = text.split(), set()
            for k in range(5, len(w)):
                places = defaultdict(list)
                for i in range(len(w) - k + 1):
                    places[tuple(w[i : i + k])].append(i)
                for phrase, at in places.items():
                    before, after = ({w[x] if 0 <= x < len(w) else -x - 1 for x in xs} for xs in ([i - 1 for i in at], [i + k for i in at]))
                    if len(at) > 1 and len(before) > 1 and len(after) > 1:
                        repeats.add(phrase)
            assert (got, n) == (max(map(len, repeats), default=0), len(repeats))


def test_phrases_match_sql(spark):
    import duckdb

    duckdb.sql(f"create or replace view documents as from '{SF}/documents.parquet'")
    expected = sorted(duckdb.sql(phrases.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, phrases.query(spark, SF).collect())) == expected
    assert sum(r[2] for r in expected) > 0


def test_phrases_of_an_id_with_several_texts(spark):
    """Windows of every text of a repeated id count; windows are judged against a plain rule over (id, text) rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    mixed = " ".join(b.split()[40:140] + [f"m{i}" for i in range(30)] + a.split()[:60])
    rows = [(5, a), (5, b), (5, b), (9, b), (10, a), (11, mixed), (12, c), (12, mixed), (13, c + " tail")]
    starts = {}
    for i, text in rows:
        w = text.split()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            starts[key] = min(starts.get(key, i), i)
    expected = []
    for i, text in rows:
        w, gone = text.split(), set()
        for p in range(len(w) - 49):
            if starts[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        expected.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = phrases.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert (9, 200, 200) in [tuple(r)[:3] for r in got.collect()]


def test_phrases_overlaps(spark):
    make = np.random.default_rng(5)
    passage = [f"w{x}" for x in make.integers(0, 40, 400)]
    docs = []
    for i in range(40):
        a, n = int(make.integers(0, 330)), int(make.integers(30, 120))
        docs.append((i, " ".join([*(f"u{x}" for x in make.integers(0, 9999, 20)), *passage[a : a + n], *["z"] * int(make.integers(0, 90))])))
    docs += [(40, None), (41, ""), (42, docs[3][1]), (42, docs[3][1]), (None, docs[3][1])]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in phrases.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.doc_id is not None)
    first = {}
    for i, t in docs:
        w = (t or "").split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in docs:
        w = (t or "").split()
        if i is not None:
            gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
            want.append((i, len(w), len(gone)))
    assert got == sorted(want)


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(x, y):
    common = sum((x & y).values())
    return common / ((x | y).total() or 1)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, texts):
    bags, by = {i: bag(t) for i, t in texts.items()}, defaultdict(set)
    for i, b in bags.items():
        for s in b:
            by[s].add(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if texts[a] == texts[b] or jaccard(bags[a], bags[b]) >= 0.8]
    want = roots(texts, links)
    got = {r.doc_id: r.class_id for r in minhash.query(spark, SF).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_signatures_estimate_weighted_jaccard():
    make, got, want = np.random.default_rng(1), [], []
    for _ in range(60):
        base = [f"{x}" for x in make.integers(0, 30, 80)]
        other = [w if make.random() > 0.02 else "q" for w in base] + base[: int(make.integers(0, 40))]
        pair = [" ".join(base), " ".join(other)]
        owner, hashes = minhash.shingles(pair)
        a, b = minhash.signatures(owner, hashes, 2, size=400)
        got.append((a == b).mean())
        want.append(jaccard(bag(pair[0]), bag(pair[1])))
    assert abs(np.mean(np.array(got) - np.array(want))) < 0.01


def test_near_duplicate_edges(spark):
    docs = [(1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "a b"), (7, "a c"), (7, "a c"), (None, "a b")]
    got = sorted(((r.doc_id, r.class_id, r.n_rows) for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 3), (6, 5, 3), (7, 7, 2), (7, 7, 2)]


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, texts):
    odd = [None, "", "secret=token: abcdefghij", "PASSWORD : 'abcdefgh'", "AKIAXAKIA" + "Z" * 10, "g" + "a1" * 16, "é password=12345678é"]
    everything = {**texts, **{-1 - i: t for i, t in enumerate(odd)}}
    docs = spark.createDataFrame(list(everything.items()), "doc_id long, text string")
    for r in secrets.scan(docs, secrets.fit(docs)).collect():
        base = plain_secrets(everything[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))


def test_secret_model_on_held_out_samples(spark):
    """Recall for each alphabet and length of keys, and false alarms on names that were not in the sample."""
    import random

    make = random.Random(101)
    ratio = secrets.fit(table(spark, SF, "documents"))
    code = {c: i for i, c in enumerate(secrets.ALPHABET)}
    for alphabet in secrets.ALPHABETS:
        for size, least in ((12, 0.8), (16, 0.9), (20, 0.95), (24, 0.95), (32, 0.97), (64, 0.99)):
            hits = sum(secrets.is_random("".join(make.choices(alphabet, k=size)), ratio, code) for _ in range(300)) / 300
            assert hits >= least, (alphabet, size, hits)
    names = secrets.identifiers("the value of file index user count name".split(), 2000, seed=102)
    assert sum(secrets.is_random(x, ratio, code) for x in names) / 2000 < 0.005


def test_secrets_after_a_name(spark):
    """A name before "=" does not water its value down; padding belongs to the key, and names alone are none."""
    value = "Zx9Qw7Lp2Rt5Vb8Nm3"
    texts = [f"api-endpoint-configuration-value={value}", f"{value}==", "api-endpoint-configuration-value=another-ordinary-configuration", f"x={value}={value}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs, secrets.fit(table(spark, SF, "documents"))).collect()}
    assert got == {0: "markov:33:51", 1: "markov:0:20", 2: "", 3: "markov:2:21,markov:21:39"}


def test_secrets_of_letters_alone(spark):
    docs = spark.createDataFrame([(1, "take qWzKpVxJrTbNmGhL now"), (2, "take internationalization now"), (3, "pa\u017f\u017fword=abcdefgh to\u212aen=12345678")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs, secrets.fit(table(spark, SF, "documents"))).collect()}
    assert got[1].spans == "markov:5:21" and got[2].spans == "" and got[3].n_assign == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article class='post-{n}'><h1>Head &amp; line {n}</h1><p><b>First   para <a href='x'>link</a>.<br>more<p>Second &lt;b&gt;\n para {n} that "
    "goes on for a good while so that it weighs something.</p><aside>Also read</aside><form>Mail <input></form></article><div id='comments'><p>Nice! I like it a lot, thanks.</p></div>"
    "<div class='ad'>Buy</div><footer>&copy; site</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, f"https://h.example.org/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(5, "https://h.example.org/5", None), (6, None, ""), (7, "odd", "just text &amp; more"), (8, "https://h.example.org/8", PAGE[:420].replace("{n}", "8"))]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].text == f"Head & line {i}\n\nFirst para link. more\n\nSecond <b> para {i} that goes on for a good while so that it weighs something."
        assert got[i].n_chars == len(got[i].text)
    assert got[5].text == got[6].text == "" and got[7].text == "just text & more" and got[8].text.startswith("Head & line 8")


def test_pages_of_the_tables(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    import html as entities

    for r in html.query(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(filter(None, blocks))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, band int, node string")
    for run in (sharding.shard, packing.pack, pii.find, quality.quality, phrases.dedup, minhash.classes, lines.drops):
        assert run(docs).count() == 0, run
    assert templates.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert secrets.scan(docs, secrets.fit(docs)).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame([(None, None, 1, "x", 2), (1, "a b c", None, None, None), (1, "a b c", 3, "y", 4)], "doc_id long, text string, shard int, node string, place int")
    for run in (sharding.shard, packing.digest, pii.find, quality.quality, phrases.dedup, minhash.classes):
        assert run(docs).count() >= 3, run
    lines.drops(docs).count()
    assert templates.leaks(docs, spark.createDataFrame([(None, None), (2, "")], "item_id long, text string")).count() == 0
