"""Main texts of pages whose layout no name gives away, and of odd pages."""

import random
import time

from cliploom.llm import html


def sentence(make, n=30):
    return " ".join("".join(make.choices("abcdefghij", k=make.randint(2, 8))) for _ in range(n))


def extracted(spark, rows):
    return {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_layouts_without_known_names(spark):
    """No article element and no telling class: what repeats, links and small parts are left out by votes alone."""
    make, rows, want = random.Random(3), [], {}
    for i in range(10):
        paragraphs = [sentence(make) for _ in range(make.randint(4, 7))]
        rail = f"<div class='z2'><div class='k'>Always the same words stand here on every page of it</div><div class='k'>{sentence(make, 6)}</div></div>"
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"https://a.example/{i}", f"<html><body><div class='q'>Welcome to the site</div><div class='w'><div class='x1'>{body}</div>{rail}</div></body></html>"))
        want[i] = paragraphs
    for i in range(10, 20):
        title, paragraphs = sentence(make, 5), [sentence(make) for _ in range(5)]
        sections = "".join(f"<div class='s{k}'><p>{p}</p></div>" for k, p in enumerate(paragraphs))
        links = "".join(f"<div><a href='/{k}'>{sentence(make, 9)}</a></div>" for k in range(9))
        rows.append((i, f"https://b.example/{i}", f"<body><div class='m'><div class='n'><h1>{title}</h1><div class='e'>{sections}</div></div><div class='l'>{links}</div></div></body>"))
        want[i] = [title, *paragraphs]
    got = extracted(spark, rows)
    assert {i: got[i].text.split("\n\n") for i in want} == want
    assert all(r.by_host for r in got.values())


def test_a_host_helps_its_poor_pages(spark):
    """A short article beside long page-own text is found by the path that the host's other pages elect."""
    make, rows = random.Random(4), []
    page = "<body><div class='x'><p>{}</p></div><div class='y'><p>{}</p></div></body>"
    for i in range(8):
        rows.append((i, f"https://c.example/{i}", page.format(sentence(make, 90), sentence(make, 4))))
    short, other = sentence(make, 40), sentence(make, 38)
    rows.append((8, "https://c.example/8", page.format(short, other)))
    rows.append((9, "https://c.example/9", f"<body><div class='v'><p>{other}</p></div></body>"))
    got = extracted(spark, rows)
    assert got[8].text == short and got[8].by_host
    assert got[9].text == other and not got[9].by_host


def test_names_inside_the_article(spark):
    """No name takes the article's own prose; what repeats, links and what is surely no article go, also inside it."""
    make, rows, want = random.Random(5), [], {}
    always = " ".join(["please share this with all of your friends"] * 4)
    for i in range(8):
        lead, title, body, past, shared = (sentence(make, n) for n in (12, 5, 40, 30, 25))
        page = (
            f"<body><header><p>{sentence(make, 9)}</p></header><main class='content'><h1>{title}</h1><p>{body}</p>"
            f"<section class='promotion-history'><p>{past}</p></section><section class='share'><p>{shared}</p></section><div class='share-box'><p>{always}</p></div>"
            f"<ul class='tags'><li><a href='/x'>{sentence(make, 3)}</a></li></ul><div class='post-comments'><p>{sentence(make, 30)}</p></div><div class='notice'><p>{sentence(make, 30)}</p></div></main></body>"
        )
        rows.append((i, "https://e.example/x", page))
        want[i] = [title, body, past, shared]
        page = f"<body><article><header><h1>{title}</h1><p>{lead}</p></header><div class='entry-header'><p>{past}</p></div><p>{body}</p><footer><p>{shared}</p></footer></article></body>"
        rows.append((10 + i, "https://f.example/x", page))
        want[10 + i] = [title, lead, past, body]
    got = extracted(spark, rows)
    assert {i: got[i].text.split("\n\n") for i in want} == want


def test_loose_names_outside_a_container(spark):
    """Without a container, names decide: a page of nothing else is empty."""
    words = " ".join(["word"] * 30)
    rows = [(1, None, f"<p>{words}</p><div class='promo'>{words} x</div>"), (2, None, f"<div class='banner'>{words}</div>"), (3, None, "<div class='share'></div>")]
    got = extracted(spark, rows)
    assert [got[i].text for i in (1, 2, 3)] == [words, "", ""]


def test_deep_and_broken_markup(spark):
    started = time.time()
    deep = "<div>" * 80_000 + "the text" + "</div>" * 10
    closers = "<div>x " + "<b></i></section></p></div>" * 20_000
    rows = [(1, "u", deep), (2, "u", closers), (3, None, "<p"), (4, "u", "<<<>>> a < b"), (5, "u", "<div class='a' a one <p>two"), (5, "u", "<div class='a' a one <p>two"), (6, "", None)]
    got = extracted(spark, rows)
    assert got[1].text == "the text" and got[2].text == "x" and got[6].text == "" and len(got) == 6
    assert time.time() - started < 60


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "https://h.example/1", "<p>a</p>", 1, "p", "h")], "page_id int, url string, html string, repeated int, path string, host string")
    assert [r.text for r in html.extract(docs).collect()] == ["a"]
