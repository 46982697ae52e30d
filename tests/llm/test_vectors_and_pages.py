"""Vector search and page texts on odd rows, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from wattline.llm import onebit_search, page_text


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(24).round(3).tolist(), 1, "x") for i in range(600)]
    rows += [(700 + i, rows[100][1], 1, "x") for i in range(40)]  # ties
    rows += [(900, None, 1, "x"), (1000, [0.0] * 24, 1, "x"), (1100, [float("nan")] + [1.0] * 23, 1, "x"), (1200, [None] + [1.0] * 23, 1, "x"), (1300, [float("inf")] * 24, 1, "x"), (1400, [], 1, "x"), (1500, [1.0, 2.0], 1, "x"), (1600, [1.0, 2.5], 1, "x"), (None, [1.0] * 24, 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in onebit_search.search(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, v in fine:
        if q % 100 == 0:
            expected = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in fine if i != q and len(x) == len(v))[:10]
            mine = [got[q][k] for k in sorted(got[q])]
            assert [i for i, _ in mine] == [i for _, i in expected]
            assert np.allclose([s for _, s in mine], [s for s, _ in expected], rtol=1e-12)
    assert set(got) == {q for q, _ in fine if q % 100 == 0}


def test_search_of_nothing(spark):
    assert onebit_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    vectors, query, centre = rng.standard_normal((4000, 64)), rng.standard_normal(64), np.zeros(64)
    guess, least = onebit_search.estimates(*onebit_search.encode(vectors, centre), query, centre)
    true = ((vectors - query) ** 2).sum(1)
    assert (least <= true).mean() > 0.998
    assert abs((guess - true).mean()) < 1.0


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One  two<br>three<p><b>Four &lt;five&gt;</article><footer>end</footer>'


def test_article_is_kept_whole_and_the_rest_goes(spark):
    shared = "<div>Call us today for one free quote on all of our fine services</div>"
    rows = [(1, "http://a.example/1", PAGE), (1, "http://a.example/1", PAGE), (2, None, None), (3, "http://a.example/3", ""), (4, "not a url", "plain  text\n here"), (5, "http://[bad", "<p>x")]
    rows += [(10 + i, f"http://www.b.example/{i}", f"<body>{shared}<p>Own words of page number {i} stay here</p>{shared}</body>") for i in range(30)]
    rows += [(50, "http://c.example/", f"<body>{shared}<p>alone</p></body>"), (None, "http://b.example/z", "<main><p>m</p></main>after"), (60, "http://b.example/y", '<p>seen</p><div class="cookie-notice">c</div><form>f</form><div id="comments"><article>c</article></div>')]
    frame = spark.createDataFrame([r + ("x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    out = page_text.main_texts(frame).collect()
    assert len(out) == len(rows)
    got = {r.page_id: (r.text, r.n_chars) for r in out}
    article = "A & B\nOne two three\nFour <five>"
    assert got[1] == (article, len(article)) and sum(r.page_id == 1 for r in out) == 2
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "plain text here" and got[5][0] == "x" and got[None][0] == "m" and got[60][0] == "seen"
    assert all(got[10 + i][0] == f"Own words of page number {i} stay here" for i in range(30))
    assert got[50][0].startswith("Call us today") and got[50][0].endswith("\nalone")


def test_suffixes_meet_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(page_text, "ROWS_A_PART", 5)
    rows = [(i, f"http://h.example/{i}", f"<div>one two three four five six seven eight nine ten</div><p>p{i}</p>") for i in range(40)]
    out = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"p{i}" for i in range(40)}


def test_repeated_runs_inside_articles_go_and_copies_stay(spark, monkeypatch):
    own = lambda i, n=24: " ".join(f"w{i}x{j}" for j in range(n))
    notice = "Sign up for the daily letter of this house and never miss a story again"
    page = lambda *parts: "<nav>Home</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"
    rows = [(i, f"http://a.example/{i}", page(own(i), notice, own(100 + i))) for i in range(6)]
    rows += [(10, "http://a.example/short", page("Only this", notice))]
    rows += [(20 + i, f"http://b.example/{i}", page(own(200), own(201))) for i in range(6)]  # exact copies
    rows += [(30 + i, f"http://c.example/{i}", page(own(300), f"edit{i}", own(301))) for i in range(6)]  # near copies
    rows += [(40 + i, f"http://d.example/{i}", page(own(400 + i), notice)) for i in range(2)]  # too few contents
    rows += [(50 + i, f"http://e.example/{i}", f"<div>{own(500)}</div>") for i in range(3)]  # copies without markup
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (page_text.ROWS_A_PART, 5):
        monkeypatch.setattr(page_text, "ROWS_A_PART", size)
        got = {r.page_id: r.text for r in page_text.main_texts(frame).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == own(i) + "\n" + own(100 + i) for i in range(6)) and got[10] == "Only this"
        assert all(got[20 + i] == own(200) + "\n" + own(201) for i in range(6))
        assert all(got[30 + i] == f"{own(300)}\nedit{i}\n{own(301)}" for i in range(6))
        assert all(got[40 + i] == own(400 + i) + "\n" + notice for i in range(2))
        assert all(got[50 + i] == own(500) for i in range(3))


def test_names_inside_articles_are_whole_names(spark):
    body = {
        "discussion": '<section id="discussion"><p>We discuss the results</p></section>', "hyphen": '<p class="ad-hoc">An ad hoc group met</p>', "heading": '<h2 id="related-work">Related work</h2>',
        "title": '<div class="entry-header"><h1>The title</h1></div>', "share": '<div class="share">Share this</div>', "letter": '<div class="box newsletter">Sign up</div>', "comments": '<div id="comments"><p>first!</p></div>',
        "outside": "<p>x</p></article><div class=\"site-footer\">end</div><article>",
    }
    rows = [(i, f"http://{k}.example/", f"<article>{v}<p>Own text</p></article>") for i, (k, v) in enumerate(body.items())]
    got = {r.page_id: r.text for r in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = ["We discuss the results\n", "An ad hoc group met\n", "Related work\n", "The title\n", "", "", "", "x\n"]
    assert got == {i: k + "Own text" for i, k in enumerate(kept)}


def test_main_blocks_equal_a_plain_count(spark, monkeypatch):
    """A host of random articles from few paragraphs: what stays is what a count of voting contents leaves."""
    import random

    rng = random.Random(6)
    common = [" ".join(f"c{k}w{j}" for j in range(rng.choice([4, 8, 12]))) for k in range(8)]
    articles = [[" ".join(f"u{i}p{p}w{j}" for j in range(rng.choice([3, 15, 30]))) if rng.random() < 0.6 else rng.choice(common) for p in range(rng.randrange(1, 7))] for i in range(60)]
    articles += articles[:10]
    rows = [(i, "http://h.example/", "<nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in a) + "</article>") for i, a in enumerate(articles)]
    monkeypatch.setattr(page_text, "ROWS_A_PART", 40)
    got = {r.page_id: r.text for r in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    contents = {tuple(a) for a in articles}
    holders = {p: {a for a in contents if p in a} for a in contents for p in a if len(p.split()) >= page_text.RUN}

    def votes(a):
        size = sum(len(p.split()) for p in a)
        return 2 * sum(len(p.split()) for p in a if len(holders.get(p, ())) < 2) >= size

    gone = {p for p, own in holders.items() if len(own) > 1 and sum(map(votes, own)) >= page_text.MAIN_VOTES}
    assert gone and got == {i: "\n".join(p for p in a if p not in gone) for i, a in enumerate(articles)}


def test_no_pages(spark):
    assert page_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
