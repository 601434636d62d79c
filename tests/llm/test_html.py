import random

from quarry.llm import html

ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; <b>line</b></h1><p>One <i>two</i>\n  three<br>four<p>Five &eacute;&#33;</p><aside>Side</aside><form><p>Mail?</p></form><div id=comments><p>Nice!</div></article><footer>Foot</footer><script>var x='</p><p>no';</script></body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, shared int").repartition(3)
    out = {}
    for r in html.main_texts(df).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    return out


def test_article(spark):
    assert texts(spark, [(1, "http://h/a", ARTICLE)]) == {1: ["Head & line\nOne two three four\nFive é!"]}


def test_markup_that_is_cut_off_or_missing(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>abc &am"), (4, "u", "<article><p>abc</p><p cla"), (5, "u", "plain  text"), (6, "u", "<!-- <p>x</p> --><p>a < b</p>"), (7, "u", "<article><p>x<script>1<2"), (8, "u", "<article>" + "<p>word " * 3000)]
    got = texts(spark, rows)
    assert got == {1: [""], 2: [""], 3: ["abc &am"], 4: ["abc"], 5: ["plain text"], 6: ["a < b"], 7: ["x"], 8: ["\n".join(["word"] * 3000)]}


def page(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def test_lines_shared_with_the_nearest_url_go(spark):
    rows = [(1, "http://h.org/news/a", page("Site name", "Sign in", "Story one", "More one", "All rights reserved")), (2, "http://h.org/news/b?x=1", page("Site name", "Sign in", "Story two", "All rights reserved")), (3, "http://other.org/news/b", page("Site name", "Story three"))]
    assert texts(spark, rows) == {1: ["Story one\nMore one"], 2: ["Story two"], 3: ["Site name\nStory three"]}


def test_an_article_that_two_pages_have_stays(spark):
    assert texts(spark, [(1, "http://h/a", ARTICLE), (1, "http://h/a", ARTICLE), (2, "http://h/b", ARTICLE), (None, "http://h/c", ARTICLE)]) == {1: ["Head & line\nOne two three four\nFive é!"] * 2, 2: ["Head & line\nOne two three four\nFive é!"], None: ["Head & line\nOne two three four\nFive é!"]}


def test_shuffled_decisions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(html, "small", lambda df, rows=0: df)
    test_lines_shared_with_the_nearest_url_go(spark)


def test_empty_table(spark):
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = sorted(html.longest_common(a, b))
        assert len(got) == brute(a, b)
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[i] for i in got))


def test_registered_query_on_the_table(spark):
    import re
    from html import unescape

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = re.sub(r"<[^>]*$", "", r.html.split("<article>", 1)[1].split("</article>")[0]).split("<footer>")[0]
        want[r.page_id] = "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", a)) if x)
    assert {r.page_id: r.text for r in html.query(spark, sf).collect()} == want


def test_nearest_article_outranks_names_of_wrappers():
    main = lambda page: [t for v, t in html.lines(page) if v == html.ARTICLE]
    assert main('<div class="layout with-sidebar"><article><p>Body text</p></article></div>') == ["Body text"]
    assert main('<div class="search-results"><article><p>a</p></article><p>b</p></div>') == ["a"]
    assert main('<article><div class="social-science"><p>kept</p></div><header class="entry-header"><h1>T</h1></header><div class="ad">no</div></article>') == ["kept", "T"]
    assert main('<article>x<section class="comments"><article>reply</article></section></article><nav><article>n</article></nav>') == ["x"]


def test_every_page_is_aligned_and_its_open_lines_decided_by_it(spark):
    story = lambda n, x="same paragraph": f"<body><div>Site name</div><h1>Title {n}</h1><nav>Menu {n}</nav><article><p>Story {n}</p><p>{x}</p></article><div>Imprint</div></body>"
    rows = [(1, "http://h.org/a/1", story(1)), (2, "http://h.org/a/2", story(2)), (3, "http://alone.org/a", story(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.shared for r in html.shared_lines(df).collect()} == {1: [0, 4, 5], 2: [0, 4, 5]}
    assert texts(spark, rows) == {1: ["Title 1\nStory 1\nsame paragraph"], 2: ["Title 2\nStory 2\nsame paragraph"], 3: ["Story 3\nsame paragraph"]}


def test_copies_and_empty_pages_are_no_partners(spark):
    own = page("Site name", "Story one")
    rows = [(1, "http://h.org/a", own), (1, "http://h.org/a", own), (2, "http://h.org/a?ref=x", own), (3, "http://h.org/b", None), (4, "http://h.org/c/d", own), (5, "http://h.org/z", page("Site name", "Story two"))]
    assert texts(spark, rows) == {1: ["Story one"] * 2, 2: ["Story one"], 3: [""], 4: ["Story one"], 5: ["Story two"]}


def test_alignment_by_bits(monkeypatch):
    a, b = [1, 2] * 30_000 + [3], [4, 2, 1, 1] * 15_000 + [5]
    assert len(html.longest_common(a, a[::-1])) == 59_999  # 1.8e9 pairs of equal lines
    assert len(html.longest_common(a, b)) == 44_999  # all of b that a has but one, as the greedy match of b in a ends one line short
    monkeypatch.setattr(html, "MATCHES", 0)
    test_longest_common_subsequence()
