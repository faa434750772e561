"""The page reader: the scan against all spans, given pages with and without marks, hostile pages, odd cases."""

import html
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from crestline.llm import html_text as H

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def learned(pages):
    w = H.Weights()
    for p in pages:
        for (kind, feature, inside), n in (H.count(p) or {}).items():
            a, b = w.seen.get((kind, feature), (0, 0))
            w.seen[kind, feature] = (a + n, b) if inside else (a, b + n)
    return w


def article(page):
    """The text of a given page's article, by its markup alone."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p|br)[^>]*>", inner)]
    return "\n".join(p for p in parts if p)


def without_marks(page):
    return re.sub(r'class="[^"]*"', 'class="qx7"', page.replace("<article>", "<div>").replace("</article>", "</div>"))


def random_page(rng):
    names = "p div h1 li ul td a b span section nav article br footer aside".split()
    out = []
    for _ in range(rng.randint(1, 40)):
        kind = rng.random()
        name = rng.choice(names)
        attribute = rng.choice(["", "", "", ' class="ad"', ' id="comments"', ' class="x y"'])
        out.append(" ".join(["word"] * rng.randint(1, 12)) if kind < 0.4 else f"<{name}{attribute}>" if kind < 0.75 else f"</{name}>")
    return "".join(out)


def brute(blocks, w):
    """The greatest sum of any contiguous blocks, and the spans that have it."""
    sums = {(i, j): sum(w.block(b) for b in blocks[i:j]) + sum(w.between(b) for b in blocks[i + 1 : j]) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)}
    top = max(sums.values(), default=0)
    return top, {s for s, v in sums.items() if v == top}


def test_the_scan_finds_the_greatest_of_all_spans():
    rng = random.Random(4)
    trained = learned([f"<nav><a>x</a></nav><div>{'w ' * 9}</div><article><h1>t</h1><p>{'w ' * k}</article><footer>f</footer>" for k in range(1, 60)])
    cut = 0
    for k in range(400):
        blocks = H.blocks_of(random_page(rng))
        w = trained if k % 2 else H.Weights()
        span = H.best_run(blocks, w)
        _, best = brute(blocks, w)
        assert span in best if blocks else span == (0, 0)
        cut += 0 < span[1] - span[0] < len(blocks)
    assert cut > 100  # the scan decides


def test_words_score_positive_and_tags_negative():
    w = learned([f"<nav><ul><li><a>menu</a></ul></nav><div class='ad'>buy now</div><article><h1>t</h1><p>{'w ' * k}</article>" for k in range(1, 60)])
    for weights in (w, H.Weights()):
        for kind, feature in w.seen:
            assert (weights.of(kind, feature) > 0) == (kind == "word")


@given
def test_given_pages_with_and_without_marks(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    w = learned(pages[::2])
    assert all(H.main_text(p, w) == article(p) for p in pages)
    # held out, without marks, classes and ids: only the weights of words and tags are left
    assert all(H.main_text(without_marks(p), w) == article(p) for p in pages[1::2])
    # and what is cut away is not what apart elements say alone
    everything = ["\n".join(b.text for b in H.blocks_of(without_marks(p)) if not b.apart) for p in pages[1::2]]
    assert sum(e != article(p) for e, p in zip(everything, pages[1::2], strict=True)) > len(everything) * 0.9


@given
def test_the_query_gives_the_given_articles(spark):
    from crestline.llm import queries

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op8_html_text(spark, DATA).collect()
    assert {r.page_id: r.text for r in got} == {k: article(p) for k, p in pages.items()} and all(r.n_chars == len(r.text) for r in got)


LONG = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<div class="article-header"><h1>Head</h1></div>', "Head"),
        ('<div class="stock-alert">Shares fell</div>', "Shares fell"),
        ('<p data-id="share">Shared</p>', "Shared"),
        ("<p title=\" class='ad' \">Titled</p>", "Titled"),
        ('<div class="ad">buy</div>', ""),
        ('<aside>side</aside><div id="sidebar-left">links</div>', ""),
        ('<section class="post-comments"><article>reader</article></section>', ""),
        ("<table><tr><td>cell</td></tr></table><ul><li>item</li></ul>", "cell\nitem"),
        ("<form><input><p>form</p></form><button>go</button>", ""),
    ],
)
@pytest.mark.parametrize("mark", ["article", "main", "div role=main"])
def test_nothing_else_is_dropped_within_an_article(inner, want, mark):
    page = f"<nav><p>menu</p></nav><{mark}><p>{LONG}</p>{inner}<p>{LONG}</p></{mark.split()[0]}><footer><p>foot</p></footer>"
    assert H.main_text(page, H.Weights()) == "\n".join(x for x in (LONG, want, LONG) if x)
    ended = f"<{mark}><p>{LONG}</p>{inner}<ul><li>end</li></ul></{mark.split()[0]}><footer><p>foot</p></footer>"
    assert H.main_text(ended, H.Weights()) == "\n".join(x for x in (LONG, want, "end") if x)
    last = f"<{mark}><p>{LONG}</p>{inner}</{mark.split()[0]}><footer><p>foot</p></footer>"
    assert H.main_text(last, H.Weights()) == "\n".join(x for x in (LONG, want) if x)


ANCHORS = [
    '<h2 id="Advertising">Advertising rules</h2>',
    '<h2 id="menu">The school menu</h2>',
    '<section id="social"><h2>Social policy</h2><p>It changed in May.</p></section>',
    '<p id="comment">The mayor gave a comment on it.</p>',
    '<h3 class="share">A fair share</h3>',
    f'<div id="notice"><p>{LONG}</p></div>',
    '<p>They <span class="ad">placed</span> an <b id="footer">advert</b> there.</p>',
    '<ul><li>one <i class="menu">menu</i></li></ul>',
]


@pytest.mark.parametrize("inner", ANCHORS)
@pytest.mark.parametrize("mark", ["article", "main", 'div class="content"', "div"])
@pytest.mark.parametrize("trained", [False, True])
def test_names_of_headings_paragraphs_and_anchors_cut_nothing(inner, mark, trained):
    w = learned([f"<nav><ul><li><a>menu</a></ul></nav><div class='ad'>buy now</div><article><h1>t</h1><p>{'w ' * k}</article>" for k in range(1, 60)]) if trained else H.Weights()
    want = "\n".join(" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in re.split(r"</(?:h2|h3|p|li)>", inner) if re.sub(r"<[^>]*>", "", x).strip())
    page = f"<nav><p>menu</p></nav><{mark}><p>{LONG}</p>{inner}<p>{LONG}</p></{mark.split()[0]}><footer><p>foot</p></footer>"
    assert H.main_text(page, w) == "\n".join([LONG, want, LONG])


@pytest.mark.parametrize("inner", [
    '<div class="ad"><h2>Buy</h2><p>now</p></div>', '<ul class="menu"><li>one</li></ul>', '<div id="comments"><h2>Comments</h2><p>First, I say.</p></div>', '<li class="comment"><p>A reader.</p></li>',
    '<div id="sidebar"><h3>About</h3><p>Some words.</p></div>', '<div id="social">Follow us</div>', '<div id="share"><a>tell</a> <a>others</a></div>', '<section class="newsletter"><p>Join</p></section>',
])
def test_menus_adverts_and_comments_still_go(inner):
    page = f"<nav><p>menu</p></nav><div><p>{LONG}</p>{inner}<p>{LONG}</p></div><footer><p>foot</p></footer>"
    assert H.main_text(page, H.Weights()) == f"{LONG}\n{LONG}"


def test_heads_without_an_end_and_pages_within_a_form():
    assert H.main_text(f"<html><head><title>t</title><body><p>{LONG}", H.Weights()) == LONG
    assert H.main_text(f"<form><main><p>{LONG}</p></main></form>", H.Weights()) == LONG
    assert H.main_text(f"<aside><article><p>{LONG}</p></article></aside><article><p>{LONG} x</p></article>", H.Weights()) == f"{LONG} x"


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a x="', "<a x='y", "<p>", "<!--", "<script>", "</b>", "&", "&amp", "<", "= ", "<div class='ad'>", "<br x='\">"])
def test_hostile_pages_take_linear_time(part):
    def took(n):
        began = time.process_time()
        H.main_text(f"<p>{LONG}</p>" + part * n, H.Weights())
        return time.process_time() - began

    small, large = took(150_000 // len(part)), took(2_000_000 // len(part))
    assert large < 40 * max(small, 0.02), (small, large)
    assert H.main_text(f"<p>{LONG}</p>" + part * 100, H.Weights()).startswith("w0 w1")


def test_learning_takes_each_page_once_and_a_bounded_number(spark, monkeypatch):
    page = "<nav>menu</nav><article><p>{}</p></article>"
    rows = [(page.format("hot " * 20),)] * 200 + [(page.format(f"w{i} " * 5),) for i in range(30)] + [(None,), ("",), ("no mark",)]
    df = spark.createDataFrame(rows, "html string").repartition(5)
    w = H.learn(df)
    assert w.seen["tag", ("edge", "")] == (0, 31)  # one a page: nothing follows the articles
    monkeypatch.setattr(H, "SAMPLE", 10)
    assert H.learn(df).seen["tag", ("edge", "")] == (0, 10)
    assert H.learn(df.where("html IS NULL")).seen == {}


def test_clashing_names_very_long_and_repeated_pages(spark):
    rows = [(1, f"<article><p>{LONG}</article>", "x", 5)] * 3 + [(None, "<p>" + "long " * 200_000, "y", 6), (2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, h long")
    got = H.extract(df, H.learn(df)).select("page_id", F.length("text").alias("n"), "h").collect()
    assert sorted((str(r.page_id), r.n, str(r.h)) for r in got) == sorted([("1", len(LONG), "5")] * 3 + [("None", 999_999, "6"), ("2", 0, "None")])
