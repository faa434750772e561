
import random

import pytest
from pyspark.sql import functions as F

from crestline.llm import fingerprints, html_text, near_dedup


def _pairs():
    """Pairs of texts of 100 and more shingles with a Jaccard similarity of 0.79 to 0.86, each with words of its own."""
    rows, want = [], {}
    for k in range(60):
        cut = 9 + k % 6  # shared 100 - cut of 100 + cut shingles
        words = [f"w{k}x{i}" for i in range(104 + cut)]
        rows += [(2 * k, " ".join(words[:104])), (2 * k + 1, " ".join(words[cut : 104 + cut]))]
        want[2 * k + 1] = (100 - cut) / (100 + cut)
    return rows, want


def test_the_stage_links_from_80_percent_on(spark, tmp_path):
    import corpus_pipeline

    rows, want = _pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert any(0.80 <= j < 0.85 for j in want.values()) and any(j < 0.80 for j in want.values())
    assert kept == {2 * k for k in range(60)} | {i for i, j in want.items() if j < 0.80}


def test_the_percent_of_the_caller_holds(spark):
    rows, want = _pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 85):
        found = near_dedup.near_duplicates(docs, percent).where(~F.col("kept")).collect()
        assert {r.doc_id for r in found} == {i for i, j in want.items() if 100 * j >= percent}
    assert (near_dedup.trees(85), near_dedup.trees(80), near_dedup.agree(85), near_dedup.agree(80)) == (12, 16, 38, 32)


def test_likeness_across_the_limit_of_short_texts(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))[:n]
    rows, near, far = [], [], []
    for k in range(0, 160, 8):  # by descending doc_id each row's next is the one before it
        copy, long = prose(163), prose(3000)
        rows += [(k + 7, copy[:158]), (k + 6, copy), (k + 5, long[1000:1140]), (k + 4, long), (k + 3, prose(140)), (k + 2, prose(3000)), (k + 1, prose(300)), (k, "")]
        near += [k + 7, k + 5]
        far += [k + 3]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert min(got[i].near_next for i in near[::2]) > 0.85 and min(got[i].near_next for i in near[1::2]) > 0.4
    assert max(got[i].near_next for i in far) < 0.2
    # the edited text of one of 300 characters, the next being empty, has 150: about half of its own
    edited = [got[i].near_edited for i in range(1, 160, 8)]
    assert all(0.3 < x < 0.7 for x in edited), edited
    # texts that are short keep the scale of all others too, so stored fingerprints always have one in common
    short, other = fingerprints.fingerprint("a" * 100), fingerprints.fingerprint("a" * 1000)
    assert fingerprints.containment(short, short) == 1 and fingerprints.containment(other, short) > 0.5


WORDS = "The council met on Tuesday and agreed on a plan for the old bridge over the river"


@pytest.mark.parametrize("attributes", ["<html><body class='has-sidebar'>%s", "<html class='no-cookie-notice'><body>%s", "<body class='footer'>%s", "<div id='content' class='with-sidebar'>%s</div>", "<div class='page widget'>%s</div>"])
def test_names_of_whole_pages_do_not_empty_them(attributes):
    page = attributes % f"<div class='nav-menu'><p>menu</p></div><p>{WORDS}</p><p>{WORDS}</p><div class='sidebar-left'><p>side</p></div>"
    assert html_text.main_text(page, html_text.Weights()) == f"{WORDS}\n{WORDS}"


def test_parts_of_an_article_stay_and_comments_do_not():
    page = f"<article><div class='post-header'><h1>Head</h1></div><p>{WORDS}</p><p class='alert-text'>Bridge closed</p></article><section class='comments'><article class='comment'><p>{WORDS}</p></article><article><p>{WORDS}</p></article></section>"
    assert html_text.main_text(page, html_text.Weights()) == f"Head\n{WORDS}\nBridge closed"
    assert html_text.main_text(f"<p>{WORDS}</p><article class='comment'><p>reader</p></article>", html_text.Weights()) == WORDS
