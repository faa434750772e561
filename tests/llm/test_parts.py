import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crestline.llm import decontamination, fingerprints, fixity, html_text, merges, near_dedup, piece_codec, queries, segments, sharding, token_counts, token_store, toxicity

TEXTS = st.lists(st.text(st.one_of(st.sampled_from("ab the'sdtrevlm 1\n\t.,!é日 ▁😀"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_byte_tokens_match_the_library(texts):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    encoder, special = token_store._encoder(queries.BYTE_BPE)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts, special)] == want
    assert token_counts.counter(queries.BYTE_BPE)(texts).tolist() == [len(x) for x in want]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_match_the_library(texts):
    codec = piece_codec.codec(queries.PIECE_BPE)
    assert [x.tolist() for x in codec.encode(texts)] == codec.library.encode(texts)


def test_letter_classes_match_the_library():
    pre = Tokenizer.from_file(queries.BYTE_BPE).pre_tokenizer
    kind, points = segments.ByteSplitter().kind, [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1F200)]
    for k, like in ((1, "a"), (2, "1"), (4, "!")):
        ends = {o[1] for _, o in pre.pre_tokenize_str("\n".join(like + chr(p) + like for p in points))}
        assert [p for i, p in enumerate(points) if (not {4 * i + 1, 4 * i + 2} & ends) != (kind[p] == k)] == []


def test_lockstep_agenda_equals_the_queue():
    rng = np.random.default_rng(1)
    table = merges.MergeTable(*(rng.integers(0, 12, 60) for _ in range(2)), rng.integers(0, 20, 60), rng.integers(0, 12, 60))
    lengths = rng.integers(1, 90, 300)
    symbols = rng.integers(0, 12, lengths.sum())
    out, sizes = merges.merge_all(symbols.copy(), lengths, table)
    want = [merges.merge_one(s.tolist(), table) for s in np.split(symbols, np.cumsum(lengths)[:-1])]
    assert sizes.tolist() == [len(w) for w in want] and out.tolist() == [x for w in want for x in w]


def test_long_texts_are_cut_where_units_start(monkeypatch):
    text = "word another 12 it's " * 3000
    monkeypatch.setattr(segments, "CHUNK", 1000)
    parts = list(segments.cut(text, 1000))
    assert "".join(parts) == text and len(parts) > 10
    encoder, special = token_store._encoder(queries.BYTE_BPE)
    assert encoder.encode([text], special)[0].tolist() == Tokenizer.from_file(queries.BYTE_BPE).encode(text).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, plane):
    a = np.array(ids, "<u4")
    if len(a):
        assert (token_store.unpack_block(token_store.pack_block(a, plane), len(a), plane) == a).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(10, 60))
def test_best_fit_equals_a_plain_search(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    left, want = [], []
    for s in sizes:
        fits = [(x, i) for i, x in enumerate(left) if x >= s]
        if fits:
            i = min(fits)[1]
            left[i] -= s
        else:
            i = len(left)
            left.append(max(0, capacity - s))
        want.append(i)
    assert sharding.best_fit_decreasing(sizes, capacity) == want


def test_packing_is_even_and_gives_giants_their_own():
    sizes = sorted([random.Random(3).randint(1, 100) for _ in range(3000)] + [60_000], reverse=True)
    loads = np.bincount(sharding.pack_into(sizes, 16), sizes, minlength=16)
    assert loads[0] == 60_000 and loads[1:].max() - loads[1:].min() <= 50


def test_fixed_capacity(spark):
    df = spark.createDataFrame([(i % 50, 3) for i in range(200)], "g long, b long")
    got = sharding.shard_groups(df, ["g"], "b", capacity=60)
    loads = [r.n for r in got.groupBy("shard").agg(F.sum("b").alias("n")).collect()]
    assert max(loads) <= 60 and len(loads) == 10 and got.groupBy("g").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


def test_chunks_shift_with_their_content():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("inserted words " + text)
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.containment(a, a) == 1
    assert (fingerprints.from_text(fingerprints.as_text(a)) == a).all()
    assert fingerprints.containment(a, fingerprints.fingerprint("")) == 0 and fingerprints.containment(*[fingerprints.fingerprint("")] * 2) == 1


def test_gear_hash_depends_on_the_last_bytes_only():
    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    whole = fingerprints.gear_hashes(data)
    g, h = fingerprints._gears(), 0
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(g[b])) & 0xFFFFFFFF
        assert int(whole[i]) == h


def test_blocks_of_the_benchmark_unite(spark, nasty, written, monkeypatch):
    items = spark.read.parquet(f"{written['nasty']}/benchmark.parquet")
    key = lambda df: sorted(map(str, decontamination.report(df).collect()))
    docs = spark.read.parquet(f"{written['nasty']}/documents.parquet")
    one = key(decontamination.matches(docs, items))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert key(decontamination.matches(docs, items)) == one


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x x blue"), (2, "blue red"), (3, "red x x x x blue"), (4, None)], "doc_id long, text string")
    got = decontamination.proximity(df, [["red", "blue"], ["blue"]], within=3)
    assert sorted((r.doc_id, r["query"], r.n) for r in got.collect()) == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 1), (3, 1, 1)]


def test_fixity_descends_to_the_damage(spark):
    rows = [(0, i * 5000, 5000, f"h{i}", i) for i in range(300)] + [(1, 0, 10, "z", 900)]
    one = spark.createDataFrame(rows, "archive int, offset long, length long, hash string, page_id long")
    other = one.where("page_id NOT IN (7, 299)").withColumn("hash", F.when(F.col("page_id") == 123, "other").otherwise(F.col("hash")))
    got = {r.page_id: r.status for r in fixity.audit(one, other, ["page_id"]).collect()}
    assert got == {7: "missing", 299: "missing", 123: "changed"}
    assert fixity.audit(one, one, ["page_id"]).count() == 0
    assert fixity.audit(other, one, ["page_id"]).where("status = 'extra'").count() == 2


def test_sketches_keep_links_at_the_threshold():
    rng, kept = np.random.default_rng(2), 0
    for _ in range(300):
        items = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.unique(items[:925]), np.unique(items[75:])  # 850 of 1000
        x, y = near_dedup.minwise(a), near_dedup.minwise(b)
        kept += int((x == y).sum()) >= near_dedup.AGREE
    assert kept == 300


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body>
<header><p>site</p></header><div id="sidebar-left"><p>side words here</p></div><nav><ul><li>menu</ul></nav>
<main><h1>Title &lt;one&gt;</h1><p>First&nbsp;para <b>bold</b>
 text<p>Second <i>para</i></p><aside>skip me</aside><div class="ad">buy</div><ul><li>item</li></ul>
<section class="comments"><p>reader says</p></section></main><form><input><p>form</p></form><footer>foot</footer>"""


def test_main_text_of_another_template(spark):
    pages = spark.createDataFrame([(PAGE,)] * 3, "html string")
    want = "Title <one>\nFirst para bold text\nSecond para\nitem"
    assert html_text.main_text(PAGE, html_text.learn(pages)) == want
    bare = PAGE.replace("main>", "div>")
    assert "Second para" in html_text.main_text(bare, html_text.Weights()) and "menu" not in html_text.main_text(bare, html_text.Weights())


@settings(max_examples=100, deadline=None)
@given(st.text("<>/ap!-\"' =&;x\n", max_size=60))
def test_any_markup_is_read(page):
    assert isinstance(html_text.main_text(page, html_text.Weights()), str)


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 1.0, "vequ*": 0.5})
    kinds = lambda t: {k for k in range(toxicity.MATCHES) if g.matches(t)[k] > 0}
    assert kinds("some idiot here") == {toxicity.BARE}
    assert kinds("you are an idiot") == {toxicity.TARGETED}
    assert kinds("that is not an idiot") == {toxicity.NEGATED}
    assert kinds("it said: the word idiot") == {toxicity.REPORTED}
    assert toxicity.THREATENED in kinds("i will kill them")
    assert toxicity.AFTER in kinds("idiot, you")
    assert kinds("not. idiot") == {toxicity.BARE}  # the clause ends
    assert kinds("vequabc") == {toxicity.BARE} and kinds("vequ") == set() and kinds("") == set()


def test_toxicity_learns_stems_and_holds_out(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfgmnp") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in rng.sample(range(60), 3):
                t[k] = "zorq" + rng.choice(words)
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, la)
    assert any(k.startswith("zorq") for k in model.lexicon)
    got = toxicity.score(d, model).join(la, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    right = got.where((F.col("score") >= 0.3).cast("int") == F.col("toxic")).count()
    assert right / got.count() > 0.98
