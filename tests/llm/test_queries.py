"""Each registered corpus query over tables with every odd case, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from crestline.llm import near_dedup, queries

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows(nasty):
    return [(r.doc_id, r.text) for r in nasty.collect()]


def run(spark, written, name):
    return queries.queries()[name](spark, written["nasty"]).collect()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, written, name):
    df = queries.queries()[name](spark, written["empty"])
    assert df.count() == 0 and df.columns


def test_op1_shards(spark, written, rows):
    got = run(spark, written, "op1_sharding")
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 16 for r in got)
    where = {}
    for r in got:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    shared = [s for s in loads if len({(r.size, r.text_crc32) for r in got if r.shard == s}) > 1]  # others hold one large group
    assert len(shared) > 8 and max(loads[s] for s in shared) - min(loads[s] for s in shared) <= 100


def test_op3_fingerprints(spark, written, rows):
    got = run(spark, written, "op3_fingerprints")
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    found = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    assert found == want
    prints = {}
    text = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.doc_id is None or prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert all(r.near_next == 1 for r in got if 201 <= (r.doc_id or 0) <= 208)


def test_op4_and_op7_match_the_library(spark, written, rows):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    want = Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in rows)
    assert Counter(tuple(r) for r in run(spark, written, "op4_token_counts")) == want
    got = sorted(run(spark, written, "op7_token_store"), key=lambda r: r.start)
    crc = lambda t: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*ids(t), 2]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids(t)) + 1, crc(t)) for i, t in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def brute_windows(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for k, t in items:
        w = word.findall(t.translate(LOWER)) if t else []
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if k is None else str(k))
    for i, t in rows:
        w = word.findall(t.translate(LOWER)) if t else []
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= ids
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op5_decontamination(spark, written, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{written['nasty']}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in run(spark, written, "op5_decontamination")) == Counter(brute_windows(rows, items))


def brute_components(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall(t.translate(LOWER)) if t else []
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    for i, (k, _) in enumerate(rows):
        c = least.get(find(i))
        yield k, len(sets[i]), c, k == c


@pytest.mark.parametrize("leaf, part", [(2048, 2048), (4, 3)])
def test_op6_components(spark, written, rows, monkeypatch, leaf, part):
    """Also with bounds so small that groups stay large, blocks are compared by nodes and nodes by parts."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "PART", part)
    assert Counter(tuple(r) for r in run(spark, written, "op6_near_dedup")) == Counter(brute_components(rows))


def test_op8_pages(spark, written):
    got = Counter((r.page_id, r.text, r.n_chars) for r in run(spark, written, "op8_html_text"))
    assert got == Counter([(1, "Head\nSome & words\nmore", 22), (2, "", 0), (3, "", 0), (1, "only", 4), (None, "no tags at all", 14)])


def test_op9_matches_the_library(spark, written, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in run(spark, written, "op9_piece_codec")) == want


def test_op10_scores_every_row_alike(spark, written, rows):
    got = run(spark, written, "op10_toxicity")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_pipeline_stages(spark, written, nasty, nothing):
    import corpus_pipeline

    docs = spark.read.parquet(f"{written['nasty']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, written["nasty"])
        assert out.columns == docs.columns, name
    kept = corpus_pipeline.drop_near_copies(spark, docs, written["nasty"]).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    filled = [(k, i) for k, (i, t) in enumerate(rows) if t and word.search(t)]
    assert sum(bool(r.text and word.search(r.text)) for r in kept) == len({c for c in _classes(rows, filled)})
    assert sum(not (r.text and word.search(r.text)) for r in kept) == len(rows) - len(filled)
    clean = corpus_pipeline.drop_contaminated(spark, docs, written["nasty"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{written['nasty']}/benchmark.parquet").collect()]
    assert clean.count() == sum(not x[-1] for x in brute_windows(rows, items))
    assert corpus_pipeline.run(spark, written["empty"]).count() == 0
    whole = corpus_pipeline.run(spark, written["nasty"])
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < whole.count() < docs.count()


def _classes(rows, filled):
    named = list(brute_components([(k, rows[k][1]) for k, _ in filled]))
    return [c for _, _, c, _ in named]
