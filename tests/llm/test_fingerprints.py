"""Chunks and containment against plain loops, one scale at every length, hot and null doc_ids."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import common, fingerprints, queries, token_store

P = fingerprints


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrstß") for _ in range(rng.randint(2, 7))) for _ in range(n // 3 + 2))[:n]


def plain_chunks(data):
    """Chunks by a byte-wise gear hash and the rule of normalised chunking, one byte at a time."""
    gears, h, start, out = P._gears().tolist(), 0, 0, []
    hashes = []
    for b in data:
        h = ((h << 1) + gears[b]) & 0xFFFFFFFF
        hashes.append(h)
    at = 0
    while start < len(data):
        at += 1
        size = at - start
        last = at == len(data)
        bits = P.STRICT if size < P.WANTED else P.LOOSE
        cut = size >= P.LEAST and not (last and size == P.LEAST) and hashes[at - 1] & 0xFFFF < 1 << (16 - bits)
        if cut or size == P.MOST or last:
            out.append(bytes(data[start:at]))
            start = at
    return out


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_boundaries_equal_a_plain_loop(monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(1)
    for n in [*range(0, 60), 200, 1000, 5000]:
        data = prose(rng, n).encode()
        ends = P.boundaries(np.frombuffer(data, np.uint8), P.LEAST, P.WANTED, P.MOST, P.STRICT, P.LOOSE)
        cuts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(cuts) == data and cuts == plain_chunks(data)


def test_containment_equals_plain_sets():
    rng = random.Random(2)
    for _ in range(60):
        a = prose(rng, rng.randint(0, 600))
        cut = rng.randint(0, len(a))
        b = rng.choice([a[:cut] + "new" + a[cut:], a[cut:], prose(rng, 300), a + a, ""])
        own, other = Counter(plain_chunks(a.encode())), set(plain_chunks(b.encode()))
        size = sum(len(c) * n for c, n in own.items())
        want = sum(len(c) * n for c, n in own.items() if c in other) / size if size and other else float(not size and not other)
        assert P.containment(P.fingerprint(a), P.fingerprint(b)) == pytest.approx(want)
        assert (P.from_text(P.as_text(P.fingerprint(a))) == P.fingerprint(a)).all()


def test_no_step_at_any_length():
    """Where half of a text is kept, that half is found; texts that differ in one character are alike, whatever their lengths."""
    rng = random.Random(3)
    for n in [*range(80, 400, 3), *range(400, 3000, 97)]:
        text = prose(rng, n)
        near = P.containment(P.fingerprint(text), P.fingerprint(P.edited(text, prose(rng, n))))
        assert 0.25 <= near <= 0.6, n
        assert P.containment(P.fingerprint(text), P.fingerprint(text + "x")) >= 1 - (P.MOST + 1) / n
        assert P.containment(P.fingerprint(text), P.fingerprint("y" + text)) >= 1 - 120 / n  # until boundaries meet again
        assert P.containment(P.fingerprint(text), P.fingerprint(prose(rng, n))) < 0.1


def test_repeated_lines_count_as_often_as_they_stand():
    line, rest = "the same line again and again. ", prose(random.Random(4), 300)
    own = P.fingerprint(line * 20 + rest)
    assert P.containment(own, P.fingerprint(line * 20)) > 0.6


def test_digests_that_cover_much_count_in_full():
    """A digest's bytes have no upper bound: a text after a long run of one letter, and after many equal lines."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100_000))
    assert abs(P.containment(P.fingerprint("a" * 300_000 + text), P.fingerprint(text)) - 0.25) < 0.01
    line = "Permission is granted to use and copy this text as long as it is kept. "[:50]
    assert abs(P.containment(P.fingerprint(line * 20_000 + text), P.fingerprint(text)) - 1 / 11) < 0.01
    own = P.fingerprint("a" * 3_000_000 + text)
    assert (P.from_text(P.as_text(own)) == own).all() and int((own & np.uint64((1 << P.COVERED) - 1)).sum()) == 3_100_000


def test_a_fingerprint_is_shorter_than_its_text():
    rng = random.Random(10)
    for n in (100, 1000, 30_000):
        text = prose(rng, n)
        assert len(P.as_text(P.fingerprint(text))) < 0.95 * len(text)
    assert (P.from_text(P.as_text(P.fingerprint(""))) == P.fingerprint("")).all()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows without an id, a third with one id, the others with ids of their own."""
    rng = random.Random(6)
    rows = [(None if i % 3 == 0 else 500 if i % 3 == 1 else i, prose(rng, 30) + str(i)) for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_ranges_split_null_and_equal_keys(hot):
    got = common.with_bucket(hot, "doc_id", F.xxhash64("text"), rows=100)
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 400 and len(sizes) > 40
    spans = got.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("b")).orderBy("bucket").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:], strict=False))
    assert common.with_bucket(hot.limit(50), "doc_id", F.xxhash64("text")).select("bucket").distinct().count() == 1


def test_every_row_is_compared_once_with_hot_ids(spark, hot, monkeypatch):
    monkeypatch.setattr(common.with_bucket, "__defaults__", ("bucket", 100))
    got = P.compare_with_next(hot).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, P.as_text(P.fingerprint(r.text))) for r in hot.collect())
    copies, buckets = P.with_next(hot).where("halo = 1").count(), P.with_next(hot).select("bucket").distinct().count()
    assert copies < 2 * 4000 and buckets > 40  # a range of equal ids is copied once, for the range before it


def test_token_files_with_hot_ids_and_positions(spark, hot, monkeypatch, tmp_path):
    monkeypatch.setattr(common.with_bucket, "__defaults__", ("bucket", 100))
    path = str(tmp_path / "store")
    token_store.write(hot, path, queries.BYTE_BPE, 2)
    every = token_store.read(spark, path).orderBy("start").collect()
    assert len(every) == 6000 and [r.start for r in every] == np.cumsum([0] + [r.n_tokens for r in every[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in every]
    assert ids == sorted(ids)
    low, high = every[3000].start + 1, every[3010].start
    part = token_store.read(spark, path, positions=(low, high))
    assert sorted(part.collect()) == sorted(every[3000:3010])
    assert token_store.read(spark, path, positions=(10**12, 10**12 + 1)).count() == 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bucket" in plan and "LeftSemi" in plan  # only the chunks that the index names
