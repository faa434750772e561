"""The audit of two archives with offsets of their own against plain Python, and the descent."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crestline.llm import fixity, queries


def sha(kind, data):
    return hashlib.new(kind, data).hexdigest()


def plain_audit(pages):
    """The rows of the query by loops over whole archives."""

    def record(i, url, body, kind):
        u, b = (url or "").encode(), (body or "").encode()
        rid = "urn:sha1:" + sha("sha1", ("" if i is None else str(i)).encode() + u + b) + ("" if kind == "resource" else ":" + kind)
        return rid, b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: %s\r\nWARC-Record-ID: <%s>\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), u, rid.encode(), len(b), b)

    made = sorted(((i is not None, i or 0, sha("sha256", record(i, u, b, "resource")[1])), i, u, b) for i, u, b in pages)
    out = Counter()
    for start in range(0, len(made), fixity.ARCHIVE_RECORDS):
        one, other, at, there = [], [], 0, 0
        for _, i, u, b in made[start : start + fixity.ARCHIVE_RECORDS]:
            mark = "" if i is None else sha("md5", str(i).encode())
            rid, rec = record(i, u, b, "resource")
            one.append((rid, at, len(rec), sha("sha256", rec), i))
            at += len(rec)
            new = [] if mark.startswith("0f") else [(rid, rec + b"~" if mark.startswith("0d") else rec[:-1] + b"~" if mark.startswith("0") and not mark.startswith("0e") else rec)]
            new += [record(i, u, b, "revisit")] if mark.startswith("0e") else []
            for rid, rec in new:
                other.append((rid, there, len(rec), sha("sha256", rec), i))
                there += len(rec)
        left, right = Counter(), Counter()
        a = {(r[0], left.update([r[0]]) or left[r[0]]): r for r in one}
        b = {(r[0], right.update([r[0]]) or right[r[0]]): r for r in other}
        for k in a.keys() | b.keys():
            x, y = a.get(k), b.get(k)
            if (x and x[3]) != (y and y[3]):
                near = x or y
                out[near[4], start // fixity.ARCHIVE_RECORDS, near[1], near[2], "missing" if y is None else "extra" if x is None else "changed", x and x[3], y and y[3]] += 1
    return out


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    rng = random.Random(8)
    pages = [(i, rng.choice([f"http://h/{i}", None]), rng.choice(["é" * rng.randint(0, 900), "x" * rng.randint(0, 4000), None, ""])) for i in range(3000)]
    pages += [pages[5]] * 3 + [(7, "u", "another with that id"), (None, None, None), (None, "v", "no id"), (None, "v", "no id"), (9000, "big", "<p>" * 700_000)]
    folder = str(tmp_path_factory.mktemp("archived"))
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, archive int, record string").repartition(5)
    df.write.parquet(f"{folder}/pages.parquet")
    return folder, pages


def test_the_query_equals_plain_loops(spark, archived):
    folder, pages = archived
    got = queries.op2_warc_fixity(spark, folder).collect()
    want = plain_audit(pages)
    assert Counter(tuple(r) for r in got) == want
    kinds = Counter(r.status for r in got)
    assert min(kinds["changed"], kinds["missing"], kinds["extra"]) > 3 and len({r.archive for r in got}) == 3


def test_archives_are_numbered_exactly(spark, archived, monkeypatch):
    monkeypatch.setattr(fixity, "ARCHIVE_RECORDS", 100)
    rows = spark.createDataFrame([(i % 7 if i % 3 else None, str(i * 37 % 1001)) for i in range(1000)], "k long, h string").repartition(6)
    got = fixity.in_archives(rows, ["k", "h"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and all(r.archive == r.place // 100 for r in got)
    order = [(r.k is not None, r.k or 0, r.h) for r in got]
    assert order == sorted(order)
    same = spark.range(5000).select(F.lit(None).cast("long").alias("k"), F.lit("z").alias("h"))  # rows that are all equal are spread
    placed = fixity.in_archives(same, ["k", "h"])
    assert placed.select("place").distinct().count() == 5000 and placed.select("archive").distinct().count() == 50


def test_records_that_only_moved_are_no_damage(spark):
    rows = [(0, p, 1000 + p % 7, f"h{p}", f"r{p}") for p in range(400)]
    one = spark.createDataFrame(rows, "archive long, place long, length long, hash string, record string")
    lost = one.where("place <> 3")
    got = fixity.audit(fixity.lay_out(one), fixity.lay_out(lost), ["record"], record="record").collect()
    assert [(r.record, r.status) for r in got] == [("r3", "missing")]
    back = fixity.audit(fixity.lay_out(lost), fixity.lay_out(one), ["record"], record="record").collect()
    assert [(r.record, r.status, r.length) for r in back] == [("r3", "extra", 1003)]


def test_only_branches_that_differ_are_descended(spark, monkeypatch):
    """Of 4,000 ranges, one is suspect: each level hands on the children of one node."""
    rows = [(0, i * 65_536, 65_536, f"h{i}", i) for i in range(4000)]
    one = spark.createDataFrame(rows, "archive long, offset long, length long, hash string, page_id long")
    other = one.withColumn("hash", F.when(F.col("page_id") == 1234, "bad").otherwise(F.col("hash")))
    seen, plain = [], fixity.differing
    monkeypatch.setattr(fixity, "differing", lambda a, b, within: seen.append((None if within is None else within.count(), (out := plain(a, b, within)).count())) or out)
    assert [r.page_id for r in fixity.audit(one, other, ["page_id"]).collect()] == [1234]
    assert seen == [(None, 1), (1, 1), (1, 1), (1, 1)]
    a, b = fixity.tree(one), fixity.tree(other)
    assert len(a) == 4 and a[-1].count() == 1 and a[-1].first().hash != b[-1].first().hash
    low = hashlib.sha256(b"80871424:65536:h1234").hexdigest()
    assert a[0].where("node = 1234").first().hash == low
