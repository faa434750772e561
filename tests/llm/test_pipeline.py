"""Odd cases of each stage of the pipeline: nulls, repeats, ties, very long texts, clashing names, empty tables."""

import random
from collections import Counter

import corpus_pipeline as P
import pytest
from test_queries import brute_windows

LONG = "long words here " * 100_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b, c = prose(80), prose(80), prose(60)
    rows = [(5, a), (5, a), (5, a + " more"), (None, a), (9, a), (None, b), (None, b), (None, b + " more"), (3, c), (4, c + " x"), (3, c), (3, c + " y")]
    rows += [(20, None), (20, None), (None, None), (21, ""), (21, ""), (22, " \n"), (23, LONG), (24, LONG), (25, "one"), (26, "one")]
    table = [(*r, f"s{k}", 0.5, 1, 2, 3) for k, r in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, source string, __score double, __one long, __two_ long, group long").repartition(4)


def test_one_row_of_each_component_stays(spark, docs, tmp_path):
    got = P.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept <= Counter((r.doc_id, r.text) for r in docs.collect())
    blank = Counter({(20, None): 2, (None, None): 1, (21, ""): 2, (22, " \n"): 1})
    worded = kept - blank
    assert blank <= kept and all(n == 1 for n in worded.values())
    ids = sorted((i is None, i or 0) for i, _ in worded)
    assert ids == [(False, 3), (False, 5), (False, 23), (False, 25), (True, 0)] and set(worded) <= texts


def test_the_choice_does_not_depend_on_the_layout(spark, docs, tmp_path):
    rows = lambda df: sorted(str((r.doc_id, r.text and r.text[:50])) for r in P.drop_near_copies(spark, df, str(tmp_path)).collect())
    assert rows(docs.repartition(7, "source")) == rows(docs.coalesce(1))


def test_contaminated_rows_go_whatever_their_ids(spark, docs, tmp_path):
    items = [(1, docs.where("doc_id = 5").first().text), (2, "one"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.drop_contaminated(spark, docs, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(r for r, found in zip(rows, brute_windows(rows, items), strict=True) if not found[-1])
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_toxic_rows_go_and_blank_ones_stay(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad = spark.createDataFrame([(50, "you are an idiot. you stupid moron, you scum", "s", 0.1, 1, 2, 3)], docs.schema)
    got = P.drop_toxic(spark, docs.unionByName(bad).unionByName(bad), str(tmp_path))
    assert got.columns == docs.columns and Counter(str(r) for r in got.collect()) == Counter(str(r) for r in docs.collect())


def test_stages_of_empty_tables(spark, docs, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.encode_pieces(spark, docs, str(tmp_path)).count() == docs.count()


def test_a_name_that_is_taken_gets_another(docs):
    assert P._free(docs, "__score") == "__score_" and P._free(docs, "__two") == "__two" and P._free(docs, "__ONE".lower()) == "__one_"
