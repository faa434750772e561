import random

import pytest

#: Clashing names that operators use inside.
EXTRA = "bucket int, `row` long, n long, y int, shard int, size int, score double, node long, halo int, tokens string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def with_extra(rows):
    return [(i, t, "en", "hot", len(t or ""), 1, 2, 3, 4, 5, 6, 0.5, 7, 8, "x") for i, t in rows]


def nasty_rows():
    """Nulls, empty and blank texts, repeated rows, equal texts, near copies, odd characters, one very long text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(1, 120))) for i in range(40)]
    base = prose(150).split()
    for k in range(12):  # near copies: one word changed
        w = list(base)
        w[10 * k + 3] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[3][1]) for k in range(9)]  # equal texts
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, None), (304, "a"), (305, "one two three"), (306, "One  two\tTHREE")]
    rows += [(310, "naïve café — 日本語テキスト 😀 it's we'll 12345 <|endoftext|> <s> x\x00y▁z"), (311, "''s 's  '\n\n 're\r\n"), (312, "x" * 3000)]
    rows += [(320, prose(30_000))]
    rows += [rows[0], rows[0], (None, "row without an id"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(with_extra(nasty_rows()), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def written(spark, nasty, nothing, tmp_path_factory):
    """Folders of tables: nasty, and empty."""
    out = {}
    pages = [(1, "u", "<html><body><nav><a>menu</a></nav><article><h1>Head</h1><p>Some &amp; words<br>more</p></article><footer>foot</footer></body></html>"), (2, None, None), (3, "v", ""), (1, "u", "<p>only"), (None, "w", "no tags at all")]
    bench = [(1, nasty_rows()[3][1]), (2, None), (3, ""), (4, "One two THREE"), (4, "One two THREE"), (None, "a")]
    vectors = [(i, [float((i * j) % 11) / 11 - 0.4 for j in range(64)]) for i in range(60)] + [(7, [0.25] * 64), (8, [0.25] * 64), (8, [0.25] * 64), (None, [0.1] * 64)]
    vectors += [(61, None), (62, []), (63, [0.5] * 63), (64, [0.5] * 65), (65, [None] + [0.5] * 63), (66, [float("nan")] * 64), (67, [float("inf")] + [0.0] * 63), (68, [1e30] + [-3e38] * 63)]
    labels = [(i, 1, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (5, 0, None)]
    for name, docs in (("nasty", nasty), ("empty", nothing)):
        d = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{d}/documents.parquet")
        cut = slice(None) if name == "nasty" else slice(0, 0)
        spark.createDataFrame(pages[cut], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame(bench[cut], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(*v, 1, 2, 3) for v in vectors[cut]], "vec_id long, embedding array<float>, label int, `cluster` int, distance int").write.parquet(f"{d}/embeddings.parquet")
        spark.createDataFrame(labels[cut], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out[name] = d
    return out
