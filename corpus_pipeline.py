"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, documents with
benchmark passages go, and what is left is encoded. Each stage's result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import common, decontamination, near_dedup, piece_codec, toxicity

#: Score from which on a document is toxic.
TOXIC = 0.3
#: Percent of Jaccard similarity of five-word shingles from which on documents are near copies (op6 has its own).
NEAR = 80
#: SQL cannot express the fitted score nor the codec; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """The name with as many underscores after it as docs' own columns ask for."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that name a row by its doc_id and text; rows equal in both share them."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under TOXIC; the model is learned from the labels that are not held out.

    Null, empty and blank texts score like a text without any match and stay; equal texts are judged alike,
    whatever their doc_ids; whole texts are read. Without labels of both kinds the seed words decide.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "__score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component at NEAR percent: the one with the least doc_id, nulls last.

    Of several texts with that doc_id the least by hash stays, of rows equal in doc_id and text one of them, so that a
    component always leaves one row. Null, empty and blank texts are in no component and all stay. Other
    columns come along and may have any name.
    """
    one, two = _keys(docs)
    keyed = docs.select("doc_id", "text", one.alias("__one"), two.alias("__two"))
    found = common.durable(near_dedup.near_groups(keyed, NEAR, ("__one", "__two")).where("group IS NOT NULL").drop("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__one", "__two")
    best = found.groupBy("group").agg(F.min(order).alias("best"))
    judged = found.groupBy("group", "__one", "__two").agg(F.count("*").alias("rows")).join(best, "group")
    judged = common.durable(judged.select("__one", "__two", "rows", ((F.col("best.__one") == F.col("__one")) & (F.col("best.__two") == F.col("__two"))).alias("stays")))
    here = lambda keys: (one == keys["__one"]) & (two == keys["__two"])
    gone, again = judged.where("NOT stays OR rows > 1"), judged.where("stays AND rows > 1")
    whole = docs.join(gone, here(gone), "left_anti")
    # of rows that are equal in doc_id and text, one
    a, b = _free(docs, "__one"), _free(docs, "__two")
    doubled = docs.join(again, here(again), "left_semi").withColumn(a, one).withColumn(b, two).dropDuplicates([a, b])
    return whole.select(*docs.columns).unionByName(doubled.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts, and all texts where the benchmark is empty, have none and stay. Rows are named by a hash of
    doc_id and text: null and repeated doc_ids, repeated rows and columns of any name are as good as others.
    """
    one, _ = _keys(docs)
    found = decontamination.matches(docs.select(one.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, one == gone["__gone"], "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left: a row for each row, null texts as empty ones, whatever other columns there are."""
    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_codec", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written, and the one before it is then deleted."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.discard(spark, before)
        before = path
    return docs
