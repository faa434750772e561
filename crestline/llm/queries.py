"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import centroids, common, decontamination, fingerprints, fixity, html_text, near_dedup, oracles, piece_codec, quality, ranking, sharding, token_counts, token_store, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHARDS, TOKEN_LIMIT, END_ID, TOXIC, GOOD = 16, 1024, 2, 0.3, 0.3


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of SHARDS shards near equal in bytes, equal texts together."""
    return sharding.shard_texts(common.documents(spark, sf_dir), SHARDS)


#: Of the replica's records, by the md5 of the page_id: the first hexadecimal digits that mark changed ones (in the last byte),
#: and among them longer, lost and such as have an extra record after them instead.
CHANGED, LONGER, EXTRA, LOST = "0", "0d", "0e", "0f"


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of all pages, archived as WARC records, against the original: where it is damaged.

    The replica is an archive of its own: records marked by CHANGED end in another byte, those by LONGER
    have one more, those by EXTRA are whole but followed by a record that the original lacks, and those by
    LOST are left out; so its offsets differ. Null and repeated pages are records like others.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = [F.col("page_id"), F.col("url"), F.col("html")]
    record, revisit = fixity.warc_record(*page), fixity.warc_record(*page, kind="revisit")
    mark = F.coalesce(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit(""))
    cut = F.substring(record.cast("binary"), F.lit(1), F.octet_length(record) - 1)
    altered = F.when(mark.startswith(LONGER), F.concat(record, F.lit("~")).cast("binary")).when(mark.startswith(CHANGED) & ~mark.startswith(EXTRA), F.concat(cut, F.lit("~").cast("binary"))).otherwise(record.cast("binary"))
    extra = mark.startswith(EXTRA)
    narrow = pages.select(
        "page_id", F.sha2(record.cast("binary"), 256).alias("hash"), F.octet_length(record).cast("long").alias("length"), fixity.record_id(*page).alias("record"),
        F.when(~mark.startswith(LOST), F.sha2(altered, 256)).alias("replica_hash"), (F.octet_length(record) + mark.startswith(LONGER).cast("int")).cast("long").alias("replica_length"),
        F.when(extra, F.sha2(revisit.cast("binary"), 256)).alias("extra_hash"), F.when(extra, F.octet_length(revisit).cast("long")).alias("extra_length"), F.when(extra, fixity.record_id(*page, kind="revisit")).alias("extra_record"),
    )
    placed = fixity.in_archives(narrow, ["page_id", "hash"])
    original = placed.select("archive", "place", "length", "hash", "record", "page_id")
    kept = placed.where("replica_hash IS NOT NULL").select("archive", "place", F.lit(0).alias("after"), F.col("replica_length").alias("length"), F.col("replica_hash").alias("hash"), "record", "page_id")
    added = placed.where("extra_hash IS NOT NULL").select("archive", "place", F.lit(1).alias("after"), F.col("extra_length").alias("length"), F.col("extra_hash").alias("hash"), F.col("extra_record").alias("record"), "page_id")
    replica = kept.unionByName(added).withColumn("place", F.struct("place", "after")).drop("after")
    found = fixity.audit(fixity.lay_out(original), fixity.lay_out(replica), ["page_id"], record="record")
    return found.select("page_id", "archive", "offset", "length", "status", "hash_one", "hash_other")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and of its half-edited text, and how alike they and the next document's are."""
    return fingerprints.compare_with_next(common.documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they pass a context of TOKEN_LIMIT."""
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs, BYTE_BPE)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any window of any benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.report(decontamination.matches(common.documents(spark, sf_dir), items))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, and the one of each that is kept."""
    return near_dedup.near_duplicates(common.documents(spark, sf_dir), near_dedup.PERCENT)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids as byte planes in ascending doc_id, read the files back, describe each document from them."""
    path = common.scratch(spark, "token-store")
    token_store.write(common.documents(spark, sf_dir), path, BYTE_BPE, END_ID, plane="byte")
    return token_store.read(spark, path, plane="byte")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.learn(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text with begin and end ids, decode it again, and give digests of both."""
    return piece_codec.encode_decode(common.documents(spark, sf_dir), PIECE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels are learned only from rows that are not held out."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality; labels are learned only from rows that are not held out."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranking.rank(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of 40 centroids of every embedding after five rounds, and the inertia of its cluster and of all."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {"op1_sharding": op1_sharding, "op2_warc_fixity": op2_warc_fixity, "op3_fingerprints": op3_fingerprints, "op4_token_counts": op4_token_counts, "op5_decontamination": op5_decontamination, "op6_near_dedup": op6_near_dedup, "op7_token_store": op7_token_store, "op8_html_text": op8_html_text, "op9_piece_codec": op9_piece_codec, "op10_toxicity": op10_toxicity, "op11_quality": op11_quality, "op12_ranked_search": op12_ranked_search, "op13_centroids": op13_centroids}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": oracles.WARC_FIXITY, "op5_decontamination": oracles.DECONTAMINATION, "op6_near_dedup": oracles.NEAR_DEDUP, "op12_ranked_search": oracles.RANKED_SEARCH, "op13_centroids": oracles.CENTROIDS}
