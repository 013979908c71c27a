"""The queries of this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import (
    bpe,
    centroids,
    common,
    exact_dedup,
    jaccard,
    langid,
    mixing,
    quality,
    repeats,
    sharding,
    simhash,
    topk,
    warc,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_dedup(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return repeats.cut_repeats(common.read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_sharding(spark, sf_dir):
    documents = common.read(spark, sf_dir, "documents")
    path = common.folder(spark, "shards")
    sharding.write_shards(documents, path, "doc_id", 8, seed=17)
    written = sharding.read_shards(documents, path)
    return sharding.manifest(written, "text", "doc_id", *sharding.ADDED).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(common.read(spark, sf_dir, "documents"))


@query
def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.similar(common.read(spark, sf_dir, "documents"))


@query
def op5_impact_topk(spark, sf_dir):
    embeddings = common.read(spark, sf_dir, "embeddings")
    return topk.search(embeddings, F.col("vec_id") % 50 == 0)


@query
def op6_warc(spark, sf_dir):
    pages = common.read(spark, sf_dir, "pages")
    path = common.folder(spark, "warc")
    warc.write_archives(warc.planned(pages), path)
    records = warc.read_archives(spark, path).where("kind = 'record'")
    response = F.col("record_type") == "response"
    return records.select(
        warc.page_of("record_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring("digest", 8, 64)).alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").cast("long").alias("refers_to"),
    )


@query
def op7_byte_bpe(spark, sf_dir):
    documents = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(documents).select(
        "doc_id",
        bpe.n_tokens().alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_quality(spark, sf_dir):
    documents = common.read(spark, sf_dir, "documents")
    labels = common.read(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1))
    stats = common.settle(quality.with_statistics(documents), "quality")
    held_out = langid.bucket(F.col("doc_id"), 5) == 0
    labelled = stats.where(~held_out).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    scored = quality.score(stats, quality.fit(labelled))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op9_langid(spark, sf_dir):
    documents = common.read(spark, sf_dir, "documents")
    held_out = langid.bucket(F.col("doc_id"), 4) == 2
    model = langid.fit_if_labelled(documents.where(~held_out), max_languages=None)
    return langid.predict(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query
def op10_mixing(spark, sf_dir):
    documents = common.read(spark, sf_dir, "documents")
    return mixing.mix(documents, temperature=0.5, seed=29).select(
        "doc_id",
        "source",
        F.col("_mix_copy").cast("int").alias("copy"),
        F.col("_mix_order").alias("order_key"),
        F.sha2(common.utf8("text").cast("binary"), 256).alias("text_sha256"),
    )


@query
def op11_simhash(spark, sf_dir):
    """Fingerprints and likenesses; every 20th id also asks for the documents within the radius."""
    marked = simhash.with_edited(common.read(spark, sf_dir, "documents"))
    searched = simhash.with_near(marked, F.col("_id") % 20 == 0)
    return searched.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        simhash.text_of("hi", "lo").alias("fingerprint"),
        simhash.text_of("edited_hi", "edited_lo").alias("edited_fingerprint"),
        simhash.likeness("hi", "lo", "edited_hi", "edited_lo").alias("near_edited"),
        simhash.likeness("hi", "lo", "next_hi", "next_lo").alias("near_next"),
        "n_near",
    )


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(common.read(spark, sf_dir, "embeddings"))


@query
def op13_centroids(spark, sf_dir):
    return centroids.cluster(common.read(spark, sf_dir, "embeddings"))
