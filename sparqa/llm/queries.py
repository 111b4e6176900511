"""The registered queries of the ten operators, over whole tables, with their
production parameters; results as the contracts fix them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, exact_dedup, licenses, mixing, near_dedup, pii, prefix_trie, quality_model, quality_rules, ranked_search, sharding,
    substrings, urls,
)

#: target shares of the named sources; the others share the rest in proportion to their rows
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.05}
MIX_EPOCHS, MIX_SEED = 1.0, 20
SHARDS, SHARD_SEED = 40, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", "source", "text", "mean_rate", "n_copies", "copy", "order_key")


def op3(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def places(spans):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def terms(kind):
        return places(F.filter("terms", lambda s: s["kind"] == kind))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.array_join(places("base"), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"),
                        F.array_join(F.concat(places("base"), terms("generalise"), terms("remove")), ",").alias("spans"))


def op4(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn(
        "spans", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["first_word"].cast("string"), m["last_word"].cast("string"), m["errors"].cast("string"))), ",")).drop("matches")


def op5(spark, sf_dir):
    return shards_digest(sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, SHARD_SEED))


def shards_digest(sharded: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7(spark, sf_dir):
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "near_sha256")


def op8(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), every=20, most=4)


def op12(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1, "op2_poisson_mixing": op2, "op3_pii_sanitisation": op3, "op4_license_scan": op4,
    "op5_external_shuffle": op5, "op6_substring_dedup": op6, "op7_benchmark_decontamination": op7,
    "op8_compression_quality": op8, "op9_url_filter": op9, "op10_quality_outliers": op10,
    "op11_conversation_trie": op11, "op12_ranked_search": op12, "op13_exact_dedup": op13,
}
