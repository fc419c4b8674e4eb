"""Thin queries ``opN_...``: each applies one corpus operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm import binary, imatch, minhash, packing, quality, resampling, secrets, spelling, sqltext, substrings, toxicity, transducer, urls, warc
from cellshift.llm.catalog import query
from cellshift.llm.common import table


@query("op9_quality_rules", sqltext.QUALITY)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_secret_scan", sqltext.SECRETS)
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, with the digest of the base kinds' spans."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secrets.scan(docs)
    base = [rule.kind for rule in secrets.RULES if rule.base]
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["rule"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind) for kind in base],
        F.sha2(listed(F.filter("findings", lambda s: s["rule"].isin(*base))), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


@query("op1_minhash_near_dedup", sqltext.NEAR)
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document on 2-word shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


@query("op5_substring_dedup", sqltext.REPEATS)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat a 13-word window of an earlier document."""
    found = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Token pieces of all documents packed into sequences of 2048."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token-id files of all documents, written in order and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = binary.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_warc_archives", sqltext.ARCHIVES)
def op3_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload"))
    records = warc.archive_round_trip(spark, pages)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_imatch_fingerprints")
def op4_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their half-edited texts."""
    return imatch.compare_with_edits(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_url_verdicts")
def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Rule or model verdict on the URL of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


@query("op10_bpe_transducer")
def op10_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level ids of all documents, and their texts decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = transducer.encode_corpus(docs, path, with_text=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op11_importance_resampling", sqltext.RESAMPLED)
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document toward the texts of the benchmark."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, folder, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by the nearest labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")).filter(~toxicity.held_out())
    judged = toxicity.scores(docs, toxicity.learn(docs, labels))
    return judged.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op13_spelling_variants", sqltext.SPELLINGS)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its near words, its form and the root that forms lead to."""
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))
