"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, filter_audit, fingerprint, lm, media, mixing, neardup, quality, search, suffix_dedup, token_files, toxicity
from .common import held_out, read, written


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.judged(docs, (suffix_dedup.PASSAGE, suffix_dedup.LENGTH)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    stems = toxicity.induced(docs, labels, ~held_out(5))
    matched = written(toxicity.matches(docs, stems), "op5-matches")
    learned = toxicity.weights(matched, labels, ~held_out(5))
    return toxicity.scored(matched, learned).select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents").select("doc_id", "text"), held_out(10))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out(5))
    return quality.score(docs, trees).select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), most=50)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.described(chat.formatted(chat.log_of(conversations.unionByName(chat.planted(spark)))))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as sequences: each page, and a figure that refers to the payload of its url; the texts in order, and what the store resolves."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    stored = written(media.store(pages.select(F.col("url").alias("text"))), "page-media", "zstd")
    figure = F.concat(F.lit("<figure><img src='"), F.sha2(F.lit("").cast("binary"), 256), F.lit("'></figure><figure><img src='media:sha256:"), media.digest_of(F.col("url")), F.lit("'><figcaption>"), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    found = media.interleaved(pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), figure).alias("html")), media.described(stored))
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    resolved = F.filter("items", lambda x: x["media"]["payload_bytes"].isNotNull())
    last = F.get(resolved, F.lit(0))
    return found.select("page_id", F.size("items").alias("n_items"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("texts_sha256"), F.size(resolved).alias("n_resolved"), last["caption"].alias("caption"), last["position"].alias("position"), last["media"]["payload_bytes"].alias("payload_bytes"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_lm": op9_lm,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_formatting": op13_chat_formatting,
    "page_sequences": page_sequences,
}
ORACLE = {"op7_mixing": mixing.SQL, "op11_ranked_search": search.SQL, "op12_filter_audit": filter_audit.SQL, "op13_chat_formatting": chat.SQL}
