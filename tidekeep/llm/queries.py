"""The registered queries of this package: opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.llm import chat_format, kdtree, line_dedup, mixing, ngram_model, packing, quality_rules, simhash, sql, toxicity, url_filter
from tidekeep.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document in the mix: its pass, block and order, with its source's weight.

    The weights have 0.995 of the greatest entropy, and the budget is one and a half times the corpus's tokens.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = mixing.plan(docs, min_entropy=0.995, max_passes=None, budget_percent=150)
    rows = mixing.mix(docs.select("doc_id", "source"), planned)
    weights = planned.select(F.col("mix_source").alias("_of"), "exponent", F.round("weight", 9).alias("weight"), "quota")
    named = rows.withColumn("_key", F.coalesce("source", F.lit(mixing.NONE)))
    return named.join(weights, F.col("_key") == F.col("_of")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "exponent", "weight", "quota")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a fifth of the documents, by crc32 of the id, are held out; a document without an id is in no fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(5)) == 0
    labels = read(spark, sf_dir, "labels").where(~out(F.col("doc_id")))
    scored = toxicity.score(docs, *toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "hits", "misspelled")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the first line of its class of near-equal lines."""
    return line_dedup.classes(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: what the list of rules says of the pages that it judges; the mined rules judge the others."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, url_filter.listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "mined")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, on this machine as on the executors'."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(read(spark, sf_dir, "documents"), tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).select(*quality_rules.COLUMNS)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted text: documents labelled of good quality."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("trusted"))
    return ngram_model.classify(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), labels)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat_format.digests(chat_format.formatted(rows, tokenizer("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": sql.MIXING,
    "op3_exact_top_k": sql.TOP_K,
    "op8_quality_rules": sql.QUALITY,
    "op10_chat_format": sql.CHAT,
}
