"""The queries opN_<name> over whole tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, language_id, lm_scoring, mixing, ngram_jaccard, oracles, packing, quality_rules, ranked_search, secret_scan, sharding, substring_dedup, token_output
from .shared import crc32_of_id, cut, read as read_table, small_batches


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, table)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    counts = [secret_scan.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    narrow = read(spark, sf_dir, "documents").select("doc_id", sharding.text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.assign(narrow, sharding.N_SHARDS, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = cut(read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    out = mixing.copies(narrow, size_col="size")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.report(docs).select("doc_id", *quality_rules.FIGURES, "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences_removed", "n_words_removed", F.col("clean_text").alias("text"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    again = fill_in_middle.restored(F.col("fim_text"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("fim_text")).alias("output_sha256"), sha(again).alias("restored_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces, sequences = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return digest.join(sequences, "sequence_id").select(*digest.columns, "size", "step")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_secret_scan, op4_sharding, op5_mixing, op6_decontamination, op7_quality_rules, op8_substring_dedup, op9_lm_scoring, op10_token_output, op11_fill_in_middle, op12_packing, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": oracles.OP1, "op4_sharding": oracles.OP4, "op5_mixing": oracles.OP5, "op6_decontamination": oracles.OP6, "op7_quality_rules": oracles.OP7, "op11_fill_in_middle": oracles.OP11, "op13_ranked_search": oracles.OP13}
