"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.llm import licences, oracles
from terralode.llm.bpe import decode_ids, encode_texts
from terralode.llm._shared import scratch_dir
from terralode.llm.conversations import damaged, repair_conversations, report_repairs
from terralode.llm.decontaminate import find_leaks
from terralode.llm.html import extract_main_text
from terralode.llm.langid import held_out, identify_language, learn_profiles
from terralode.llm.manifest import folded, merkle_manifest, proof_digest
from terralode.llm.nearest import largest_inner_products
from terralode.llm.neardup import near_duplicates
from terralode.llm.packing import pack_documents
from terralode.llm.substrings import remove_repeated_passages
from terralode.llm.urlfilter import judge_urls
from terralode.llm.warc import read_archives, write_archives

#: Rules by host and path, and globs over ".host#path" for urls that no rule fits.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URL_GLOBS = ["*.spam-*#*", "*cheap-pills*#*", "*#*/wp-login.php", "*#*/trackback/?*"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return identify_language(docs, learn_profiles(docs.where(~held_out())), ["doc_id", held_out().alias("held_out")])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/terralode/warc-{uuid.uuid4().hex}"
    write_archives(_read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return largest_inner_products(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(_read(spark, sf_dir, "documents"))
    return found.withColumn("line_licences", F.array_join("line_licences", ","))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "".join(map(chr, range(65, 91)))
    marked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    text = F.when(F.col("doc_id").isNotNull() & marked, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    out = merkle_manifest(_read(spark, sf_dir, "documents"), tampered={"text": text})
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("proof"), F.col("claimed")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_repairs(repair_conversations(damaged(_read(spark, sf_dir, "conversations"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode_ids(encode_texts(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_minhash_neardup, op2_substring_dedup, op3_language_id, op4_benchmark_decontamination, op5_warc_roundtrip,
        op6_nearest_neighbours, op7_html_main_text, op8_sequence_packing, op9_licence_digests, op10_url_filter,
        op11_merkle_manifest, op12_conversation_repair, op13_byte_bpe, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op9_licence_digests": oracles.licence_digests(),
        "op10_url_filter": oracles.URL_FILTER,
        "op11_merkle_manifest": oracles.merkle_manifest(),
        "op12_conversation_repair": oracles.conversation_repair(),
    }
