"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import convtrie, fertility, linededup, mixing, neardup, pieces, secrets, sharding, spelling, substring, tokenfile, topk, urlfilter
from . import vocabularies as v
from .oracle import ORACLE_SQL


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(read_table(spark, sf_dir, "documents"), v.WORD_BPE)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicate_spans(read_table(spark, sf_dir, "documents")).drop("spans", "factors")


def op6_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(read_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(read_table(spark, sf_dir, "documents"), v.PIECES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"), 24)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read_table(spark, sf_dir, "documents"), v.PIECES, v.BYTE_RANKS, v.BYTE_PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(read_table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie_of(convtrie.with_openings(convtrie.turn_lists(read_table(spark, sf_dir, "conversations"))))


#: Entries of the query's filter.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict")


def misspelt(runs: DataFrame) -> DataFrame:
    """``word`` of every run; where 97 divides the crc32 of ``<doc_id>:<run>``, a letter that it names is missing.  A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select("run", h.alias("h")).select(word.alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(read_table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(spelling.counted(misspelt(runs)))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_token_id_output": op2_token_id_output,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing_to_targets": op6_mixing_to_targets,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_url_filters": op12_url_filters,
    "op13_spelling_variants": op13_spelling_variants,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
