"""The registered queries of this package, one per operator, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import pin

from . import sql
from .compression import compress, digest
from .decontamination import contaminated
from .line_dedup import drop_boilerplate
from .mixing import mix
from .near_dup import near_duplicates
from .pii import BASE as PII_KINDS
from .pii import count_of, find_personal_data, span_list
from .quality import POLICIES, ledger, verdict
from .quotes import link_quotes
from .repeats import remove_repeats
from .token_counts import count_tokens
from .toxicity import HELD_OUT, fold, learn_and_score
from .url_filter import judge_urls
from .whitening import whiten
from .workers import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(pin(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, dropped="n_dropped_lines").select("doc_id", "text", "n_dropped_lines")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


#: The rules of the query.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = learn_and_score(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *(count_of(base, k.name).alias(f"n_{k.name}") for k in PII_KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "slot", "position")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, current = POLICIES[0], POLICIES[-1]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(base)).alias("base_failed"),
        verdict(current).alias("kept"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is a long, null where it does not fit; ``exact_deviation`` then has it."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumns({"exact_deviation": F.col("deviation"), "deviation": F.col("deviation").try_cast("bigint")})


def op12_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_url_filter": op3_url_filter,
    "op4_minhash_near_dedup": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_source_mixing": op8_source_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_compression": op12_vector_compression,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op3_url_filter": sql.URL_FILTER,
    "op4_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op9_decontamination": sql.DECONTAMINATION,
    "op10_quality_rules": sql.QUALITY,
    "op12_vector_compression": sql.VECTOR_COMPRESSION,
    "op13_suffix_array_dedup": sql.EARLIER_PASSAGES,
}
