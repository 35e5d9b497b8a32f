"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import chat_quotes, decontam, html_extract, line_dedup, merkle, multiset_fp, piece_codec, ranked_search, secret_scan, simhash_vp, token_count, token_store, toxicity
from inkveil.llm._common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the package that brings them is found at run time."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "host", "n_template_nodes", "n_template_chars", "n_hint_chars")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link_quotations(table(spark, sf_dir, "conversations"))


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations with quotations of earlier messages put in: the given ones quote nothing."""
    return spark.sql(chat_quotes.QUOTED, conversations=table(spark, sf_dir, "conversations"))


def chat_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link_quotations(quoted(spark, sf_dir))


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.build_conversations(chat_quotes.link_quotations(quoted(spark, sf_dir)))


def op6_simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fp.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.to_json("spans").alias("removal_spans"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_page_text, op3_token_shards, op4_sentence_pieces, op5_chat_replies, op6_simhash_neighbours, op7_secret_spans, op8_token_counts, op9_multiset_fingerprints, op10_benchmark_overlap, op11_ranked_search, op12_merkle_manifest, op13_line_dedup, chat_quoted_replies, chat_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_replies": chat_quotes.ORACLE_SQL, "chat_quoted_replies": chat_quotes.QUOTED_SQL, "chat_conversations": chat_quotes.BUILT_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL, "op12_merkle_manifest": merkle.oracle_sql(), "op13_line_dedup": line_dedup.ORACLE_SQL}
