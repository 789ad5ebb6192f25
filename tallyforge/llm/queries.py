"""The registered queries of the training-data operators, with production parameters.

Each applies its operator to the whole of its table and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.chat_tree import format_chats, read_back

    text = "</s>[INST] ok [/INST]"
    columns = ("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(*format_chats(spark, table(spark, sf_dir, "conversations").select(*columns).unionByName(added)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyforge.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.near_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.warc import derivatives, responses_of_pages

    return derivatives(responses_of_pages(table(spark, sf_dir, "pages")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.line_dedup import dedupe_lines

    return dedupe_lines(spark, table(spark, sf_dir, "documents"), min_docs=10).drop("kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.decontaminate import decontaminate

    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(spark, docs, bench, size=10).drop("items")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.html_extract import extract_pages

    return extract_pages(spark, table(spark, sf_dir, "pages"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.fingerprint import fingerprints

    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.url_filter import filter_urls

    return filter_urls(spark, table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from tallyforge.llm.common import scratch
    from tallyforge.llm.token_files import read_tokens, write_tokens

    folder = scratch(spark, "token-files")
    write_tokens(spark, table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.common import scratch
    from tallyforge.llm.ranked_search import build_index, search

    folder = scratch(spark, "search-index")
    build_index(spark, table(spark, sf_dir, "documents"), folder)
    return search(spark, folder, table(spark, sf_dir, "benchmark"), k=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyforge.llm.merkle import leaves, manifest

    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(spark, leaves(table(spark, sf_dir, "documents"), {"text": text})).drop("path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_html_extract": op8_html_extract,
    "op9_fingerprint": op9_fingerprint,
    "op10_url_filter": op10_url_filter,
    "op11_token_files": op11_token_files,
    "op12_ranked_search": op12_ranked_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
