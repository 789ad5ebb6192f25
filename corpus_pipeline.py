"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage works on all rows its predecessor kept and all but the last return the columns of
documents: toxic documents go, lines that ten or more documents hold go, one document of each group of
near duplicates stays (the one with the smallest doc_id), contaminated documents go, the rest is
packed. Null and empty texts are kept as they are; a document whose every line is dropped stays with
an empty text; rows that repeat a doc_id are documents of their own, so only those whose texts are
near duplicates go; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_saved, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    from tallyforge.llm.toxicity import fit, score

    docs = docs.select(*COLUMNS)
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    return score(spark, docs, model, carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold."""
    from tallyforge.llm.line_dedup import dedupe_lines

    cleaned = dedupe_lines(spark, docs.select(*COLUMNS), min_docs=10, carry=("lang", "source"))
    return cleaned.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    The operator's own shingles of two words, which find more than five do. Every row is a document of
    its own here, whatever its doc_id, so the operator works on row numbers that are written down first.
    """
    from tallyforge.llm.near_dedup import near_duplicates

    rows = saved(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(spark, rows.select(F.col("_row").alias("doc_id"), "text"), width=2, percent=80)
    found = found.select(F.col("doc_id").alias("_row"), "component_id")
    shared = found.filter("_row <> component_id").select("component_id").distinct()
    members = rows.select("_row", "doc_id").join(found.join(shared, "component_id"), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    dropped = members.join(first, "component_id").filter("_row <> first._row").select("_row")
    return rows.join(dropped, "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    from tallyforge.llm.decontaminate import decontaminate

    checked = decontaminate(spark, docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), size=10, carry=COLUMNS)
    return checked.filter(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    from tallyforge.llm.packing import pack

    return pack(spark, docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has neither the models nor the tokenizer; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written out and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        if k:
            drop_saved(before)
    return STAGES[-1][1](spark, docs, sf_dir)
