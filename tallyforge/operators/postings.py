"""Substring search by trigram postings with positions.

Every position of a text begins a trigram (two marks follow the text's end), and a row of the index holds a
trigram, a key and the trigram's positions in that key's text. The trigrams of a needle must stand at
consecutive places, so postings alone settle whether a text contains it; needles of one or two characters
are the postings that begin with them. The index is written in order of (trigram, key): a search reads the
row groups of its trigrams, and a trigram that most texts hold is spread over many files.

Defined results: a null text contains nothing; an empty needle is in every other text; needles and texts
are compared without case, as by lower().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "\x00"
_DDL = "gram string, key {kind}, at array<int>"


def write_postings(df: DataFrame, key: str, text: Column, folder: str) -> None:
    """Write the index of a unique key and its text to a new folder."""
    rows = df.select(F.col(key).alias("key"), F.lower(text).alias("_t")).filter("_t is not null")
    padded = F.concat("_t", F.lit(_END * 2))
    grams = F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.struct(F.substring(padded, i, F.lit(3)).alias("gram"), (i - 1).alias("i")))
    each = rows.filter("_t <> ''").select("key", F.explode(grams).alias("g")).select("g.gram", "key", "g.i")
    # The empty trigram stands for the text itself.
    each = each.unionByName(rows.select(F.lit("").alias("gram"), "key", F.lit(0).alias("i")))
    index = each.groupBy("gram", "key").agg(F.array_sort(F.collect_list("i")).alias("at"))
    index.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(folder)


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def containing(postings: DataFrame, needle: str) -> DataFrame:
    """The keys whose text contains the needle."""
    needle = needle.lower()
    if not needle:
        return postings.filter("gram = ''").select("key")
    if len(needle) < 3:
        return postings.filter(F.col("gram").startswith(needle)).select("key").distinct()
    grams: dict[str, list[int]] = {}
    for i in range(len(needle) - 2):
        grams.setdefault(needle[i : i + 3], []).append(i)
    places = F.create_map(*[x for gram, at in grams.items() for x in (F.lit(gram), F.array(*map(F.lit, at)))])
    met = postings.filter(F.col("gram").isin(*grams))
    starts = F.flatten(F.transform("at", lambda p: F.transform(F.element_at(places, F.col("gram")), lambda i: p - i)))
    begun = met.select("key", F.explode(starts).alias("start")).filter("start >= 0").groupBy("key", "start").agg(F.count("*").alias("n"))
    return begun.filter(F.col("n") == len(needle) - 2).select("key").distinct()
