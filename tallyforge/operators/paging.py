"""Keyset pages: a directory of bounds, and pages that begin after a cursor.

The directory says of each page its number, its number of rows and the last (value, key) in it. Building it
sorts the table once, in ranges. A page is then a range of (value, key), which the scan takes as a
filter, and nothing before it is read or counted. A cursor is the last (value, key) that the
reader has seen, so rows that come, go or tie between two pages are neither lost nor seen twice, and the
directory may be older than the table: it only says how far to read.

Values and keys aren't null; keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import checkpointed


def page_directory(df: DataFrame, value: str, key: str, size: int) -> DataFrame:
    """(page, rows, last_value, last_key): pages of `size` rows in order of (value, key), from 1."""
    ranged = checkpointed(df.select(F.col(value).alias("v"), F.col(key).alias("k")).repartitionByRange("v", "k").sortWithinPartitions("v", "k").withColumn("at", F.monotonically_increasing_id()))
    rows = ranged.withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    spans = spans.select("part", "first", before.alias("before"))  # a row a partition
    numbered = rows.join(F.broadcast(spans), "part").withColumn("page", F.floor((F.col("before") + F.col("at") - F.col("first")) / size) + 1)
    last = F.max(F.struct("v", "k"))
    return numbered.groupBy("page").agg(F.count("*").alias("rows"), last.alias("l")).select("page", "rows", F.col("l.v").alias("last_value"), F.col("l.k").alias("last_key"))


def _after(value: Column, key: Column, cursor: tuple) -> Column:
    """Beyond the cursor; the first condition is what a scan can skip row groups by."""
    v, k = (F.lit(x) for x in cursor)
    return (value >= v) & ((value > v) | (key > k))


def page_after(df: DataFrame, directory: DataFrame, value: str, key: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """The `size` rows of df that follow the cursor (None: the first ones), in order of (value, key).

    Reads as many pages of the directory beyond the cursor as hold the rows: two, and more where rows have gone.
    """
    v, k = F.col(value), F.col(key)
    rows = df if cursor is None else df.filter(_after(v, k, cursor))
    ends = directory if cursor is None else directory.filter(_after(F.col("last_value"), F.col("last_key"), cursor))
    pages = 2
    while True:
        bounds = ends.orderBy("page").limit(pages).select("last_value", "last_key").collect()  # a few rows
        if len(bounds) < pages:
            return rows.orderBy(v, k).limit(size)
        end = bounds[-1]
        some = rows.filter((v <= F.lit(end.last_value)) & ((v < F.lit(end.last_value)) | (k <= F.lit(end.last_key))))
        if some.limit(size).count() == size:
            return some.orderBy(v, k).limit(size)
        pages *= 2


def nth_page(df: DataFrame, directory: DataFrame, value: str, key: str, size: int, number: int) -> DataFrame:
    """Page `number` of the directory, from the table as it is now."""
    before = directory.filter(F.col("page") == number - 1).select("last_value", "last_key").collect()  # one row
    if number > 1 and not before:
        return df.limit(0)
    return page_after(df, directory, value, key, size, tuple(before[0]) if before else None)
