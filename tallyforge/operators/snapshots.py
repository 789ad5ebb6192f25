"""Stored versions of keyed tables: upserts that touch few slices, and comparisons that skip what is equal.

A version's rows lie in slices (a column that rows of one batch tend to share, or a hash of the key) and,
within these, in buckets by key. An upsert reads and rewrites only the slices that its batch names, and
joins their buckets with the batch as they lie: only the batch moves.

A snapshot's rows lie in buckets by key, beside a tree of digests: a bucket's digest combines two hashes of each
row by sum and exclusive or, with the count, so that it needs no order; a node's is the hash of its
children's. Two snapshots are compared from their roots downwards, and only buckets whose digests
differ are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.merge import compare, merge_snapshot

#: Children of a node of digests, and levels below the root: 16^3 buckets.
FAN, LEVELS = 16, 3


def key_slice(keys: Sequence[str], slices: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")


def create_version(df: DataFrame, name: str, keys: Sequence[str], by: Column, buckets: int = 8) -> None:
    """Store df as the catalog table `name`: partitioned by the slice, bucketed and sorted by the keys."""
    rows = df.withColumn("slice", by).repartition(buckets, *keys)
    rows.write.mode("overwrite").format("parquet").partitionBy("slice").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def upsert_plan(spark: SparkSession, name: str, batch: DataFrame, keys: Sequence[str], values: Sequence[str], by: Column, observed_at: Column, stamp: str = "last_changed_at") -> DataFrame:
    """The next state of the slices that the batch names. The slice of a key never changes."""
    touched = [r.slice for r in batch.select(by.alias("slice")).distinct().collect()]  # slices are few
    current = spark.table(name).filter(F.col("slice").isin(*touched))
    merged = merge_snapshot(current.drop("slice"), batch, keys, values, observed_at, stamp)
    return merged.withColumn("slice", by)


def upsert(spark: SparkSession, name: str, batch: DataFrame, keys: Sequence[str], values: Sequence[str], by: Column, observed_at: Column, stamp: str = "last_changed_at") -> None:
    """merge_snapshot of the stored version and the batch, in place: slices that the batch doesn't name stay as they are."""
    merged = upsert_plan(spark, name, batch, keys, values, by, observed_at, stamp)
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        merged.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", kept)


def write_snapshot(df: DataFrame, keys: Sequence[str], folder: str) -> None:
    """Store df's rows by bucket, with the digests of buckets and of the nodes above."""
    spark, columns = df.sparkSession, sorted(df.columns)
    buckets = FAN**LEVELS
    rows = df.withColumn("bucket", key_slice(keys, buckets))
    rows.repartitionByRange("bucket").sortWithinPartitions("bucket").write.parquet(f"{folder}/rows")
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    stored = spark.read.parquet(f"{folder}/rows")
    summed = stored.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("x"), F.sum(F.xxhash64(F.lit(2), row).cast("decimal(38,0)")).alias("s"))
    level = summed.select(F.lit(LEVELS).alias("level"), F.col("bucket").cast("bigint").alias("node"), F.sha2(F.concat_ws(",", "n", "x", "s"), 256).alias("digest"))
    level.write.parquet(f"{folder}/digests/of={LEVELS}")
    for k in range(LEVELS - 1, -1, -1):
        below = spark.read.parquet(f"{folder}/digests/of={k + 1}")
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FAN at most
        level = below.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(children.alias("c")).select(F.lit(k).alias("level"), F.col("up").alias("node"), F.sha2(F.to_json("c"), 256).alias("digest"))
        level.write.parquet(f"{folder}/digests/of={k}")


def differing_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets in which two snapshots differ, found from the roots downwards."""
    nodes: list[int] | None = None
    for k in range(LEVELS + 1):
        sides = []
        for folder in (before, after):
            level = spark.read.schema("level int, node bigint, digest string").parquet(f"{folder}/digests/of={k}")
            sides.append(level if nodes is None else level.filter(F.floor(F.col("node") / FAN).isin(*nodes)))
        left, right = (side.select("node", F.col("digest").alias(name)) for side, name in zip(sides, ("a", "b"), strict=True))
        nodes = [r.node for r in left.join(right, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()]  # FAN^k at most
        if not nodes:
            return []
    return sorted(nodes)


def compare_snapshots(spark: SparkSession, before: str, after: str, keys: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rows of merge.compare that aren't UNCHANGED, from the buckets that differ."""
    buckets = differing_buckets(spark, before, after)
    old, new = (spark.read.parquet(f"{folder}/rows").filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False)).drop("bucket") for folder in (before, after))
    return compare(old, new, keys, groups).filter("status <> 'UNCHANGED'")
