"""Queries of postings, keyset pages, stored versions and snapshots over the test tables, each with its oracle."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import paging, postings, snapshots
from tallyforge.session import scratch
from tallyforge.session import table as t
from tallyforge.streaming.silence import stream_silence

_NEEDLES = ("ring", "RED", "s", "al", "brush ", "ing rin", "o r", "zz", "l ro", "e", "small ring")


def substring_search(s: SparkSession, d: str) -> DataFrame:
    """Parts whose name contains a needle, for needles of one to ten characters, from postings alone."""
    folder = scratch(s, "postings")
    postings.write_postings(t(s, d, "part"), "p_partkey", F.col("p_name"), folder)
    index, found = postings.read_postings(s, folder), None
    for needle in _NEEDLES:
        rows = postings.containing(index, needle).select(F.lit(needle).alias("needle"), F.col("key").alias("p_partkey"))
        found = rows if found is None else found.unionByName(rows)
    return found


SUBSTRING_SEARCH = f"SELECT needle, p_partkey FROM part, (SELECT unnest([{', '.join(repr(n) for n in _NEEDLES)}]) AS needle) WHERE contains(lower(p_name), lower(needle))"
_SIZE, _PAGE = 50, 7


def keyset_page(s: SparkSession, d: str) -> DataFrame:
    """Page 7 of the orders by date, after orders of every seventh key have gone since the directory was built."""
    orders = t(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    directory = paging.page_directory(orders, "o_orderdate", "o_orderkey", _SIZE)
    return paging.nth_page(orders.filter("o_orderkey % 7 <> 0"), directory, "o_orderdate", "o_orderkey", _SIZE, _PAGE)


KEYSET_PAGE = f"""
WITH n AS (SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS at_ FROM orders)
SELECT o_orderkey, o_orderdate, o_totalprice FROM n WHERE at_ > {_SIZE * (_PAGE - 1)} AND o_orderkey % 7 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT {_SIZE}
"""


def page_bounds(s: SparkSession, d: str) -> DataFrame:
    return paging.page_directory(t(s, d, "orders"), "o_orderdate", "o_orderkey", _SIZE)


PAGE_BOUNDS = f"""
WITH n AS (SELECT o_orderkey, o_orderdate, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // {_SIZE} + 1 AS page FROM orders)
SELECT page, count(*) AS rows, max(o_orderdate) AS last_value, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM n GROUP BY page
"""


def sliced_upsert(s: SparkSession, d: str) -> DataFrame:
    """Offers by supplier: a batch of a few suppliers' new and changed offers is merged into a stored version."""
    c = F.col
    rows = t(s, d, "lineitem").groupBy(c("l_suppkey").alias("supplier"), c("l_partkey").alias("part")).agg(F.sum(F.round(c("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    old = rows.filter("part % 5 <> 0").withColumn("last_changed_at", F.lit(1))
    batch = rows.filter("supplier % 10 = 3").select("supplier", "part", F.when(c("part") % 3 == 0, c("cents") + 1).otherwise(c("cents")).alias("cents"))
    name, keys, by = f"upserted_{scratch(s, 'v').rpartition('-')[2]}", ["supplier", "part"], F.pmod(c("supplier"), F.lit(32)).cast("int")
    snapshots.create_version(old, name, keys, by)
    snapshots.upsert(s, name, batch, keys, ["cents"], by, F.lit(2))
    return s.table(name).drop("slice")


SLICED_UPSERT = """
WITH r AS (SELECT l_suppkey AS supplier, l_partkey AS part, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL)
SELECT supplier, part, CASE WHEN supplier % 10 = 3 AND part % 3 = 0 THEN cents + 1 ELSE cents END AS cents, CAST(CASE WHEN supplier % 10 = 3 AND (part % 5 = 0 OR part % 3 = 0) THEN 2 ELSE 1 END AS INT) AS last_changed_at
FROM r WHERE part % 5 <> 0 OR supplier % 10 = 3
"""


def snapshot_changes(s: SparkSession, d: str) -> DataFrame:
    """Customers that came, went or changed between two snapshots, of which only differing buckets are read."""
    c = F.col
    rows = t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    before, after = scratch(s, "before"), scratch(s, "after")
    snapshots.write_snapshot(rows.filter("c_custkey % 97 <> 5"), ["c_custkey"], before)
    snapshots.write_snapshot(rows.filter("c_custkey % 89 <> 7").withColumn("c_nationkey", F.when(c("c_custkey") % 53 == 1, c("c_nationkey") + 100).otherwise(c("c_nationkey"))), ["c_custkey"], after)
    found = snapshots.compare_snapshots(s, before, after, ["c_custkey"], {"place": ["c_nationkey"], "rest": ["c_name", "c_acctbal"]})
    return found.select("c_custkey", "status", F.array_join("changed_groups", ",").alias("changed_groups"), c("old.c_nationkey").alias("old_nation"), c("new.c_nationkey").alias("new_nation"))


SNAPSHOT_CHANGES = """
WITH x AS (SELECT c_custkey, c_nationkey AS n, c_custkey % 97 <> 5 AS was, c_custkey % 89 <> 7 AS is_, c_nationkey + CASE WHEN c_custkey % 53 = 1 THEN 100 ELSE 0 END AS m FROM customer)
SELECT c_custkey, CASE WHEN NOT was THEN 'NEW' WHEN NOT is_ THEN 'MISSING' ELSE 'CHANGED' END AS status, CASE WHEN was AND is_ THEN 'place' ELSE '' END AS changed_groups, CASE WHEN was THEN n END AS old_nation, CASE WHEN is_ THEN m END AS new_nation
FROM x WHERE was <> is_ OR was AND is_ AND n <> m
"""

def silence_stream(s: SparkSession, d: str) -> DataFrame:
    """Orders as sightings of their customers: one available-now run, in which 90.5 days without one count as missing."""
    out, c = scratch(s, "silence"), F.col
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/orders.parquet")
    whole = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = s.readStream.schema(t(s, d, "orders").schema).option("pathGlobFilter", "*.parquet" if whole else "orders.parquet")  # a stream reads folders
    orders = reader.parquet(f"{d}/orders.parquet" if whole else d)
    rows = orders.select(c("o_custkey").cast("string").alias("key"), c("o_orderkey").alias("run"), F.lit("SEEN").alias("evidence"), F.lit(False).alias("guarded"), c("o_orderdate").alias("at"))
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    kept = s.conf.get(name)
    s.conf.set(name, provider)
    try:
        query = stream_silence(rows, timedelta(days=90, hours=12)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        s.conf.set(name, kept)
    return s.read.parquet(f"{out}/rows").select(c("key").cast("bigint").alias("custkey"), c("at").alias("seen_at"), "evidence", "misses", "state", "by_timer")


SILENCE_STREAM = """
WITH o AS (SELECT o_custkey, o_orderdate AS t, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after_ FROM orders), w AS (SELECT max(o_orderdate) AS mark FROM orders)
SELECT o_custkey AS custkey, t AS seen_at, 'SEEN' AS evidence, 0 AS misses, 'ACTIVE' AS state, FALSE AS by_timer FROM o UNION ALL
SELECT o_custkey, t + n * INTERVAL 2172 HOUR, 'NOT_DISCOVERED', n, ['WATCH', 'WARNING', 'MISSING_CANDIDATE'][n], TRUE FROM o, w, range(1, 4) r(n)
WHERE CASE WHEN after_ IS NULL THEN t + n * INTERVAL 2172 HOUR <= mark ELSE t + n * INTERVAL 2172 HOUR < after_ END
"""

QUERIES = {
    "substring_search": (substring_search, SUBSTRING_SEARCH), "keyset_page": (keyset_page, KEYSET_PAGE), "page_bounds": (page_bounds, PAGE_BOUNDS), "sliced_upsert": (sliced_upsert, SLICED_UPSERT),
    "snapshot_changes": (snapshot_changes, SNAPSHOT_CHANGES), "silence_stream": (silence_stream, SILENCE_STREAM),
}
