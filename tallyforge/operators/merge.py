"""Snapshot merges, change detection and history on plain Parquet tables.

Tables are versions: a merge reads the current version and the incoming rows and gives the next one;
history is appended. One full outer join on the key serves upsert, change list and counters alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.session import checkpointed


def group_hash(columns: Sequence[str], prefix: str = "") -> Column:
    """SHA-256 of a group of fields as canonical JSON: sorted names, nulls kept."""
    fields = F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _paired(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("old"))
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("new"))
    return old.join(new, list(keys), "fullouter")


def compare(current: DataFrame, incoming: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keys with their status NEW, MISSING, CHANGED or UNCHANGED, the changed groups, and old and new."""
    changed = F.array_compact(
        F.array(*[
            F.when(~F.struct(*[F.col(f"old.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in columns])), F.lit(name))
            for name, columns in groups.items()
        ])
    )
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    rows = _paired(current, incoming, keys).withColumn("changed_groups", F.when(both, changed).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "MISSING").when(F.size("changed_groups") > 0, "CHANGED").otherwise("UNCHANGED")
    return rows.select(*keys, status.alias("status"), "changed_groups", "old", "new")


def merge_snapshot(current: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], observed_at: Column, stamp: str = "last_changed_at") -> DataFrame:
    """The next version: incoming rows win; `stamp` moves only where a value differs; others stay.

    current has `stamp`, incoming need not; rows absent from incoming are carried over unchanged.
    """
    if stamp not in current.columns:
        raise ValueError(f"the current version has no column {stamp}")
    rows = _paired(current, incoming, keys)
    same = F.struct(*[F.col(f"old.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in values]))
    kept = [F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in values]
    at = F.when(F.col("new").isNull() | (F.col("old").isNotNull() & same), F.col(f"old.{stamp}")).otherwise(observed_at)
    return rows.select(*keys, *kept, at.alias(stamp))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current, and those incoming rows whose key it lacks."""
    return current.unionByName(incoming.select(*current.columns).join(current, list(keys), "left_anti"))


def bootstrap_catalog(catalog: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next catalog, next registry): every registry product gets a catalog product, and names it.

    catalog: catalog_id, origin; registry: id, catalog_id (null where it has none yet). The new catalog ids
    follow the greatest one in the order of the registry's ids, numbered by partition offsets.
    """
    lacking = registry.select(F.col("id").cast("string").alias("origin")).join(catalog, "origin", "left_anti").distinct()
    top = catalog.agg(F.coalesce(F.max("catalog_id"), F.lit(0)).cast("bigint").alias("_top"))
    numbered = numbered_rows(lacking, "origin", "_n").crossJoin(F.broadcast(top))
    after = catalog.unionByName(numbered.select((F.col("_top") + F.col("_n")).alias("catalog_id"), "origin"))
    linked = registry.join(after.select("origin", F.col("catalog_id").alias("_c")), F.col("id").cast("string") == F.col("origin"), "left")
    return after, linked.select(*[F.coalesce("catalog_id", "_c").alias("catalog_id") if c == "catalog_id" else F.col(c) for c in registry.columns])


def numbered_rows(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with numbers from 1 in the order of a unique text column: sorted ranges, each numbered from its own offset."""
    ranged = checkpointed(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return ranged.join(F.broadcast(offsets.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def history(compared: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]], observed_at: Column) -> DataFrame:
    """One row per changed group with its old and new values as JSON; new keys leave no history."""
    def as_json(side: str) -> Column:
        whole = F.lit(None).cast("string")
        for name, columns in groups.items():
            value = F.to_json(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns]), {"ignoreNullFields": "false"})
            whole = F.when(F.col("field_group") == name, value).otherwise(whole)
        return whole

    rows = compared.filter("status = 'CHANGED'").withColumn("field_group", F.explode("changed_groups"))
    return rows.select(*keys, "field_group", as_json("old").alias("old_value"), as_json("new").alias("new_value"), observed_at.alias("observed_at"))


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that incoming names are replaced; those of other parents stay."""
    return current.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming.select(*current.columns))


def decision_events(current: DataFrame, incoming: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What to do with each incoming decision: TOUCH an equal current one, INSERT after closing another."""
    old = current.filter("is_current").select(F.col(key), F.col(fingerprint).alias("_print"), F.col("event_id").alias("previous_event_id"))
    same = F.col("_print").eqNullSafe(F.col(fingerprint)) & F.col("previous_event_id").isNotNull()
    return incoming.join(old, key, "left").withColumn("action", F.when(same, "TOUCH").otherwise("INSERT")).drop("_print")


def merge_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one, keys in order; the newer value of a key wins, a null side adds nothing."""
    a, b = (F.coalesce(F.from_json(side, "map<string,variant>"), F.create_map().cast("map<string,variant>")) for side in (old, new))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    value = F.transform(keys, lambda k: F.when(F.map_contains_key(b, k), F.try_element_at(b, k)).otherwise(F.try_element_at(a, k)))
    return F.to_json(F.map_from_arrays(keys, value), {"ignoreNullFields": "false"})


def append_event(history: Column, event: Column) -> Column:
    """A JSON array with one event more; a null or empty history begins a new array."""
    inner = F.regexp_replace(F.trim(F.coalesce(history, F.lit("[]"))), r"^\[\s*|\s*\]$", "")
    return F.concat(F.lit("["), F.when(inner != "", F.concat(inner, F.lit(","))).otherwise(""), event, F.lit("]"))


def latest_role(urls: DataFrame, keys: Sequence[str], precedence: Mapping[str, int]) -> DataFrame:
    """One role per url: the one that comes first in precedence (unknown roles last, then by name)."""
    rank = F.coalesce(*[F.when(F.col("role") == name, F.lit(n)) for name, n in precedence.items()], F.lit(len(precedence)))
    return urls.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "role")).alias("_x")).select(*keys, F.col("_x.role").alias("role"))
