"""Merkle manifest of a table: leaf digests, block arrays collapsed by higher-order functions, proofs.

Leaves of a group stand in key order and are cut into blocks of 3^6. A block is one array; sequence,
slice, transform and aggregate collapse it level by level, all levels kept, and its last digest is one
node of the next stage, which is cut into blocks in the same way. Groups end when one node remains;
their roots, in order of group, are the leaves of a last tree. Proofs go the other way: each stage's
nodes get the siblings in their block before those of the block itself.

Positions come from rows written in order of (group, key, leaf): a partition knows each group's first
row and count, and only these counts meet in a window. So a group may hold any share of the rows; a
task holds one block of 729 leaves at a time. All of it is DataFrame and SQL functions.

Defined results: a null field is `-` in its leaf; a null source is a group of its own, before all
others; rows of null doc_id come first in their group; rows that repeat a doc_id are leaves of their
own, in order of their digests; an empty table gives no row. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_saved, saved

#: Nodes that become one, and levels that a block collapses.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
_WIDTHS = f"filter(array({', '.join(str(FAN**k) for k in range(LEVELS))}), w -> w < n)"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count, colon and value; - where it is null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, offered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, grp, leaf, and in `offered` the leaf of the row with other fields, null where it is the same."""
    own = {c: F.col(c) for c in _FIELDS}
    other = {**own, **(offered or {})}
    changed = F.lit(False)
    for c in offered or {}:
        changed = changed | ~own[c].eqNullSafe(other[c])
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"),
        digest(*map(field, own.values())).alias("leaf"), F.when(changed, digest(*map(field, other.values()))).alias("offered"),
    )


def numbered(nodes: DataFrame, key: str, digest_column: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with pos and n in their group, by (key, digest); also the written table below."""
    order = [F.col("grp").asc(), F.col(key).asc_nulls_first(), F.col(digest_column).asc()]
    rows = saved(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows_of = rows.withColumn("part", F.shiftright("at", 33))
    spans = rows_of.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("grp")
    spans = spans.select("grp", "part", "first", F.sum("rows").over(whole).alias("n"), (F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    return rows_of.join(spans, ["grp", "part"]).withColumn("pos", F.expr("before + at - first")).drop("part", "at", "first", "before"), rows


def blocks(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """grp, n, block, items in order, and the block's levels from its nodes to its root."""
    gathered = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("grp", "n", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *carry))).alias("items"))
    return gathered.withColumn("levels", F.expr(f"""
      aggregate({_WIDTHS}, cast(array(transform(items, x -> x.digest)) as array<array<string>>),
        (done, w) -> concat(done, array(transform(sequence(0, (size(element_at(done, -1)) - 1) div {FAN}),
          i -> sha2(array_join(slice(element_at(done, -1), cast(i * {FAN} + 1 as int), {FAN}), ''), 256)))))
    """))  # fmt: skip


def collapse(nodes: DataFrame, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The written stages of all groups' trees, and each group's root."""
    stages, roots = [], None
    while True:
        stages.append(saved(blocks(nodes, carry), "blocks"))
        tops = stages[-1].select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.expr("element_at(element_at(levels, -1), 1)").alias("digest"))
        ended = tops.filter("n = 1").select("grp", F.col("digest").alias("subroot"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes, carry = tops.filter("n > 1"), ()
        if nodes.isEmpty():
            return stages, roots


def _siblings() -> str:
    """Of item i of its block: what stands left and right of it in its run, level by level."""
    at = f"(i div w - i div (w * {FAN}) * {FAN})"
    return f"""transform({_WIDTHS}, (w, k) -> struct(
      array_join(slice(levels[k], cast(i div (w * {FAN}) * {FAN} + 1 as int), cast({at} as int)), '') as l,
      array_join(slice(levels[k], cast(i div w + 2 as int), cast({FAN - 1} - {at} as int)), '') as r))"""


def paths(stages: list[DataFrame], roots: DataFrame, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """The first stage's items (pos, digest, carry) with the path to the end; roots: grp, path and what to keep."""
    ends = roots.select("grp", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("ended"), "path", *keep)
    above = ends
    for k, stage in reversed(list(enumerate(stages))):
        placed = stage.withColumn("ended", F.expr(f"n <= {BLOCK}")).join(above, ["grp", "block", "ended"])
        fields = "".join(f", x.{c} as {c}" for c in (carry if k == 0 else ()))
        placed = placed.select("grp", "path", *keep, F.expr(f"explode(transform(items, (x, i) -> struct(x.pos as pos, x.digest as digest{fields}, {_siblings()} as own)))").alias("x"))
        placed = placed.select("grp", "x.*", F.concat("x.own", "path").alias("path"), *keep).drop("own")
        if k:
            above = saved(placed.select("grp", F.col("pos").alias("block"), F.lit(False).alias("ended"), "path", *keep), "paths").unionByName(ends)
    return placed


def manifest(spark: SparkSession, marked: DataFrame) -> DataFrame:
    """Rows of leaves() with subroot, root, path (an array of left and right siblings), proof_sha256,
    folded_root (of what is offered along the path) and verified."""
    first = saved(marked.select("doc_id", "grp", "leaf", "offered"), "leaves")
    placed, ordered = numbered(first, "doc_id", "leaf")
    carry = ("doc_id", "offered")
    stages, roots = collapse(placed.withColumnRenamed("leaf", "digest"), carry)
    drop_saved(first, ordered)
    # The groups' roots are the leaves of one more tree.
    roots = roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("digest"))
    placed, ordered = numbered(roots, "name", "digest")
    top, end = collapse(placed, ("name",))
    drop_saved(ordered)
    none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    end = end.select("grp", none.alias("path"), F.col("subroot").alias("root"))
    groups = saved(paths(top, end, ("root",), ("name",)).select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "groups")
    found = paths(stages, groups, ("subroot", "root"), carry).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.expr("sha2(array_join(transform(path, s -> concat(s.l, s.r)), ''), 256)").alias("proof_sha256"),
        F.expr("aggregate(path, coalesce(offered, digest), (d, s) -> sha2(concat(s.l, d, s.r), 256))").alias("folded_root"),
    )
    return found.withColumn("verified", F.expr("folded_root = root"))
