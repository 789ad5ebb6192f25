"""Relational building blocks: tops and counts per key, lineage walks, filters, pages, comparisons.

All take and return DataFrames and leave physical choices to Catalyst. Where a window over a hot key
would gather its rows in one task, an aggregate (max_by and the like) that combines on the map side is
used instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.session import checkpointed


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], earliest: bool = False) -> DataFrame:
    """One row per key: the one with the greatest (or least) `order`, which must be unique in the key.

    An aggregate, so a key with most of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if earliest else F.max_by
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every key; Spark prunes with a map-side group limit before the shuffle."""
    window = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def child_counts(parents: DataFrame, key: str, children: Mapping[str, DataFrame]) -> DataFrame:
    """Each parent with the number of its rows in each child table; 0 where it has none."""
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        parents = parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return parents


def ordered_text(column: Column, order: Column, separator: str) -> Column:
    """Aggregate: the values in `order`, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), column.alias("v")))), lambda x: x["v"]), separator)


def ordered_texts(columns: Mapping[str, tuple[Column, str]], order: Column) -> list[Column]:
    """Aggregates: several columns as texts in one order, each with its separator; null counts as empty.

    Rows are gathered and sorted once for all of them.
    """
    rows = F.array_sort(F.collect_list(F.struct(order.alias("_o"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (c, _) in columns.items()])))
    return [F.array_join(_pick(rows, n), separator).alias(n) for n, (_, separator) in columns.items()]


def _pick(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def distinct_text(column: Column, separator: str = ",") -> Column:
    """Aggregate: the distinct values in rising order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def conditional_counts(conditions: Mapping[str, Column]) -> list[Column]:
    """Aggregates: how many rows satisfy each condition."""
    return [F.count_if(condition).alias(name) for name, condition in conditions.items()]


def coverage(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """One row per field: rows present and missing, and the share in percent (0 for an empty table)."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(present).alias(name) for name, present in fields.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("present")) for name in fields]))
    flat = one.select("_n", rows.alias("_x")).select("_x.field", "_x.present", (F.col("_n") - F.col("_x.present")).alias("missing"), "_n")
    percent = F.when(F.col("_n") == 0, 0.0).otherwise(F.round(F.col("present") * 100.0 / F.col("_n"), 4))
    return flat.select("field", "present", "missing", percent.alias("percent"))


def guarded_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The left join by keys of which none is null; right rows that would double a left row raise."""
    double = right.join(left.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if double:
        raise ValueError("several rows for " + "; ".join(", ".join(str(r[k]) for k in keys) for r in double))
    return left.join(right, list(keys), "left")


def summed_counts(*tables: DataFrame) -> DataFrame:
    """One row, n: the rows of all tables together, each counted on its own and the counts added."""
    counts = [df.agg(F.count("*").alias(f"n{k}")) for k, df in enumerate(tables)]
    one = counts[0]
    for other in counts[1:]:
        one = one.crossJoin(other)  # one row each
    return one.select(sum((F.col(f"n{k}") for k in range(1, len(counts))), F.col("n0")).alias("n"))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, their count and how many rows are surplus."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("surplus", F.col("n") - 1)


def walk(nodes: DataFrame, key: str, parent: str, value: Column | None = None, rounds: int | None = None) -> DataFrame:
    """(node, origin, depth, value, ended): each node's chain of parents to its end, by pointer doubling.

    A round joins every node's stretch of its chain with the stretch that begins where it stops, so a chain of n
    nodes needs about log2(n) joins. A stretch carries its length, its last node and the value of its
    farthest node that has one. Parents that are not among the nodes end a chain. What hasn't ended when
    stretches are longer than there are nodes leads into a cycle: ended is false. Keys are unique.
    """
    own = nodes.select(F.col(key).alias("node"), F.col(parent).alias("_up"), (F.lit(None).cast("string") if value is None else value).alias("value"))
    known = nodes.select(F.col(key).alias("up"))
    state = checkpointed(own.join(known, F.col("_up") == F.col("up"), "left").select("node", "up", F.lit(1).cast("bigint").alias("size"), F.col("node").alias("origin"), "value"))
    for _ in range(rounds or state.count().bit_length() + 1):
        if state.filter("up is not null").isEmpty():
            break
        ahead = state.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("size").alias("_s"), F.col("origin").alias("_o"), F.col("value").alias("_v"))
        state = checkpointed(state.join(ahead, F.col("up") == F.col("_n"), "left").select(
            "node", F.col("_u").alias("up"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), F.coalesce("_o", "origin").alias("origin"), F.coalesce("_v", "value").alias("value")
        ))
    return state.select("node", "origin", (F.col("size") - 1).alias("depth"), "value", F.col("up").isNull().alias("ended"))


def _above(heads: DataFrame, step: DataFrame) -> DataFrame:
    """(node, up, depth): heads' ancestors with themselves, each at its least depth.

    In round k all that is found within 2^k steps is joined with the jumps of 2^k steps, and the jumps with
    themselves. A cycle's nodes are met again at greater depths, which don't count, so it adds nothing.
    """
    found = checkpointed(heads.select("node", F.col("node").alias("up"), F.lit(0).alias("depth")))
    jumps, length, size = checkpointed(step.filter("to is not null")), 1, found.count()
    while True:
        more = found.join(jumps, F.col("up") == F.col("at")).select("node", F.col("to").alias("up"), (F.col("depth") + length).alias("depth"))
        found = checkpointed(found.unionByName(more).groupBy("node", "up").agg(F.min("depth").alias("depth")))
        if size == (size := found.count()):
            return found
        twice = jumps.select(F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps, length = checkpointed(jumps.join(twice, "to").select("at", F.col("_to").alias("to"))), 2 * length


def _steps(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(at, to): each node and its parent, null where that is not among the nodes."""
    known = nodes.select(F.col(key).alias("to"))
    return nodes.select(F.col(key).alias("at"), F.col(parent).alias("_p")).join(known, F.col("_p") == F.col("to"), "left").select("at", "to")


def ancestors(nodes: DataFrame, key: str, parent: str, label: str) -> DataFrame:
    """(node, ancestor, label, depth) along parent pointers, 0 being the node; stops at repeats and gaps.

    By doubling: a tree of depth d needs about log2(d) rounds, cycles end by themselves.
    """
    found = _above(nodes.select(F.col(key).alias("node")), _steps(nodes, key, parent))
    labels = nodes.select(F.col(key).alias("ancestor"), F.col(label).alias("label"))
    return found.withColumnRenamed("up", "ancestor").join(labels, "ancestor").select("node", "ancestor", "label", "depth")


def lineage(heads: DataFrame, nodes: DataFrame, head: str, key: str, parent: str) -> DataFrame:
    """(head, key, depth) of every node in each head's chain of parents, the head itself at depth 0.

    Chains end where the parent is null or absent; one that doesn't is a cycle and raises, after as many
    rounds of doubling as its length has bits.
    """
    step = checkpointed(_steps(nodes, key, parent))
    starts = heads.select(F.col(head).alias("node")).join(step.select(F.col("at").alias("node")), "node", "left_semi").distinct()
    found = _above(starts, step)
    ends = found.join(step.filter("to is null"), F.col("up") == F.col("at"), "left_semi")
    if not found.join(ends.select("node").distinct(), "node", "left_anti").isEmpty():
        raise ValueError("the parents form a cycle")
    return found.select(F.col("node").alias("head"), F.col("up").alias(key), "depth")


def tree_faults(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, fault): nodes whose parent is absent (DANGLING), and nodes from which parents never end (CYCLE)."""
    known = nodes.select(F.col(key).alias("_k")).distinct()
    dangling = nodes.filter(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_k"), "left_anti").select(F.col(key).alias("key"), F.lit("DANGLING").alias("fault"))
    return dangling.unionByName(walk(nodes, key, parent).filter("not ended").select(F.col("node").alias("key"), F.lit("CYCLE").alias("fault")))


def origins(nodes: DataFrame, key: str, parent: str, rounds: int | None = None) -> DataFrame:
    """(node, origin, depth): where each node's chain of parents begins; a cycle raises."""
    found = walk(nodes, key, parent, rounds=rounds)
    if not found.filter("not ended").isEmpty():
        raise ValueError("the parents form a cycle")
    return found.select("node", "origin", "depth")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, sizes: Sequence[int] = (25, 50, 100)) -> tuple[DataFrame, DataFrame]:
    """A page of the ordered rows, and one row with the total and the number of pages (at least 1)."""
    if number < 1 or size not in sizes:
        raise ValueError(f"page must be at least 1 and size one of {sorted(sizes)}")
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total


def numeric_first(column: str) -> list[Column]:
    """Sort keys that put numeric ids first, by value, and other ids after them, by text."""
    digits = F.coalesce(F.col(column).rlike(r"^\d+$"), F.lit(False))
    return [(~digits).asc(), F.when(digits, F.expr(f"try_cast({column} AS DECIMAL(38,0))")).asc(), F.col(column).asc()]


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def contains_text(columns: Sequence[str], text: str) -> Column:
    """Whether any of the columns contains the text, whatever the case; % and _ stand for themselves."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.lower(F.col(column)).contains(text.lower()), F.lit(False))
    return found


def differing(left: str, right: str, columns: Sequence[str]) -> Column:
    """Names of the columns whose values differ between two struct columns; nulls are equal."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), F.lit(c)) for c in columns]))


def first_tier(candidates: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """Only the candidates of each key's lowest tier (the first stage of a cascade that found any)."""
    least = candidates.groupBy(key).agg(F.min(tier).alias("_least"))
    return candidates.join(least, key).filter(F.col(tier) == F.col("_least")).drop("_least")


def stratified(df: DataFrame, group: str, order: Sequence[str], size: int) -> DataFrame:
    """One row of every group, then the next rows in order until there are `size`."""
    first = F.row_number().over(W.Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn("_extra", (first > 1).cast("int"))
    return ranked.orderBy("_extra", *order).limit(size).drop("_extra")


def ordered_distinct(*arrays: Column, limit: int = 25) -> Column:
    """The arrays one after another without repeats, in order of first occurrence, cut to `limit`."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])), 1, limit)
