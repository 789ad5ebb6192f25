"""Reports over cards and decisions: completeness, media, relations, categories of new products, samples, previews of imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.operators.relational import numeric_first, top_k

#: Types of relations; others count as RELATED.
RELATIONS = ("ACCESSORY", "RELATED", "COMPATIBLE_WITH", "REPLACEMENT", "PARENT_REFERENCE")
_NONE = "array<string>"


def completeness(rows: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """Which of the fields a product fills, the missing ones in order, and whether none is missing."""
    tests = {name: F.coalesce(test, F.lit(False)) for name, test in fields.items()}
    missing = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in tests.items()]))
    return rows.select(key, *[test.alias(name) for name, test in tests.items()], F.array_join(missing, "|").alias("missing_fields"), (F.size(missing) == 0).alias("complete"))


def media_audit(cards: DataFrame, key: str) -> DataFrame:
    """Counts over a card's images (media array<struct<media_type,url,position,is_primary>>)."""
    images = F.filter(F.coalesce("media", F.array().cast("array<struct<media_type:string,url:string,title:string,position:int,is_primary:boolean>>")), lambda m: m["media_type"] == "image")
    filled = F.filter(images, lambda m: F.coalesce(m["url"], F.lit("")) != "")
    urls = F.transform(filled, lambda m: m["url"])
    return cards.select(
        key, F.size(filled).alias("urls"), F.exists(filled, lambda m: F.coalesce(m["is_primary"], F.lit(False))).alias("primary_exists"), F.size(F.filter(filled, lambda m: ~F.coalesce(m["is_primary"], F.lit(False)))).alias("gallery"),
        (F.size(urls) - F.size(F.array_distinct(urls))).alias("duplicates"), (F.size(images) - F.size(filled)).alias("broken"), F.forall(images, lambda m: m["position"].isNotNull()).alias("metadata_present"),
    )


def relation_buckets(cards: DataFrame, key: str, reference: Column | None = None) -> DataFrame:
    """Relations (array<struct<kind,target>>) by type, as counts and as JSON; a model that the card refers to counts as PARENT_REFERENCE."""
    kind = lambda r: F.upper(F.coalesce(F.nullif(r["kind"], F.lit("")), F.lit("RELATED")))
    known = F.transform(F.coalesce("relations", F.array().cast("array<struct<kind:string,target:string>>")), lambda r: F.struct(F.when(kind(r).isin(*RELATIONS), kind(r)).otherwise("RELATED").alias("kind"), F.coalesce(r["target"], F.lit("")).alias("target")))
    more = F.when(reference.isNotNull(), F.array(reference)).otherwise(F.array().cast(_NONE)) if reference is not None else F.array().cast(_NONE)

    def of(name: str) -> Column:
        return F.transform(F.filter(known, lambda r: r["kind"] == name), lambda r: r["target"])

    buckets = {name: of(name) for name in RELATIONS}
    buckets["PARENT_REFERENCE"] = F.concat(buckets["PARENT_REFERENCE"], more)
    evidence = F.to_json(F.struct(*[buckets[name].alias(name) for name in sorted(RELATIONS)]))
    return cards.select(key, *[F.size(buckets[name]).alias(f"{name.lower()}_count") for name in RELATIONS], evidence.alias("relation_evidence"))


def new_product_categories(rows: DataFrame) -> Column:
    """Why a source without a match is new, as an array in fixed order; rows: candidate_key, method, similarity, brand, model, sku."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    none, like = c("method") == "NO_CANDIDATES", F.coalesce("similarity", F.lit(0.0))
    tests = {
        "NO_REGISTRY_CANDIDATE": c("candidate_key").isNull() | none, "POSSIBLE_NAME_VARIATION": like >= 0.60, "MISSING_BRAND": blank("brand"), "MISSING_MODEL": blank("model"),
        "INSUFFICIENT_IDENTIFIERS": blank("sku"), "LIKELY_REAL_NEW_PRODUCT": (none | (like < 0.45)) & ~blank("sku") & ~blank("brand"),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    review = (F.size(found) == 0) | F.array_contains(found, "POSSIBLE_NAME_VARIATION") | F.array_contains(found, "MISSING_BRAND")
    return F.concat(found, F.when(review, F.array(F.lit("MANUAL_REVIEW_REQUIRED"))).otherwise(F.array().cast(_NONE)))


def nested_totals(rows: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """One row: sums of sizes of nested arrays over all cards; an absent array counts 0."""
    return rows.agg(*[F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).cast("bigint").alias(name) for name, size in totals.items()])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows), one row per table."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def keep_best(rows: DataFrame, key: Sequence[str], order: Sequence[Column], url: str, collections: str) -> tuple[DataFrame, DataFrame]:
    """(winners, aliases): of the rows of a key the first in order, with the collections of all; the others are its aliases."""
    window = W.Window.partitionBy(*key).orderBy(*order)
    ranked = rows.withColumns({"_n": F.row_number().over(window), "_primary": F.first(url).over(window)})
    every = rows.select(*key, F.explode(collections).alias("_c")).groupBy(*key).agg(F.array_sort(F.collect_set("_c")).alias("_all"))
    winners = ranked.filter("_n = 1").join(every, list(key), "left")
    aliases = ranked.filter("_n > 1").select(*key, F.col("_primary").alias("primary_url"), F.col(url).alias("alias_url"))
    return winners.select(*[F.coalesce("_all", F.array().cast(_NONE)).alias(c) if c == collections else F.col(c) for c in rows.columns]), aliases


def quota_sample(rows: DataFrame, key: str, status: str, quotas: Mapping[str, int], order: Sequence[Column], required: DataFrame | None = None) -> DataFrame:
    """(key, status, reason): the required rows, then of every status the first in order until its quota is full.

    Quotas bound the sample; ranks are cut to them before rows move.
    """
    first = rows.select(key, status).limit(0).withColumn("reason", F.lit("required")) if required is None else rows.join(required.select(key).distinct(), key, "left_semi").select(key, status, F.lit("required").alias("reason"))
    have = first.groupBy(status).agg(F.count("*").alias("_have"))
    quota = F.coalesce(*[F.when(F.col(status) == name, F.lit(n)) for name, n in quotas.items()], F.lit(0))
    rest = rows.join(first.select(key), key, "left_anti")
    ranked = top_k(rest, [status], order, max(quotas.values()), "_n").join(F.broadcast(have), status, "left")
    taken = ranked.filter(F.col("_n") <= quota - F.coalesce("_have", F.lit(0))).select(key, status, F.lit("quota").alias("reason"))
    return first.unionByName(taken)


def first_of_each(rows: DataFrame, key: str, predicates: Mapping[str, Column], limit: int) -> DataFrame:
    """(key, reason): for each predicate in turn the first row by key, in numeric order, that isn't chosen yet; `limit` in all.

    For each predicate the first `limit` keys suffice, as earlier predicates take fewer; these few are
    dealt out on the driver.
    """
    found = {}
    for name, test in predicates.items():
        found[name] = [r[0] for r in rows.filter(F.coalesce(test, F.lit(False))).select(key).orderBy(*numeric_first(key)).limit(limit).collect()]
    chosen: list[tuple[str, str]] = []
    for name, keys in found.items():
        taken = {k for k, _ in chosen}
        if len(chosen) < limit and (k := next((k for k in keys if k not in taken), None)) is not None:
            chosen.append((k, name))
    return rows.sparkSession.createDataFrame(chosen, f"{key} {dict(rows.dtypes)[key]}, reason string")


def target_problems(targets: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): targets that are asked for twice, or that none or several rows of the catalog answer to."""
    asked = targets.groupBy(key).agg(F.count("*").alias("n"))
    counts = observed.groupBy(key).agg(F.count("*").alias("seen"))
    rows = asked.join(counts, key, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("DUPLICATE_TARGET")), F.when(F.col("seen") == 0, F.lit("MISSING_TARGET")).when(F.col("seen") > 1, F.concat(F.lit("AMBIGUOUS_TARGET:"), "seen")),
    ))
    return rows.select(key, F.explode(problems).alias("problem"))


def rollback_rows(plan: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """What to put back if the plan is undone: the changed fields and their values before; unchanged targets are left out."""
    fields = F.array_compact(F.array(F.when(F.col("price_change").isin("INCREASE", "DECREASE"), F.lit("price")), F.when(F.col("availability_change") == "CHANGE", F.lit("availability"))))
    rows = plan.select(key, fields.alias("_f")).filter("size(_f) > 0")
    old = before.select(key, F.col("current_price").alias("rollback_price"), F.col("current_availability").alias("rollback_availability"))
    return rows.join(old, key).select(key, F.array_join("_f", "|").alias("changed_fields"), "rollback_price", "rollback_availability")


def state_changes(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose state differs between two captures, or that only one has; none after a dry run."""
    a = before.select(key, F.struct(*columns).alias("_a"))
    b = after.select(key, F.struct(*columns).alias("_b"))
    state = F.when(F.col("_a").isNull(), "ONLY_AFTER").when(F.col("_b").isNull(), "ONLY_BEFORE").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return a.join(b, key, "fullouter").select(key, state.alias("problem")).filter("problem is not null")


def preview(text: Column, size: int = 120) -> Column:
    """The text on one line, cut at `size` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def escaped(text: Column) -> Column:
    """The text as XML or HTML may hold it."""
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out
