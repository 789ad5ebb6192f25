"""Quality profiles, anomalies between runs, missing-product states, rules and change previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.operators.similar import similar_names

#: Evidence that a product is gone, and evidence that says nothing.
CONFIRMED_MISSING = ("HTTP_404", "HTTP_410", "NOT_IN_SITEMAP", "NOT_DISCOVERED")
INCONCLUSIVE = ("TIMEOUT", "CONNECTION_ERROR", "HTTP_5XX", "PARSE_ERROR", "ANOMALY_GUARDED", "UNKNOWN")


def profile(rows: DataFrame, fields: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Products and the share of filled fields, per key; 0 for an empty table without keys."""
    means = [F.coalesce(F.avg(filled.cast("double")), F.lit(0.0)).alias(name) for name, filled in fields.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("products"), *means)


@dataclass(frozen=True)
class AnomalyLimits:
    """Least ratio of counts, and a fill-rate drop that counts only if the rate ends below the floor."""

    count_ratio: float = 0.60
    drop: float = 0.35
    floor: float = 0.25

    def __post_init__(self) -> None:
        if not (0 < self.count_ratio <= 1 and 0 <= self.drop <= 1 and 0 <= self.floor <= 1):
            raise ValueError("limits must lie between 0 and 1")


def anomalies(current: str, previous: str, fields: Sequence[str], limits: AnomalyLimits = AnomalyLimits()) -> Column:
    """Codes of a run's profile (struct column) against the latest healthy one (null struct if none)."""
    now, before = F.col(current), F.col(previous)
    found = [F.when((before["products"] > 0) & (now["products"] / before["products"] < limits.count_ratio), F.lit("CRAWL_COUNT_COLLAPSE"))]
    for field in fields:
        old, new = F.coalesce(before[field], F.lit(0.0)), F.coalesce(now[field], F.lit(0.0))
        fell = before.isNotNull() & (old - new >= limits.drop) & (new <= limits.floor)
        found.append(F.when(fell, F.lit(f"FIELD_COVERAGE_COLLAPSE:{field}")))
        found.append(F.when(before.isNotNull() & (old >= 0.5) & (new == 0), F.lit(f"SCHEMA_SIGNAL:{field}")))
    return F.array_compact(F.array(*found))


def against_latest_healthy(runs: DataFrame, key: str, order: str, healthy: Column, values: Sequence[str]) -> DataFrame:
    """Each run with `current` and the values of the latest earlier healthy run of its key as `previous`."""
    value = F.struct(*values)
    window = W.Window.partitionBy(key).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    return runs.withColumns({"current": value, "previous": F.last(F.when(healthy, value), ignorenulls=True).over(window)})


def discovery_health(found: Column, baseline: Column, least: float = 0.80) -> Column:
    """A struct: ratio to the baseline, whether the discovery is anomalous, whether products may be retired."""
    ratio = F.try_divide(found.cast("double"), baseline.cast("double"))
    bad = (found <= 0) | F.coalesce(ratio < least, F.lit(False))
    return F.struct(ratio.alias("ratio"), bad.alias("anomalous"), (~bad).alias("deactivation_allowed"))


def next_missed(missed: Column, active: Column, healthy: Column, status: Column, limit: int = 3) -> Column:
    """A struct of missed crawls and activity after one more crawl that didn't see the product."""
    counts = F.coalesce(status.isin(404, 410), F.lit(False)) | healthy
    missed_now = F.when(counts, missed + 1).otherwise(missed)
    return F.struct(missed_now.alias("missed"), F.when(counts, active & (missed_now < limit)).otherwise(active).alias("active"))


def missing_states(observations: DataFrame, key: str, order: Sequence[str], evidence: str = "evidence", guarded: str = "guarded", warning_at: int = 2, candidate_at: int = 3) -> DataFrame:
    """Each observation with the count of confirmed misses since the last sighting, and the state.

    A sighting starts a new stretch; inside it only confirmed, unguarded evidence counts. Both are
    running sums over the key's order, so no row loop is needed.
    """
    if warning_at < 1 or candidate_at <= warning_at:
        raise ValueError("the candidate threshold must exceed the warning threshold, which is at least 1")
    window = W.Window.partitionBy(key).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = observations.withColumn("_seen", F.sum((F.col(evidence) == "SEEN").cast("int")).over(window))
    counts = (F.col(evidence).isin(*CONFIRMED_MISSING) & ~F.col(guarded)).cast("int")
    stretch = W.Window.partitionBy(key, "_seen").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumn("misses", F.sum(counts).over(stretch)).drop("_seen")
    return rows.withColumn("state", state_of(F.col("misses"), warning_at, candidate_at))


def state_of(misses: Column, warning_at: int = 2, candidate_at: int = 3) -> Column:
    return F.when(misses >= candidate_at, "MISSING_CANDIDATE").when(misses >= warning_at, "WARNING").when(misses >= 1, "WATCH").otherwise("ACTIVE")


def missing_evidence(error_status: Column, discovered: Column) -> Column:
    """What says that a product wasn't parsed: its error, or that it was not discovered at all."""
    return (
        F.when(error_status.isin(404, 410), F.concat(F.lit("HTTP_"), error_status.cast("string")))
        .when(error_status >= 500, "HTTP_5XX").when(discovered, "PARSE_ERROR").otherwise("NOT_DISCOVERED")
    )


def _resolved() -> list[Column]:
    """Aggregates over rules r: what they say together; overrides with the rule they come from."""
    kind, value = F.col("r.rule_type"), F.col("r.value")

    def last(rule: str) -> Column:
        return F.max(F.when(kind == rule, F.struct("r.rule_id", "r.value")))

    return [
        F.coalesce(F.bool_or(kind.isin("IGNORE_PRODUCT", "DO_NOT_IMPORT")), F.lit(False)).alias("excluded"), F.coalesce(F.bool_or(kind == "FORCE_REVIEW"), F.lit(False)).alias("force_review"),
        last("BRAND_OVERRIDE").alias("brand_override"), last("CATEGORY_OVERRIDE").alias("category_override"),
        F.collect_set(F.when(kind == "DO_NOT_USE_SUPPLIER_FIELD", F.coalesce(F.nullif(value, F.lit("")), F.col("r.entity_key")))).alias("forbidden_fields"), F.collect_set("r.rule_id").alias("rule_ids"),
    ]


def apply_rules(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Products with what the active rules make of them.

    Rules: rule_id, supplier_id (null for all), scope (supplier, product, category, property),
    entity_key, rule_type, value. Every scope is an equi-join; of several overrides the one with the
    greatest rule_id wins. Rules for all products of a supplier, or for all, are first reduced to one row
    each, so that however many they are, a product meets one row.
    """
    c = F.col
    keyed = rules.select("supplier_id", "scope", "entity_key", F.struct("rule_id", "rule_type", "entity_key", "value").alias("r"))
    whole = keyed.filter("scope = 'supplier' or (scope = 'property' and entity_key <> '')")
    p = products.select("product_id", "supplier_id", "category")
    mine = c("_supplier").isNull() | (c("_supplier") == c("supplier_id"))
    single = keyed.withColumnRenamed("supplier_id", "_supplier")
    specific = p.join(single.filter("scope = 'product'"), c("product_id").cast("string") == c("entity_key")).filter(mine).select("product_id", "r")
    by_category = p.join(single.filter("scope = 'category'"), c("category") == c("entity_key")).filter(mine).select("product_id", "r")
    parts = {
        "own": specific.unionByName(by_category).groupBy("product_id").agg(F.struct(*_resolved()).alias("own")),
        "supplier": whole.filter("supplier_id is not null").groupBy("supplier_id").agg(F.struct(*_resolved()).alias("supplier")),
        "general": whole.filter("supplier_id is null").agg(F.struct(*_resolved()).alias("general")),
    }
    rows = products.join(parts["own"], "product_id", "left").join(parts["supplier"], "supplier_id", "left").crossJoin(F.broadcast(parts["general"]))

    def flag(name: str) -> Column:
        return c(f"general.{name}") | F.coalesce(f"own.{name}", F.lit(False)) | F.coalesce(f"supplier.{name}", F.lit(False))

    def override(name: str) -> Column:
        return F.nullif(F.greatest(*[c(f"{part}.{name}") for part in parts])["value"], F.lit(""))

    def union(name: str, kind: str) -> Column:
        return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"{part}.{name}", F.array().cast(f"array<{kind}>")) for part in parts])))

    made = {"excluded": flag("excluded"), "force_review": flag("force_review"), "brand_override": override("brand_override"), "category_override": override("category_override"), "forbidden_fields": union("forbidden_fields", "string"), "rule_ids": union("rule_ids", "bigint")}
    return rows.select(*products.columns, *[column.alias(name) for name, column in made.items()])


def change_preview(rows: DataFrame, key: str, fields: Sequence[str], policies: Mapping[str, str]) -> DataFrame:
    """One row per changed field with the decision, by precedence.

    Columns: current and proposed structs of text fields, forbidden (array), anomaly, excluded,
    identity_blocked booleans.
    """
    entries = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"current.{f}").alias("current"), F.col(f"proposed.{f}").alias("proposed"), F.lit(policies.get(f, "REVIEW_REQUIRED")).alias("policy")) for f in sorted(fields)
    ])
    changed = F.filter(entries, lambda e: ~e["current"].eqNullSafe(e["proposed"]))
    flat = rows.select(key, "forbidden", "anomaly", "excluded", "identity_blocked", F.explode(changed).alias("e")).select(key, "e.*", "forbidden", "anomaly", "excluded", "identity_blocked")
    decision = (
        F.when(F.array_contains("forbidden", F.col("field")), "EXCLUDED_BY_RULE").when(F.col("anomaly"), "ANOMALY_GUARD_BLOCKED").when(F.col("excluded"), "EXCLUDED_BY_RULE")
        .when(F.col("identity_blocked"), "IDENTITY_BLOCKED").when(F.col("policy") == "SUPPLIER_ALLOWED", "PROPOSE_UPDATE").when(F.col("policy") == "REVIEW_REQUIRED", "NEEDS_REVIEW").otherwise("NO_UPDATE")
    )
    return flat.select(key, "field", "current", "proposed", "policy", decision.alias("decision"))


def review_cases(current: DataFrame, incoming: DataFrame, key: str = "product_id") -> DataFrame:
    """What to do with each incoming case: INSERT, UNCHANGED or REOPEN, by its fingerprint."""
    old = current.select(key, F.col("fingerprint").alias("_print"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "INSERT").when(F.col("_print").eqNullSafe(F.col("fingerprint")), "UNCHANGED").otherwise("REOPEN")
    return incoming.join(old, key, "left").withColumn("action", action).drop("_print", "_known")


def review_order() -> list[Column]:
    """Open cases first, then by priority, the latest first, then by id."""
    return [F.when(F.col("status") == "RESOLVED", 1).otherwise(0).asc(), F.col("priority").asc(), F.col("updated_at").desc(), F.col("case_id").asc()]


def named_candidates(cases: DataFrame, registry: DataFrame, least: float = 0.60) -> DataFrame:
    """(case_id, candidate_id): registry products of a case's brand whose names are alike, through the index of names.

    cases: case_id, brand, name; registry: candidate_id, brand, name; brands and names normalized.
    """
    left = cases.filter("brand <> ''").select("case_id", F.col("brand").alias("block"), F.col("name").alias("left_name"))
    right = registry.filter("brand <> ''").select("candidate_id", F.col("brand").alias("block"), F.col("name").alias("right_name"))
    alike = similar_names(left.withColumnRenamed("left_name", "name"), right.withColumnRenamed("right_name", "name"), least, None)
    return left.join(alike, ["block", "left_name"]).join(right, ["block", "right_name"]).select("case_id", "candidate_id")


def review_candidates(explicit: DataFrame, by_model: DataFrame, by_brand: DataFrame, rejected: DataFrame, limit: int = 25) -> DataFrame:
    """(case_id, candidate_id, origin, rank) from three origins, without rejected pairs; the best origin counts."""
    rows = None
    for rank, (origin, part) in enumerate((("explicit", explicit), ("model", by_model), ("brand", by_brand))):
        part = part.select("case_id", "candidate_id", F.lit(rank).alias("_o"), F.lit(origin).alias("origin"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("case_id", "candidate_id").agg(F.min("_o").alias("_o"), F.min_by("origin", "_o").alias("origin"))
    kept = best.join(rejected.select("case_id", "candidate_id"), ["case_id", "candidate_id"], "left_anti")
    ranked = kept.withColumn("rank", F.row_number().over(W.Window.partitionBy("case_id").orderBy("_o", "candidate_id")))
    return ranked.filter(F.col("rank") <= limit).drop("_o")
