"""Identity decisions: seven classes over a match, its revalidation and the candidates it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.taxonomy import ACCESSORY_FAMILIES, family_of, profile_of
from tallyforge.functions.text import first_match
from tallyforge.operators.relational import ordered_distinct, top_k


def safe_new(confirmed: Column, article_match: Column, n_candidates: Column, role: Column, kind: Column) -> Column:
    """The decision on a product that no link settles."""
    return first_match(
        [
            (confirmed | article_match | (n_candidates > 0), F.lit("REVIEW_EXISTING")),
            ((role == "REFERENCE_MODEL") | family_of(kind).isin(*ACCESSORY_FAMILIES), F.lit("ACCESSORY_OR_COMPATIBILITY_ITEM")),
            ((kind == "unknown") | (role == "UNKNOWN_MODEL_ROLE"), F.lit("INSUFFICIENT_IDENTITY")),
        ],
        "SAFE_NEW_PRODUCT_CANDIDATE",
    )


def model_candidates(sources: DataFrame, registry: DataFrame, most: int = 25) -> DataFrame:
    """Per source `branded`, the registry keys with its model and brand, and `modelled`, those with its model;
    the first `most` of each, in key order.

    The registry's keys are cut per model first, with a group limit before the shuffle, so that sources
    meet one row a model, whatever number of products share it.
    """
    wanted = sources.select(F.col("key").alias("source_key"), "n_brand", F.coalesce(F.nullif(F.col("n_role.own"), F.lit("")), F.col("n_role.reference")).alias("n_model")).filter("n_model <> ''")

    def first(keys: list[str], name: str) -> DataFrame:
        rows = registry.filter(" and ".join(f"{k} <> ''" for k in keys)).select(*keys, "key")
        top = top_k(rows, keys, [F.col("key")], most)
        return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"].cast("string")).alias(name))

    return wanted.join(first(["n_model", "n_brand"], "branded"), ["n_model", "n_brand"], "left").join(first(["n_model"], "modelled"), "n_model", "left").select("source_key", "branded", "modelled")


def classify(matches: DataFrame, sources: DataFrame, registry: DataFrame) -> DataFrame:
    """One of seven decisions per source, its reason, candidates with their evidence, and critical characteristics.

    matches: decisions of matching.decide or of matching.relinked (source_key, status, method, candidate_key,
    candidate_keys, conflicts, conflict_class, auto_accepted). The match's best candidate is looked at again as a
    link would be: a conflict of identity there is a conflict, and only what passes is accepted.
    """
    rows = matches.join(sources.withColumnRenamed("key", "source_key"), "source_key").join(model_candidates(sources, registry), "source_key", "left")
    explicit = F.concat(F.when(F.col("candidate_key").isNotNull(), F.array("candidate_key")).otherwise(F.array().cast("array<string>")), F.coalesce("candidate_keys", F.array().cast("array<string>")))
    rows = rows.withColumn("explicit", explicit).withColumn("candidates", ordered_distinct(F.col("explicit"), F.col("branded"), F.col("modelled")))
    best = F.col("candidate_key").isNotNull()
    refuted = best & (F.col("conflict_class") == "IDENTITY_CONFLICT")
    accessory = (F.col("n_role.role") == "REFERENCE_MODEL") | family_of(F.col("n_kind")).isin(*ACCESSORY_FAMILIES)
    linked = F.col("auto_accepted") & best & ~refuted
    decision = first_match(
        [
            (best & (F.col("method") == "EXISTING_LINK_MANUAL"), F.lit("EXACT_EXISTING")),
            (linked & F.col("method").contains("BRAND_MODEL"), F.lit("HIGH_CONFIDENCE_EXISTING")),
            (linked, F.lit("EXACT_EXISTING")),
            (accessory, F.lit("ACCESSORY_OR_COMPATIBILITY_ITEM")),
            ((F.col("status") == "CONFLICT") | refuted, F.lit("CONFLICT")),
            (F.size("candidates") > 0, F.lit("REVIEW_EXISTING")),
        ]
    )
    fresh = safe_new(F.lit(False), F.lit(False), F.size("candidates"), F.col("n_role.role"), F.col("n_kind"))
    rows = rows.withColumn("decision", F.coalesce(decision, fresh))
    reason = first_match(
        [
            (F.col("decision").isin("EXACT_EXISTING", "HIGH_CONFIDENCE_EXISTING"), F.concat(F.lit("same product kind ("), "n_kind", F.lit(") + compatible own model ("), "n_role.own", F.lit(") + no critical identity conflict"))),
            (F.col("decision") == "ACCESSORY_OR_COMPATIBILITY_ITEM", F.concat(F.lit("blocked: product kind "), "n_kind", F.lit("; model role "), "n_role.role", F.lit("; reference model "), F.coalesce(F.nullif(F.col("n_role.reference"), F.lit("")), F.lit("none")))),
            (F.col("decision") == "CONFLICT", F.concat(F.lit("blocked by hard identity conflict: "), F.array_join(F.array_sort("conflicts"), ", "))),
            (F.col("decision") == "REVIEW_EXISTING", F.concat(F.lit("plausible existing candidate(s) "), F.array_join(F.slice("candidates", 1, 10), ","), F.lit("; identity proof insufficient"))),
            (F.col("decision") == "SAFE_NEW_PRODUCT_CANDIDATE", F.lit("no confirmed mapping, exact article, normalized-model, semantic, or compatibility candidate")),
        ],
        "own product kind/model identity is insufficient for safe creation classification",
    )
    critical = F.map_filter("n_props", lambda k, v: F.array_contains(profile_of(F.col("n_kind")), k))
    evidence = F.transform("candidates", lambda k: F.struct(k.alias("candidate_id"), F.when(F.array_contains("explicit", k), "matcher").when(F.coalesce(F.array_contains("branded", k), F.lit(False)), "brand_model").otherwise("model").alias("source")))
    facts = F.to_json(F.struct("category", F.struct(F.col("n_evidence.base").alias("base_model"), F.col("n_evidence.qualifier").alias("execution_qualifier")).alias("execution"), F.col("candidates").alias("candidate_ids"), evidence.alias("candidate_evidence"), critical.alias("identity_critical_properties")))
    return rows.select(
        "source_key", "decision", reason.alias("decision_reason"), F.col("n_kind").alias("product_kind"), F.col("n_role.role").alias("model_role"), F.col("n_role.own").alias("own_model"),
        F.col("n_role.reference").alias("reference_model"), F.array_join("candidates", "|").alias("candidate_ids"), facts.alias("identity_characteristics"),
        F.col("decision").isin("EXACT_EXISTING", "HIGH_CONFIDENCE_EXISTING").alias("auto_accepted"),
    )
