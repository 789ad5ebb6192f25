"""The integrity suites over the tables of the catalog: ingest, suppliers, selection and lineage.

Tables by name, with the columns that the checks read:
suppliers (supplier_id, code, enabled), products (product_id, supplier_id, external_id, stable, active,
catalog_id, missed, success_at, declared_supplier), offers (offer_id, product_id, supplier_id, kind,
active, availability, missed, success_at), properties, media, options, urls (product_id; urls: url),
memberships (product_id, supplier_id), relations (supplier_id, from_product, to_product), identifiers
(supplier_id, supplier_code), matches (event_id, previous_id, product_id, catalog_id, status, method,
auto_accepted, is_current, evidence), selections (catalog_id, status, offer_id, evidence), runs
(supplier_id, kind, status, started_at).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import checks as C

#: Methods that never accept by themselves, and the fields that a selection's evidence must have.
FUZZY = ("NAME_CANDIDATE_ONLY", "NO_IDENTITY_EVIDENCE")
EVIDENCE = (
    "policy_version", "catalog_product_id", "evaluated_candidate_count", "eligible_candidate_count", "selected_offer_id", "selected_supplier_code", "selection_reason",
    "availability_rank", "supplier_priority", "price_rule", "freshness_rule", "candidate_offers",
)
Tables = Mapping[str, DataFrame]


def _of(child: DataFrame, parent: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """child with columns of its parent under new names; rows without a parent are left out."""
    return child.join(parent.select(key, *[F.col(c).alias(name) for c, name in columns.items()]), key)


def ingest_checks(t: Tables) -> dict[str, DataFrame]:
    """After cards are taken in: repeated keys, rows without a parent, suppliers that differ, matches that can't be."""
    c = F.col
    products, matches = t["products"], t["matches"]
    codes = t["suppliers"].select("supplier_id", F.col("code").alias("_code"))
    orphans = {f"orphan_{name}": C.references(t[name], ["product_id"], products, ["product_id"]) for name in ("offers", "properties", "media", "options", "urls")}
    ends = t["relations"].join(products.select(c("product_id").alias("from_product"), c("supplier_id").alias("_a")), "from_product").join(products.select(c("product_id").alias("to_product"), c("supplier_id").alias("_b")), "to_product")
    mapped = matches.filter("is_current and auto_accepted").select("product_id", c("catalog_id").alias("_said"))
    return {
        "duplicate_stable_external_ids": C.unique(products, ["supplier_id", "external_id"], c("stable")), "duplicate_default_offers": C.unique(t["offers"], ["product_id"], c("kind") == "default"),
        "alias_duplicate_products": t["urls"].groupBy("url").agg(F.min("product_id").alias("a"), F.max("product_id").alias("b")).filter("a < b"),
        "orphan_products": C.references(products, ["supplier_id"], t["suppliers"], ["supplier_id"]), **orphans,
        "cross_supplier_products": products.join(codes, "supplier_id").filter(c("declared_supplier").isNotNull() & (c("declared_supplier") != c("_code"))),
        "cross_supplier_offers": _of(t["offers"], products, "product_id", {"supplier_id": "_s"}).filter(c("supplier_id") != c("_s")),
        "cross_supplier_memberships": _of(t["memberships"], products, "product_id", {"supplier_id": "_s"}).filter(c("supplier_id") != c("_s")),
        "cross_supplier_relations": ends.filter((c("supplier_id") != c("_a")) | (c("supplier_id") != c("_b"))),
        "identifier_code_mismatch": t["identifiers"].join(codes, "supplier_id").filter(c("supplier_code") != c("_code")), "identifier_without_supplier": t["identifiers"].filter("supplier_id is null"),
        "several_current_matches": C.one_current(matches, "product_id", "is_current"), "impossible_catalog_mapping": products.join(mapped, "product_id").filter(~c("catalog_id").eqNullSafe(c("_said"))),
        "fuzzy_auto_matches": matches.filter(c("auto_accepted") & c("method").isin(*FUZZY)),
        "cross_supplier_article_matches": _of(matches.filter("auto_accepted and method like 'SUPPLIER_ARTICLE%'"), products, "product_id", {"supplier_id": "supplier_id"}).join(codes, "supplier_id").filter(F.coalesce(F.get_json_object("evidence", "$.supplier_code"), F.lit("")) != c("_code")),
        "false_link_conflicts": false_link_conflicts(matches),
    }


def false_link_conflicts(matches: DataFrame) -> DataFrame:
    """Current conflicts after an accepted match whose evidence names no conflict of identity."""
    before = matches.filter("auto_accepted").select(F.col("event_id").alias("previous_id"))
    now = matches.filter((F.col("is_current")) & (F.col("status") == "CONFLICT") & (F.coalesce(F.get_json_object("evidence", "$.conflict_class"), F.lit("")) != "IDENTITY_CONFLICT"))
    return now.join(before, "previous_id", "left_semi")


def selection_checks(t: Tables) -> dict[str, DataFrame]:
    """After offers are selected: one row per product, chosen offers that exist, belong, are active and fresh, and evidence."""
    c = F.col
    selections, products = t["selections"], t["products"]
    linked = products.filter("catalog_id is not null").select("catalog_id").distinct()
    offers = t["offers"].select("offer_id", "product_id", c("supplier_id").alias("offer_supplier"), c("active").alias("offer_active"), "availability", c("missed").alias("offer_missed"), c("success_at").alias("offer_success"))
    owners = products.select("product_id", c("supplier_id").alias("supplier_id"), c("catalog_id").alias("linked"), c("active").alias("product_active"), c("missed").alias("product_missed"), c("success_at").alias("product_success"))
    chosen = selections.filter("offer_id is not null").select("catalog_id", "status", "offer_id").join(offers, "offer_id").join(owners, "product_id")
    latest = t["runs"].filter("kind = 'full' and status = 'succeeded'").groupBy("supplier_id").agg(F.max("started_at").alias("crawled_at"))
    dated = chosen.join(latest, "supplier_id", "left")
    stale = (c("product_missed") != 0) | (c("offer_missed") != 0)
    late = F.coalesce(c("product_success") < c("crawled_at"), F.lit(True)) | F.coalesce(c("offer_success") < c("crawled_at"), F.lit(True))
    keys = F.coalesce(F.json_object_keys("evidence"), F.array().cast("array<string>"))
    unlinked = chosen.filter("linked is null")
    repeated = selections.groupBy("catalog_id").agg(F.count("*").alias("n")).filter("n <> 1").select("catalog_id")
    return {
        "one_selection_per_product": repeated.unionByName(linked.join(selections, "catalog_id", "left_anti")), "selected_offer_exists": selections.filter("status = 'selected'").join(offers, "offer_id", "left_anti"),
        "selected_offer_of_product": chosen.filter("linked <> catalog_id"), "selected_source_linked": unlinked, "selected_supplier_matches": chosen.filter("offer_supplier <> supplier_id"),
        "selected_offer_active": chosen.filter("not offer_active"), "selected_source_active": chosen.filter("not product_active"),
        "selected_supplier_enabled": chosen.join(t["suppliers"].filter("not enabled").select(c("supplier_id").alias("offer_supplier")), "offer_supplier", "left_semi"),
        "selected_not_discontinued": chosen.filter("availability = 'discontinued'"), "unlinked_source_selected": unlinked,
        "stale_after_unlinking": chosen.filter("status = 'selected' and (linked is null or linked <> catalog_id)"), "cross_supplier_selection": chosen.filter("offer_supplier <> supplier_id"),
        "selected_offer_fresh": dated.filter(stale | late), "evidence_fields": selections.filter(F.size(F.array_except(F.array(*map(F.lit, EVIDENCE)), keys)) > 0),
    }


def conditional_checks(mappings: DataFrame, cases: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Rules that bind one column to another: confirmed mappings have ids, cases are resolved with a class only, some decisions need a comment."""
    c = F.col
    return {
        "confirmed_mapping_has_id": C.must_hold(mappings, (c("status") != "MATCHED") | c("property_id").isNotNull()),
        "resolved_iff_class": cases.filter((c("status") == "RESOLVED") != c("decision_class").isNotNull()),
        "decision_has_comment": C.must_hold(decisions, ~c("decision").isin("MANUAL_CONFIRMED_NEW", "MANUAL_ACCESSORY") | (F.trim(F.coalesce("comment", F.lit(""))) != "")),
    }


def selection_evidence(selected: DataFrame, evaluated: DataFrame, policy, price_rule: str, freshness_rule: str) -> DataFrame:
    """(product_id, evidence): a selection as a JSON document with its evaluated offers in order of supplier and offer.

    The document holds every offer of its product, so it is as large as they are; the counts and the
    decision come from the selection. Offers of several suppliers may share an id, so the chosen one is known
    by supplier and id, and of what still is alike the eligible one of the best rank and priority won.
    """
    c = F.col
    state = F.when(c("price_valid"), "valid").when(c("price") == 0, "zero_invalid_commercial_evidence").otherwise("missing_or_incomparable")
    offer = F.struct(
        c("supplier_code"), c("offer_id"), c("source_id"), c("offer_kind"), c("price"), c("currency"), state.alias("price_classification"), c("availability"), c("quantity"), c("contradiction").alias("quantity_contradiction"),
        F.when(F.size("freshness_reasons") > 0, "stale").otherwise("fresh").alias("freshness"), c("eligible"), c("exclusion_reasons"), c("integrity_errors"), c("rank").alias("availability_rank"), c("priority").alias("supplier_priority"),
    )
    offers = evaluated.groupBy("product_id").agg(F.array_sort(F.collect_list(offer)).alias("candidate_offers"))
    rows = selected.join(offers, "product_id", "left")
    won = F.filter("candidate_offers", lambda x: x["eligible"] & (x["offer_id"] == c("offer_id")) & x["supplier_code"].eqNullSafe(c("supplier_code")))
    best = F.array_min(F.transform(won, lambda x: F.struct(x["availability_rank"].alias("rank"), (-x["supplier_priority"]).alias("unliked"))))
    document = F.struct(
        F.lit(policy.version).alias("policy_version"), c("product_id").alias("catalog_product_id"), c("evaluated").alias("evaluated_candidate_count"), c("eligible").alias("eligible_candidate_count"),
        c("offer_id").alias("selected_offer_id"), c("supplier_code").alias("selected_supplier_code"), c("reason").alias("selection_reason"), best["rank"].alias("availability_rank"),
        (-best["unliked"]).alias("supplier_priority"), F.lit(price_rule).alias("price_rule"), F.lit(freshness_rule).alias("freshness_rule"), c("candidate_offers"),
    )
    return rows.select("product_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("evidence"))


def with_unoffered(selected: DataFrame, products: DataFrame, version: str) -> DataFrame:
    """Selections with a row for every product that has no offer at all: no_eligible_offer, nothing evaluated."""
    lacking = products.select("product_id").distinct().join(selected, "product_id", "left_anti")
    given = {"status": F.lit("no_eligible_offer"), "reason": F.lit("no_eligible_offer"), "evaluated": F.lit(0), "eligible": F.lit(0), "rule_version": F.lit(version)}
    kinds = dict(selected.dtypes)
    return selected.unionByName(lacking.select("product_id", *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in selected.columns if c != "product_id"]))


def require_none(violations: DataFrame, what: str) -> None:
    """Raise if there is a violation: what must not be published stops here."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {'; '.join(map(str, found))}")


def changed_selections(current: DataFrame, selected: DataFrame, values: tuple[str, ...] = ("status", "reason", "offer_id", "rule_version")) -> DataFrame:
    """Selections with `changed`: whether they differ from the current version of their product, or are new."""
    old = current.select("product_id", F.struct(*values).alias("_old"))
    return selected.join(old, "product_id", "left").withColumn("changed", ~F.col("_old").eqNullSafe(F.struct(*values))).drop("_old")
