"""Best-offer selection: eligibility, ranking and deterministic decision per catalog product.

Candidate columns: product_id, offer_id, source_id, supplier_id, offer_supplier_id, supplier_code,
supplier_enabled, source_product_id_link (the product its source is linked to), source_active,
source_missed, source_success_at, offer_active, offer_kind, offer_missed, offer_success_at,
latest_crawl_at, price, currency, availability, quantity; and, if there is a table of priorities, a
column supplier_priority that goes before the policy's.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import first_match

#: Default availability ranks.
RANKS = {"in_stock": 0, "incoming": 1, "preorder": 2, "backorder": 2, "unknown": 3, "out_of_stock": 4, "discontinued": 5}


@dataclass(frozen=True)
class OfferPolicy:
    """A selection policy; priorities: higher is better."""

    version: str = "offer-selection-v1"
    kinds: tuple[str, ...] = ("default",)
    ranks: Mapping[str, int] = field(default_factory=lambda: dict(RANKS))
    excluded: tuple[str, ...] = ("discontinued",)
    priorities: Mapping[str, int] = field(default_factory=dict)
    default_priority: int = 0
    review_contradictions: bool = True
    need_no_misses: bool = True
    need_success_times: bool = True
    need_latest_crawl: bool = True
    allow_stale: bool = False

    def __post_init__(self) -> None:
        if not self.version.strip() or not self.kinds or not self.ranks:
            raise ValueError("a policy needs a version, offer kinds and availability ranks")


#: The keys of a policy's JSON.
POLICY_KEYS = (
    "version", "ranking_order", "allowed_offer_kinds", "availability_ranking", "ineligible_availability", "supplier_priority", "default_supplier_priority", "price_strategy", "unknown_price_behavior",
    "zero_price_behavior", "unknown_availability_behavior", "quantity_contradiction_behavior", "freshness", "deterministic_tie_break",
)


def read_policy(text: str) -> OfferPolicy:
    """The policy that a JSON text says; missing keys, an empty version and other price strategies raise."""
    said = json.loads(text)
    if missing := sorted(set(POLICY_KEYS) - said.keys()):
        raise ValueError("the policy lacks " + ", ".join(missing))
    if not str(said["version"]).strip() or said["price_strategy"] != "lowest_valid_price":
        raise ValueError("a policy needs a version and the price strategy lowest_valid_price")
    fresh = said["freshness"]
    return OfferPolicy(
        str(said["version"]), tuple(said["allowed_offer_kinds"]), {str(k): int(v) for k, v in said["availability_ranking"].items()}, tuple(sorted(map(str, said["ineligible_availability"]))),
        {str(k): int(v) for k, v in said["supplier_priority"].items()}, int(said["default_supplier_priority"]), said["quantity_contradiction_behavior"] == "review",
        bool(fresh.get("require_missed_crawls_zero", True)), bool(fresh.get("require_success_timestamps", True)), bool(fresh.get("require_latest_successful_full_crawl", True)), bool(fresh.get("allow_stale_fallback", False)),
    )


def _lookup(values: Mapping[str, int], key: Column, default: int | None = None) -> Column:
    if not values:
        return F.lit(default).cast("int")
    pairs = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default).cast("int"))


def _reasons(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for condition, name in found]))


def evaluate(candidates: DataFrame, policy: OfferPolicy) -> DataFrame:
    """Candidates with reasons of exclusion and staleness, integrity errors and ranking inputs."""
    c, never = F.col, F.lit(False)
    stale = _reasons(
        (c("source_missed") != 0 if policy.need_no_misses else never, "source_product_missed_crawls"),
        (c("offer_missed") != 0 if policy.need_no_misses else never, "offer_missed_crawls"),
        (c("source_success_at").isNull() if policy.need_success_times else never, "source_product_missing_last_success_at"),
        (c("offer_success_at").isNull() if policy.need_success_times else never, "offer_missing_last_success_at"),
        (c("latest_crawl_at").isNull() if policy.need_latest_crawl else never, "no_successful_full_supplier_crawl"),
        (c("latest_crawl_at").isNotNull() & (c("source_success_at").isNull() | (c("source_success_at") < c("latest_crawl_at"))) if policy.need_latest_crawl else never, "source_product_not_confirmed_by_latest_crawl"),
        (c("latest_crawl_at").isNotNull() & (c("offer_success_at").isNull() | (c("offer_success_at") < c("latest_crawl_at"))) if policy.need_latest_crawl else never, "offer_not_confirmed_by_latest_crawl"),
    )
    integrity = _reasons(
        (~c("source_product_id_link").eqNullSafe(c("product_id")), "source_product_catalog_product_mismatch"),
        (~c("offer_supplier_id").eqNullSafe(c("supplier_id")), "offer_supplier_mismatch"),
    )
    rank = _lookup(policy.ranks, c("availability"))
    excluded = _reasons(
        (~F.coalesce(c("supplier_enabled"), never), "supplier_disabled"),
        (~F.coalesce(c("source_active"), never), "source_product_inactive"),
        (~F.coalesce(c("offer_active"), never), "offer_inactive"),
        (~F.coalesce(c("offer_kind").isin(*policy.kinds), never), "offer_kind_not_allowed"),
        (c("availability").isin(*policy.excluded) if policy.excluded else never, "availability_not_eligible"),
        (c("rank").isNull(), "availability_not_configured"),
    )
    priority = _lookup(policy.priorities, c("supplier_code"), policy.default_priority)
    if "supplier_priority" in candidates.columns:
        priority = F.coalesce(c("supplier_priority"), priority)
    rows = candidates.withColumns({"rank": rank, "priority": priority, "freshness_reasons": stale, "integrity_errors": integrity})
    whole = F.concat(excluded, F.lit([]).cast("array<string>") if policy.allow_stale else c("freshness_reasons"), c("integrity_errors"))
    rows = rows.withColumn("exclusion_reasons", whole)
    return rows.withColumns({
        "eligible": F.size("exclusion_reasons") == 0,
        "price_valid": F.coalesce((c("price") > 0) & (F.coalesce(c("currency"), F.lit("")) != ""), never),
        "contradiction": F.coalesce((c("availability") == "in_stock") & (c("quantity") == 0), never),
    })


def integrity_violations(evaluated: DataFrame) -> DataFrame:
    """Candidates whose links are broken: a selection over them must not be published."""
    return evaluated.filter(F.size("integrity_errors") > 0).select("product_id", "offer_id", "integrity_errors")


def _per_product(evaluated: DataFrame) -> DataFrame:
    """Counts of a product's offers, whether a source repeats an offer kind, and whether eligible offers of a supplier have several sources."""
    pairs = evaluated.groupBy("product_id", "source_id", "offer_kind").agg(F.count("*").alias("n"), F.count_if("eligible").alias("ok"), F.min("supplier_code").alias("supplier_code"))
    source = F.when(F.col("ok") > 0, F.col("source_id"))
    suppliers = pairs.groupBy("product_id", "supplier_code").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), (F.max("n") > 1).alias("repeated"), (F.min(source) < F.max(source)).alias("several"))
    return suppliers.groupBy("product_id").agg(F.sum("n").alias("evaluated"), F.sum("ok").alias("eligible"), F.bool_or("repeated").alias("repeated"), F.coalesce(F.bool_or("several"), F.lit(False)).alias("several"))


def _finalists(evaluated: DataFrame, carry: Sequence[str]) -> DataFrame:
    """What the rules read of a product's eligible offers of the best availability rank and, in it, priority.

    Each rank and priority is reduced on its own, then the best of them stays: nothing is gathered.
    """
    c, price = F.col, F.col("price")
    offer = F.struct("supplier_code", "offer_id", "source_id", "offer_kind", "supplier_id", "price", *carry)
    name = F.struct("supplier_code", "offer_id", "source_id", "offer_kind")
    priced = c("price_valid")
    tiers = evaluated.filter("eligible").groupBy("product_id", "rank", "priority").agg(
        F.count("*").alias("n"), F.bool_or("contradiction").alias("contradiction"), F.count_if(priced).alias("n_priced"),
        F.min(F.when(priced, c("currency"))).alias("currency"), F.max(F.when(priced, c("currency"))).alias("other_currency"), F.min_by(offer, name).alias("one"),
        F.min_by(F.when(priced, offer), F.when(priced, F.struct("price", name))).alias("cheap"), F.max_by(F.when(priced, name), F.when(priced, F.struct(-price, name))).alias("last_cheap"),
    )
    rest = [x for x in tiers.columns if x != "product_id"]
    return tiers.groupBy("product_id").agg(F.min_by(F.struct(*rest), F.struct("rank", -c("priority"))).alias("t"))


def select(evaluated: DataFrame, policy: OfferPolicy, carry: Sequence[str] = ()) -> DataFrame:
    """One decision per product: status, reason, the winner with its `carry` columns, and counts, in the order of the rules.

    Everything the rules read is an aggregate that combines on the map side, so that a product with most
    of the offers stays a few rows.
    """
    c = F.col
    best = _finalists(evaluated, carry).withColumnRenamed("product_id", "_product")
    # A plain equality would keep null products from one of both sides alone, and the offers would be made and moved for each.
    rows = _per_product(evaluated).join(best, c("product_id").eqNullSafe(c("_product")) & c("product_id").isNotNull(), "left")
    contradiction = F.lit(policy.review_contradictions) & F.coalesce("t.contradiction", F.lit(False))
    alone = F.struct(*[c(f"t.cheap.{x}") for x in ("supplier_code", "offer_id", "source_id", "offer_kind")]) == c("t.last_cheap")
    rules: list[tuple[Column, str, str, Column | None]] = [
        (c("repeated"), "review", "duplicate_offer_kind_for_source_product", None),
        (c("eligible") == 0, "no_eligible_offer", "no_eligible_offer", None),
        (c("several"), "review", "same_supplier_multiple_source_products_identity_ambiguity", None),
        ((c("eligible") == 1) & contradiction, "review", "in_stock_quantity_zero_contradiction", None),
        (c("eligible") == 1, "selected", "single_eligible_current_offer", c("t.one")),
        (contradiction, "review", "top_candidate_in_stock_quantity_zero_contradiction", None),
        (c("t.n") == 1, "selected", "availability_and_supplier_priority_winner", c("t.one")),
        (c("t.n_priced") == 0, "review", "multiple_top_offers_without_comparable_valid_price", None),
        (c("t.currency") < c("t.other_currency"), "review", "top_candidate_currency_comparison_required", None),
        (alone, "selected", "lowest_valid_price_within_top_business_rank", c("t.cheap")),
    ]
    last = ("selected", "deterministic_tie_break_after_equal_business_inputs", c("t.cheap"))
    status = first_match([(test, s) for test, s, _, _ in rules], last[0])
    reason = first_match([(test, r) for test, _, r, _ in rules], last[1])
    winner = first_match([(test, w) for test, _, _, w in rules], last[2])
    out = rows.withColumns({"status": status, "reason": reason, "w": winner})
    names = ("offer_id", "supplier_id", "supplier_code", "price", *carry)
    return out.select("product_id", "status", "reason", *[c(f"w.{x}").alias(x) for x in names], "evaluated", "eligible", F.lit(policy.version).alias("rule_version"))
