"""Each selection rule, by one candidate set that differs in one thing."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tallyforge.operators.offers import OfferPolicy, evaluate, integrity_violations, select

NOW = datetime(2026, 9, 3)
DDL = (
    "product_id bigint, offer_id bigint, source_id bigint, supplier_id bigint, offer_supplier_id bigint, supplier_code string, supplier_enabled boolean, source_product_id_link bigint, "
    "source_active boolean, source_missed int, source_success_at timestamp, offer_active boolean, offer_kind string, offer_missed int, offer_success_at timestamp, latest_crawl_at timestamp, "
    "price decimal(18,4), currency string, availability string, quantity decimal(18,4)"
)


def offer(n, **changed):
    row = dict(
        product_id=100, offer_id=n, source_id=n, supplier_id=n, offer_supplier_id=n, supplier_code=f"s{n}", supplier_enabled=True, source_product_id_link=100, source_active=True, source_missed=0,
        source_success_at=NOW, offer_active=True, offer_kind="default", offer_missed=0, offer_success_at=NOW, latest_crawl_at=NOW, price=Decimal(100000), currency="RUB", availability="in_stock", quantity=Decimal(2),
    )
    return {**row, **changed}


CASES = [
    ("lower price", [offer(1), offer(2, price=Decimal(90000))], ("selected", "lowest_valid_price_within_top_business_rank", 2)),
    ("availability first", [offer(1, availability="backorder", price=Decimal(1)), offer(2)], ("selected", "availability_and_supplier_priority_winner", 2)),
    ("tie", [offer(2), offer(1)], ("selected", "deterministic_tie_break_after_equal_business_inputs", 1)),
    ("currencies", [offer(1), offer(2, currency="EUR")], ("review", "top_candidate_currency_comparison_required", None)),
    ("discontinued", [offer(1, availability="discontinued")], ("no_eligible_offer", "no_eligible_offer", None)),
    ("unknown state", [offer(1, availability="strange")], ("no_eligible_offer", "no_eligible_offer", None)),
    ("single without price", [offer(1, price=None)], ("selected", "single_eligible_current_offer", 1)),
    ("several without price", [offer(1, price=None), offer(2, price=Decimal(0))], ("review", "multiple_top_offers_without_comparable_valid_price", None)),
    ("single contradiction", [offer(1, quantity=Decimal(0))], ("review", "in_stock_quantity_zero_contradiction", None)),
    ("contradiction on top", [offer(1, quantity=Decimal(0)), offer(2)], ("review", "top_candidate_in_stock_quantity_zero_contradiction", None)),
    ("duplicate", [offer(1), offer(2, source_id=1)], ("review", "duplicate_offer_kind_for_source_product", None)),
    ("ambiguous supplier", [offer(1), offer(2, supplier_code="s1")], ("review", "same_supplier_multiple_source_products_identity_ambiguity", None)),
    ("stale", [offer(1, offer_success_at=datetime(2026, 9, 1))], ("no_eligible_offer", "no_eligible_offer", None)),
    ("missed", [offer(1, source_missed=1), offer(2)], ("selected", "single_eligible_current_offer", 2)),
    ("disabled", [offer(1, supplier_enabled=None), offer(2)], ("selected", "single_eligible_current_offer", 2)),
]


@pytest.mark.parametrize("name, rows, expected", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, name, rows, expected):
    columns = [f.split(" ")[0] for f in DDL.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], DDL)
    policy = OfferPolicy()
    got = select(evaluate(df, policy), policy).collect()
    assert [(r.status, r.reason, r.offer_id) for r in got] == [expected]


def test_priority_and_stale_fallback(spark):
    columns = [f.split(" ")[0] for f in DDL.split(", ")]
    rows = [offer(1), offer(2, price=Decimal(1), offer_success_at=None)]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], DDL)
    policy = OfferPolicy(priorities={"s1": 5}, allow_stale=True)
    assert select(evaluate(df, policy), policy).first().offer_id == 1
    loose = OfferPolicy(allow_stale=True)
    assert select(evaluate(df, loose), loose).first().offer_id == 2


def test_integrity(spark):
    columns = [f.split(" ")[0] for f in DDL.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in (offer(1, source_product_id_link=5), offer(2, offer_supplier_id=9), offer(3))], DDL)
    found = {r.offer_id: r.integrity_errors for r in integrity_violations(evaluate(df, OfferPolicy())).collect()}
    assert found == {1: ["source_product_catalog_product_mismatch"], 2: ["offer_supplier_mismatch"]}
