"""Queries in which every rule of the feed, of offer selection and of the text functions fires, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.units import to_unit
from tallyforge.operators import feed, offers
from tallyforge.operators import registry as R
from tallyforge.session import table as t
from tallyforge.sources import pages

#: The codes that a row breaks which is wrong in one thing, by its number: 0 is right.
_CODES = (
    "", "NOT_SELECTED", "MISSING_SELECTED_OFFER;SELECTED_OFFER_MISMATCH", "SELECTED_OFFER_MISMATCH", "MISSING_SOURCE_PRODUCT", "SOURCE_CATALOG_PRODUCT_MISMATCH", "SUPPLIER_RELATIONSHIP_MISMATCH",
    "NO_CURRENT_ACCEPTED_MATCH", "MATCH_CATALOG_PRODUCT_MISMATCH", "DISABLED_OR_MISSING_SUPPLIER", "INACTIVE_OR_MISSING_SOURCE_PRODUCT", "INACTIVE_OR_MISSING_SELECTED_OFFER", "INACTIVE_OR_MISSING_TARGET_PRODUCT",
    "MISSING_TARGET_ID", "MISSING_TARGET_NAME", "INVALID_TARGET_URL", "MISSING_TARGET_CATEGORY_ID", "MISSING_TARGET_CATEGORY_NAME", "NULL_SELECTED_PRICE", "NON_POSITIVE_SELECTED_PRICE", "UNSUPPORTED_CURRENCY",
    "UNMAPPED_AVAILABILITY", "UNMAPPED_AVAILABILITY;DISCONTINUED_SELECTED_OFFER", "MISSING_SELECTION_POLICY_VERSION",
)


def feed_codes(s: SparkSession, d: str) -> DataFrame:
    """Every part as a feed row that is wrong in one thing; all codes of rows."""
    k = F.col("p_partkey")

    def off(number: int, right: Column, wrong: Column | None = None) -> Column:
        return F.when(k % len(_CODES) == number, wrong).otherwise(right)

    rows = t(s, d, "part").select(
        k.alias("catalog_product_id"), off(1, F.lit("selected"), F.lit("review")).alias("selection_status"), off(2, k).alias("selected_offer_id"), off(3, k, k + 1).alias("offer_id"), off(4, k).alias("source_product_id"),
        off(5, k, k + 1).alias("source_catalog_product_id"), F.lit(7).alias("offer_supplier_id"), off(6, F.lit(7), F.lit(8)).alias("source_supplier_id"), off(7, F.lit("EXACT_MATCH"), F.lit("REVIEW")).alias("match_status"),
        off(8, k).alias("match_catalog_product_id"), off(9, F.lit(True), F.lit(False)).alias("supplier_enabled"), off(10, F.lit(True)).alias("source_active"), off(11, F.lit(True), F.lit(False)).alias("offer_active"),
        off(12, F.lit(True)).alias("target_active"), off(13, k.cast("string"), F.lit(" ")).alias("target_id"), off(14, F.col("p_name")).alias("target_name"), off(15, F.lit("https://h/p"), F.lit("ftp://h/p")).alias("target_url"),
        off(16, F.lit("c")).alias("category_id"), off(17, F.lit("C"), F.lit("")).alias("category_name"), F.when(k % len(_CODES) == 19, -1).otherwise(off(18, F.lit(5))).cast("decimal(18,4)").alias("price"),
        off(20, F.lit("RUB"), F.lit("EUR")).alias("currency"), F.when(k % len(_CODES) == 22, "discontinued").otherwise(off(21, F.lit("in_stock"), F.lit("soon"))).alias("availability"), off(23, F.lit("v1"), F.lit("")).alias("rule_version"),
    )
    return rows.select("catalog_product_id", F.array_join(feed.row_violations(rows), ";").alias("codes"))


FEED_CODES = f"SELECT p_partkey AS catalog_product_id, [{', '.join(repr(c) for c in _CODES)}][p_partkey % {len(_CODES)} + 1] AS codes FROM part"


def feed_set_codes(s: SparkSession, d: str) -> DataFrame:
    """The codes over all rows: repeated products, repeated offer ids, mixed policies, and a wrong count."""
    k = F.col("p_partkey")
    rows = t(s, d, "part").select(F.when(k < 10, 1).otherwise(k).alias("catalog_product_id"), F.when(k % 50 == 3, "x").otherwise(k.cast("string")).alias("target_id"), F.when(k % 2 == 0, "v1").otherwise("v2").alias("rule_version"))
    return feed.set_violations(rows, expected=3)


FEED_SET_CODES = """
WITH r AS (SELECT CASE WHEN p_partkey < 10 THEN 1 ELSE p_partkey END AS c, CASE WHEN p_partkey % 50 = 3 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS i FROM part)
SELECT 'DUPLICATE_CATALOG_PRODUCT' AS code, c || ':' || count(*) AS detail FROM r GROUP BY c HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_FEED_OFFER_ID', i || ':' || count(*) FROM r GROUP BY i HAVING count(*) > 1
UNION ALL SELECT 'MIXED_SELECTION_POLICY_VERSIONS', 'v1,v2' UNION ALL SELECT 'SELECTED_JOIN_CARDINALITY', count(*) || '!=3' FROM r
"""
#: Status, reason and winner of the product whose number is the rule's.
_SELECTED = (
    ("review", "duplicate_offer_kind_for_source_product", None), ("no_eligible_offer", "no_eligible_offer", None), ("review", "same_supplier_multiple_source_products_identity_ambiguity", None),
    ("review", "in_stock_quantity_zero_contradiction", None), ("selected", "single_eligible_current_offer", 1), ("review", "top_candidate_in_stock_quantity_zero_contradiction", None),
    ("selected", "availability_and_supplier_priority_winner", 1), ("review", "multiple_top_offers_without_comparable_valid_price", None), ("review", "top_candidate_currency_comparison_required", None),
    ("selected", "lowest_valid_price_within_top_business_rank", 2), ("selected", "deterministic_tie_break_after_equal_business_inputs", 1),
)


def offer_rules(s: SparkSession, d: str) -> DataFrame:
    """Every part with one or two offers that fit one rule of the selection; all rules."""
    k, o, c = F.col("p_partkey"), F.col("o"), F.col
    rows = t(s, d, "part").select("p_partkey", (k % len(_SELECTED)).alias("r"), F.explode(F.array(F.lit(1), F.lit(2))).alias("o")).filter("o = 1 or r not in (1, 3, 4)")
    at, yes, r = F.lit("2026-01-01").cast("timestamp"), F.lit(True), c("r")
    supplier = F.when(r.isin(0, 2), 1).otherwise(o)
    made = rows.select(
        k.alias("product_id"), (k * 10 + o).alias("offer_id"), F.when(r == 0, 1).otherwise(o).alias("source_id"), supplier.alias("supplier_id"), supplier.alias("offer_supplier_id"), F.concat(F.lit("s"), supplier).alias("supplier_code"),
        yes.alias("supplier_enabled"), k.alias("source_product_id_link"), yes.alias("source_active"), F.lit(0).alias("source_missed"), at.alias("source_success_at"), (r != 1).alias("offer_active"), F.lit("default").alias("offer_kind"),
        F.lit(0).alias("offer_missed"), at.alias("offer_success_at"), at.alias("latest_crawl_at"), F.when(r != 7, F.when((r == 9) & (o == 2), 9).otherwise(10)).cast("decimal(18,4)").alias("price"),
        F.when((r == 8) & (o == 2), "EUR").otherwise("RUB").alias("currency"), F.when((r == 6) & (o == 2), "backorder").otherwise("in_stock").alias("availability"), F.when(r.isin(3, 5) & (o == 1), 0).otherwise(5).alias("quantity"),
    )
    policy = offers.OfferPolicy()
    return offers.select(offers.evaluate(made, policy), policy).select("product_id", "status", "reason", "offer_id", "evaluated", "eligible")


OFFER_RULES = f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % {len(_SELECTED)} AS r FROM part)
SELECT k AS product_id, [{', '.join(repr(x[0]) for x in _SELECTED)}][r + 1] AS status, [{', '.join(repr(x[1]) for x in _SELECTED)}][r + 1] AS reason, k * 10 + [{', '.join(str(x[2] or 'NULL') for x in _SELECTED)}][r + 1] AS offer_id,
  CASE WHEN r IN (1, 3, 4) THEN 1 ELSE 2 END AS evaluated, CASE WHEN r = 1 THEN 0 WHEN r IN (3, 4) THEN 1 ELSE 2 END AS eligible FROM p
"""


def text_functions(s: SparkSession, d: str) -> DataFrame:
    """Amounts, availability, units, names and models as suppliers write them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    says = F.element_at(F.array(*map(F.lit, ("В наличии  12 шт.", "Товар под заказ", "Снят с производства", "Нет в наличии", "в НАЛИЧИИ", "уточняйте"))), (k % 6 + 1).cast("int"))
    model, other = F.concat(F.lit("tu"), k), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("tu"))).when(k % 3 == 1, F.concat(F.lit("tu"), k, F.lit("v"))).otherwise(F.concat(F.lit("tu"), k, F.lit("max")))
    state = X.availability_of(says)
    price = F.when(k % 5 == 0, F.lit("0 ₽")).when(k % 5 == 1, F.lit("по запросу")).otherwise(F.concat(size, F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 5 == 2, ",5").when(k % 5 == 3, ".25").otherwise(""), F.lit(" ₽ за шт")))
    return t(s, d, "part").select(
        k, X.decimal_of(F.concat(size, F.lit(" 0"), k % 10, F.lit(","), size), "decimal(18,2)").alias("amount"), X.price_of(price).alias("price"), state["state"].alias("state"), state["stock"].alias("stock"),
        X.unit_of_name(F.when(k % 2 == 0, F.concat(F.lit("Размер, внешний, "), F.lit("мм "))).otherwise("Размер")).alias("unit"), X.normalized_name(F.concat(F.lit("Ёлка — "), size, F.lit("×"), k, F.lit(" х/TU-"), size)).alias("name"),
        X.same_parts(model, other).alias("same_parts"), X.short_suffix(model, other).alias("short_suffix"), X.plain_decimal((size / 4).cast("decimal(18,4)")).alias("plain"),
        X.money_of(F.when(k % 4 == 0, "цена?").when(k % 4 == 1, "1-2-3").otherwise(F.concat(F.lit("от "), size, F.lit(" "), F.lit("000,5 руб")))).alias("money"), X.currency_of(F.element_at(F.array(*map(F.lit, ("руб.", " ₽", "Rur", "euro", "usd"))), (k % 5 + 1).cast("int"))).alias("currency"),
    )


TEXT_FUNCTIONS = """
SELECT p_partkey, CAST(p_size || '0' || (p_partkey % 10) || '.' || p_size AS DECIMAL(18,2)) AS amount,
  CASE WHEN p_partkey % 5 > 1 THEN CAST(p_size || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || CASE p_partkey % 5 WHEN 2 THEN '.50' WHEN 3 THEN '.25' ELSE '.00' END AS DECIMAL(18,2)) END AS price,
  ['in_stock', 'on_request', 'discontinued', 'out_of_stock', 'in_stock', NULL][p_partkey % 6 + 1] AS state, CASE WHEN p_partkey % 6 = 0 THEN 12 END AS stock, CASE WHEN p_partkey % 2 = 0 THEN 'мм' END AS unit,
  'елка ' || p_size || 'x' || p_partkey || ' x tu ' || p_size AS name, p_partkey % 3 = 0 AS same_parts, p_partkey % 3 = 1 AS short_suffix,
  CASE p_size % 4 WHEN 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE (p_size // 4) || ['.25', '.5', '.75'][p_size % 4] END AS plain,
  CASE WHEN p_partkey % 4 > 1 THEN CAST(p_size || '000.5' AS DECIMAL(18,4)) END AS money, ['RUB', 'RUB', 'RUB', 'EUR', 'USD'][p_partkey % 5 + 1] AS currency FROM part
"""


def unit_conversion(s: SparkSession, d: str) -> DataFrame:
    """Values in other units, and what can't be converted."""
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ("мм", "см", "M", "кг", "попугай", "mm"))), (k % 6 + 1).cast("int"))
    found = to_unit(F.when(k % 6 == 5, "около 5").otherwise(F.concat(F.col("p_size"), F.lit(",5"))), unit, F.when(k % 4 == 0, "cm").otherwise("мм"))
    return t(s, d, "part").select("p_partkey", found["value"].cast("decimal(18,4)").alias("value"), found["unit"].alias("unit"), found["status"].alias("status"))


UNIT_CONVERSION = """
SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN CAST(CAST(p_size || '.5' AS DECIMAL(10,1)) * [1, 10, 1000][p_partkey % 6 + 1] / CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 1 END AS DECIMAL(18,4)) END AS value,
  CASE WHEN p_partkey % 4 = 0 THEN 'cm' ELSE 'mm' END AS unit, ['NORMALIZED', 'NORMALIZED', 'NORMALIZED', 'INCOMPATIBLE_DIMENSION', 'UNKNOWN_UNIT', 'INVALID_NUMERIC'][p_partkey % 6 + 1] AS status FROM part
"""



def _snapshot(s: SparkSession, d: str, name: Column, captured: str, where: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    prop = lambda code, value: F.struct(F.lit(7).alias("property_id"), F.lit(code).alias("property_code"), value.alias("value"))
    held = F.when(k % 4 == 0, F.concat(F.lit('["A-'), k, F.lit('",{"valueEnum":"","value":{"value":"B '), size, F.lit('"}}]'))).when(k % 4 == 1, F.concat(F.lit('{"valueEnum":"C'), k, F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit(" d"), k)).otherwise("  ")
    return t(s, d, "part").filter(where).select(
        k.alias("id"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("art"), k)).otherwise("").alias("article_raw"), F.lit(None).cast("string").alias("supplier_article_raw"), F.lit("").alias("normalized_supplier_article"),
        F.when(k % 2 == 0, "Jet  Tools").otherwise("").alias("brand_raw"), F.col("p_brand").alias("manufacturer_raw"), F.concat(F.lit("TU-"), k).alias("model_raw"), size.alias("category_id"), F.col("p_type").alias("category_name"),
        F.lit("").alias("category_path"), F.array(size).alias("category_ids"), F.array(prop("OWN", held), prop("COLOR", F.lit("red"))).alias("properties"), F.lit(" https://h/p ").alias("product_url"),
        F.element_at(F.array(*map(F.lit, ("y", "N", "true", "1", "0"))), (k % 5 + 1).cast("int")).alias("active"), F.lit(None).cast("string").alias("raw_data"), F.concat(F.lit("h"), k).alias("snapshot_hash"), F.lit(captured).alias("captured_at"),
    )


def registry_upsert(s: SparkSession, d: str) -> DataFrame:
    """The registry after two snapshots, of which the second has other names and other products."""
    first = R.registry_rows(_snapshot(s, d, F.col("p_name"), "2026-01-01", "p_partkey % 7 <> 0"))
    return R.upsert_registry(first, R.registry_rows(_snapshot(s, d, F.concat(F.lit("New "), "p_name"), "2026-02-02", "p_partkey % 7 = 0 or p_partkey % 5 = 0")))


REGISTRY_UPSERT = """
WITH x AS (SELECT *, p_partkey % 7 <> 0 AS was, p_partkey % 7 = 0 OR p_partkey % 5 = 0 AS is_ FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN is_ THEN 'New ' ELSE '' END || p_name AS name, CASE WHEN is_ THEN 'new ' ELSE '' END || p_name AS normalized_name, CASE WHEN p_partkey % 3 = 0 THEN 'art' || p_partkey END AS article_raw,
  CAST(NULL AS VARCHAR) AS supplier_article_raw, CAST(NULL AS VARCHAR) AS normalized_supplier_article, CASE WHEN p_partkey % 2 = 0 THEN 'Jet  Tools' END AS brand_raw, CASE WHEN p_partkey % 2 = 0 THEN 'jet' END AS normalized_brand,
  p_brand AS manufacturer_raw, 'TU-' || p_partkey AS model_raw, 'tu' || p_partkey AS normalized_model, CAST(p_size AS VARCHAR) AS category_id, p_type AS category_name, CAST(NULL AS VARCHAR) AS category_path, '{"category_ids":[' || p_size || ']}' AS category_metadata,
  '{"items":[{"property_id":7,"property_code":"OWN","value":"' || CASE p_partkey % 4 WHEN 0 THEN '[\\"A-' || p_partkey || '\\",{\\"valueEnum\\":\\"\\",\\"value\\":{\\"value\\":\\"B ' || p_size || '\\"}}]' WHEN 1 THEN '{\\"valueEnum\\":\\"C' || p_partkey || '\\"}' WHEN 2 THEN ' d' || p_partkey ELSE '  ' END
    || '"},{"property_id":7,"property_code":"COLOR","value":"red"}]}' AS properties, 'https://h/p' AS product_url, p_partkey % 5 IN (0, 2, 3) AS active, '{}' AS raw_data, 'h' || p_partkey AS snapshot_hash,
  CASE WHEN was THEN '2026-01-01' ELSE '2026-02-02' END AS first_seen_at, CASE WHEN is_ THEN '2026-02-02' ELSE '2026-01-01' END AS last_seen_at, CASE WHEN is_ THEN '2026-02-02' ELSE '2026-01-01' END AS last_synced_at FROM x
"""


def registry_identifiers(s: SparkSession, d: str) -> DataFrame:
    return R.registry_identifiers(_snapshot(s, d, F.col("p_name"), "2026-01-01", "true"), {"OWN": "sup"})


REGISTRY_IDENTIFIERS = """
WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'A-' || p_partkey WHEN 1 THEN 'C' || p_partkey WHEN 2 THEN 'd' || p_partkey END AS raw FROM part UNION ALL SELECT p_partkey, 'B ' || p_size FROM part WHERE p_partkey % 4 = 0)
SELECT DISTINCT CAST(k AS VARCHAR) AS id, 'sup' AS supplier_code, 7 AS property_id, 'OWN' AS property_code, raw AS raw_value, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS normalized_value FROM v WHERE raw IS NOT NULL
"""


def publication_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts as selections, lines as offers, suppliers twice: sources and suppliers; some of each are missing."""
    c, part, supplier = F.col, t(s, d, "part"), t(s, d, "supplier")
    lines = t(s, d, "lineitem").groupBy(c("l_partkey").alias("catalog_id")).agg(F.min(c("l_orderkey") * 10 + c("l_linenumber")).alias("offer_id"), F.min_by("l_suppkey", c("l_orderkey") * 10 + c("l_linenumber")).alias("source_id"))
    selections = part.join(lines.select(c("catalog_id").alias("p_partkey"), "offer_id"), "p_partkey", "left").select(c("p_partkey").alias("catalog_id"), F.when(c("p_partkey") % 6 == 0, "review").otherwise("selected").alias("status"), "offer_id", F.lit("v1").alias("rule_version"))
    offers = lines.filter("offer_id % 9 <> 0").select("offer_id", "source_id", c("source_id").alias("supplier_id"), F.when(c("offer_id") % 2 == 0, " ").alias("sku"), c("offer_id").cast("decimal(18,4)").alias("price"), F.lit(None).cast("decimal(18,4)").alias("old_price"), F.lit("RUB").alias("currency"), F.lit("in_stock").alias("availability"), F.lit(1).alias("quantity"), F.lit(True).alias("active"))
    sources = supplier.filter("s_suppkey % 4 <> 1").select(c("s_suppkey").alias("source_id"), c("s_suppkey").alias("supplier_id"), c("s_nationkey").alias("catalog_id"), c("s_name").alias("external_id"), F.concat(F.lit(" S"), "s_suppkey").alias("sku"), F.lit(True).alias("active"))
    suppliers = supplier.filter("s_suppkey % 5 <> 2").select(c("s_suppkey").alias("supplier_id"), c("s_name").alias("code"), (c("s_suppkey") % 2 == 0).alias("enabled"))
    targets = part.filter("p_partkey % 8 <> 3").select(c("p_partkey").alias("catalog_id"), c("p_partkey").alias("target_id"), c("p_name").alias("name"), F.lit("u").alias("url"), c("p_type").alias("category_id"), c("p_type").alias("category_name"), c("p_brand").alias("brand"), F.lit(" ").alias("article"), F.lit(True).alias("active"))
    matches = supplier.select(c("s_suppkey").alias("source_id"), c("s_nationkey").alias("catalog_id"), F.explode(F.array(F.lit("EXACT_MATCH"), F.lit("OLD"))).alias("status")).withColumn("is_current", (c("status") != "OLD") & (c("source_id") % 3 != 0))
    rows = R.publication_rows(selections, offers, sources, suppliers, targets, matches)
    return rows.select("catalog_product_id", "selected_offer_id", "offer_id", "source_product_id", "source_catalog_product_id", "supplier_code", "supplier_enabled", "supplier_sku", "target_id", "target_article", "match_status", "match_catalog_product_id")


PUBLICATION_ROWS = """
WITH l AS (SELECT l_partkey AS k, min(l_orderkey * 10 + l_linenumber) AS offer_id, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS src FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS catalog_product_id, l.offer_id AS selected_offer_id, o.offer_id AS offer_id, p.s_suppkey AS source_product_id, p.s_nationkey AS source_catalog_product_id, s.s_name AS supplier_code, s.s_suppkey % 2 = 0 AS supplier_enabled,
  CASE WHEN o.offer_id IS NOT NULL AND o.offer_id % 2 <> 0 THEN 'S' || p.s_suppkey END AS supplier_sku, CASE WHEN p_partkey % 8 <> 3 THEN p_partkey END AS target_id, CAST(NULL AS VARCHAR) AS target_article,
  CASE WHEN p.s_suppkey % 3 <> 0 THEN 'EXACT_MATCH' END AS match_status, CASE WHEN p.s_suppkey % 3 <> 0 THEN p.s_nationkey END AS match_catalog_product_id
FROM part LEFT JOIN l ON l.k = p_partkey LEFT JOIN (SELECT * FROM l WHERE offer_id % 9 <> 0) o ON o.offer_id = l.offer_id LEFT JOIN supplier p ON p.s_suppkey = o.src AND p.s_suppkey % 4 <> 1 LEFT JOIN supplier s ON s.s_suppkey = o.src AND s.s_suppkey % 5 <> 2
WHERE p_partkey % 6 <> 0
"""



def _shop_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of a shop's layout, one a part: products with more or fewer of their pieces, categories, and others."""
    k = F.col("p_partkey")

    def piece(test: Column, *texts) -> Column:
        return F.when(test, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in texts])).otherwise("")

    product = F.concat(
        F.lit('<div class="c-catalog-element"'), piece(k % 3 == 0, " data-data='{\"id\": ", k, "}'"), F.lit(">"), piece(k % 4 != 1, "<h1> ", F.col("p_name"), "</h1>"), piece(k % 2 == 0, '<span class="catalog-element-article-value">A-', k, "</span>"),
        piece(k % 5 != 0, '<div class="catalog-element-price-current">', F.col("p_size"), " 500,50 руб.</div>"), piece(k % 7 == 0, '<div class="catalog-element-quantity">В наличии ', F.col("p_size"), " шт</div>"),
        piece(k % 6 == 0, '<div data-id="properties"><div class="catalog-element-properties-detail-item"><span class="catalog-element-properties-detail-item-name">Бренд</span><span class="catalog-element-properties-detail-item-value">', F.col("p_brand"), "</span></div></div>"), F.lit("</div>"),
    )
    page = F.when(k % 10 == 9, F.concat(F.lit("<h1>All</h1><div class='c-catalog-section'>"), F.col("p_type"), F.lit("</div>"))).when(k % 10 == 8, F.lit(None)).otherwise(product)
    return t(s, d, "part").select(k, F.concat(F.lit("http://www.shop.example/p"), k, F.lit("/?utm_source=x")).alias("url"), page.alias("html"))


def page_types(s: SparkSession, d: str) -> DataFrame:
    rows = pages.with_nodes(_shop_pages(s, d))
    return rows.select("p_partkey", pages.page_evidence(rows).alias("e")).select("p_partkey", F.col("e.page_type").alias("page_type"), F.col("e.support").alias("support"), F.col("e.has_heading").alias("has_heading"))


_SHOP = """
x AS (SELECT *, p_partkey % 10 < 8 AS shown FROM part), y AS (SELECT *, CAST(CASE WHEN shown THEN (p_partkey % 2 = 0)::INT + (p_partkey % 5 <> 0)::INT + (p_partkey % 7 = 0)::INT + (p_partkey % 6 = 0)::INT + (p_partkey % 3 = 0)::INT ELSE 0 END AS INT) AS support,
  p_partkey % 10 = 9 OR shown AND p_partkey % 4 <> 1 AS heading FROM x), z AS (SELECT *, CASE WHEN shown AND heading AND support >= 2 THEN 'product' WHEN p_partkey % 10 = 9 THEN 'category' ELSE 'other' END AS kind FROM y)"""
PAGE_TYPES = f"WITH {_SHOP} SELECT p_partkey, kind AS page_type, support, heading AS has_heading FROM z"


def page_products(s: SparkSession, d: str) -> DataFrame:
    """The strict records of the pages that are products."""
    rows = pages.with_nodes(_shop_pages(s, d))
    rows = rows.filter(pages.page_evidence(rows)["page_type"] == "product").select("p_partkey", *pages.product_record())
    return rows.select("p_partkey", "external_id", "external_id_type", "sku", "name", "brand", "canonical_url", "price", "availability", "quantity", F.size("properties").alias("n_properties"))


PAGE_PRODUCTS = f"""
WITH {_SHOP} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'https://shop.example/p' || p_partkey || '/' END AS external_id, CASE WHEN p_partkey % 3 = 0 THEN 'internal_product_id' ELSE 'canonical_url' END AS external_id_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'A-' || p_partkey END AS sku, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS brand, 'https://shop.example/p' || p_partkey || '/' AS canonical_url,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size || '500.50' AS DECIMAL(18,2)) END AS price, CASE WHEN p_partkey % 7 = 0 THEN 'in_stock' END AS availability, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS quantity, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS n_properties
FROM z WHERE kind = 'product'
"""

QUERIES = {
    "feed_codes": (feed_codes, FEED_CODES), "feed_set_codes": (feed_set_codes, FEED_SET_CODES), "offer_rules": (offer_rules, OFFER_RULES), "text_functions": (text_functions, TEXT_FUNCTIONS),
    "unit_conversion": (unit_conversion, UNIT_CONVERSION), "registry_upsert": (registry_upsert, REGISTRY_UPSERT), "registry_identifiers": (registry_identifiers, REGISTRY_IDENTIFIERS),
    "publication_rows": (publication_rows, PUBLICATION_ROWS), "page_types": (page_types, PAGE_TYPES), "page_products": (page_products, PAGE_PRODUCTS),
}
