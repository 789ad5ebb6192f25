"""Queries of listings, exports, dashboards, reports and integrity over parts as source products.

The role tables are projections of the test tables that Spark and DuckDB both read (SOURCES); what the
operators compute from them is written out a second time as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import integrity
from tallyforge.operators import listing as L
from tallyforge.operators import offers as O
from tallyforge.operators import reports as P
from tallyforge.operators.feed import document_problems
from tallyforge.plans.decisions import _candidates, _selection
from tallyforge.plans.offers_sql import OFFERS
from tallyforge.session import checkpointed
from tallyforge.session import table as t
from tallyforge.sources.readers import rebuild_cards
from tallyforge.sources.writers import xml_rows

_DECISION = "CASE p_size % 7 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'REVIEW_EXISTING' WHEN 2 THEN 'SAFE_NEW_PRODUCT_CANDIDATE' WHEN 3 THEN 'INSUFFICIENT_IDENTITY' WHEN 4 THEN 'ACCESSORY_OR_COMPATIBILITY_ITEM' ELSE 'EXACT_EXISTING' END"
#: Role tables: (test table, projection, condition).
SOURCES = {
    "products": ("part", (
        "p_partkey AS product_id", "'S' || (p_partkey % 10) AS supplier", "CAST(p_partkey AS STRING) AS external_id", "CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'A' || p_partkey END AS sku", "p_name AS name",
        "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS brand", "CASE WHEN p_size > 40 THEN NULL ELSE p_name || ' ' || p_type END AS description", "p_partkey % 13 <> 0 AS active",
        f"{_DECISION} AS decision", "p_type AS product_kind", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'M' || p_size END AS own_model", "CASE WHEN p_size % 9 = 0 THEN 'R' || p_size END AS reference_model",
        "CASE WHEN p_partkey % 4 = 0 THEN 'T' || p_partkey END AS best_candidate",
    ), "TRUE"),
    "offers": ("orders", (
        "o_custkey AS product_id", "o_orderkey AS offer_id", "o_orderstatus = 'O' AS active", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS price",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'RUB' END AS currency", "CASE o_orderpriority WHEN '1-URGENT' THEN 'unknown' WHEN '2-HIGH' THEN NULL ELSE 'in_stock' END AS availability",
    ), "TRUE"),
    "properties": ("lineitem", ("l_partkey AS product_id", "l_linenumber AS position"), "l_quantity > 45"), "images": ("lineitem", ("l_partkey AS product_id", "l_orderkey AS position", "l_linenumber AS line"), "l_tax = 0 AND l_quantity > 40"),
    "documents": ("lineitem", ("l_partkey AS product_id",), "l_discount > 0.09"), "relations": ("lineitem", ("l_partkey AS product_id",), "l_returnflag = 'R' AND l_quantity < 5"), "options": ("lineitem", ("l_partkey AS product_id",), "l_quantity = 5"),
    "categories": ("part", ("p_partkey AS product_id", "p_type || ' / ' || p_brand AS path"), "p_size % 3 <> 0"),
    "accepted": ("orders", ("o_custkey AS product_id", "'T' || o_orderkey AS target", "o_orderdate AS linked_at", "o_orderkey AS event_id"), "o_orderkey % 3 = 0"),
    "manual": ("orders", ("o_custkey AS product_id", "'M' || o_orderkey AS target", "o_orderdate AS linked_at", "o_orderkey AS event_id"), "o_orderkey % 17 = 0"),
    "history": ("events", ("event_id", "CAST(event_id % 20 AS BIGINT) AS run_id", "user_id AS product_id", "event_type AS field", "ts AS changed_at"), "event_type <> 'view'"),
    "runs": ("orders", ("o_orderkey AS run_id", "'S' || (o_custkey % 10) AS supplier", "CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'F' THEN 'failed' ELSE 'partial' END AS status", "o_orderdate AS started_at", "o_orderdate + INTERVAL 90 MINUTE AS finished_at"), "o_orderkey % 2 = 0"),
    "jobs": ("orders", ("o_orderkey AS run_id", "CASE WHEN o_custkey % 3 = 0 THEN 'schedule' ELSE 'manual' END AS trigger_type"), "o_orderkey % 4 = 0"),
    "snapshots": ("events", ("event_id AS snapshot_id", "'S' || (user_id % 10) AS supplier", "event_id * 2 AS run_id", "ts AS created_at", "value > 50 AS critical", "event_type AS codes"), "TRUE"),
    "errors": ("events", ("'S' || (user_id % 10) AS supplier", "ts AS created_at"), "event_type = 'error'"),
}


def role(s: SparkSession, d: str, name: str) -> DataFrame:
    source, columns, condition = SOURCES[name]
    return t(s, d, source).filter(condition).selectExpr(*columns)


def roles_sql(*names: str) -> str:
    return ", ".join(f"{n} AS (SELECT {', '.join(SOURCES[n][1])} FROM {SOURCES[n][0]} WHERE {SOURCES[n][2]})" for n in names)


_CHILDREN = ("properties", "images", "documents", "relations", "options")


def _listing(s: SparkSession, d: str) -> DataFrame:
    return L.listing(role(s, d, "products"), role(s, d, "offers"), {n: role(s, d, n) for n in _CHILDREN}, role(s, d, "categories"), role(s, d, "accepted"), role(s, d, "manual"))


_COUNTS = " ".join(f"LEFT JOIN (SELECT product_id, count(*) AS {n} FROM {n} GROUP BY product_id) {n}_n USING (product_id)" for n in _CHILDREN)
_LISTING = f"""{roles_sql('products', 'offers', *_CHILDREN, 'categories', 'accepted', 'manual')},
o AS (SELECT product_id, price, currency, availability FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY offer_id) AS rn FROM offers WHERE active) WHERE rn = 1),
acc AS (SELECT product_id, target FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY linked_at DESC, event_id DESC) AS rn FROM accepted) WHERE rn = 1),
man AS (SELECT product_id, target FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY linked_at DESC, event_id DESC) AS rn FROM manual) WHERE rn = 1),
listing AS (SELECT p.*, o.price, o.currency, o.availability, coalesce(c.path, '') AS category, coalesce(man.target, acc.target) AS confirmed_link,
  CASE WHEN man.target IS NOT NULL THEN 'MANUAL_CONFIRMED' WHEN acc.target IS NOT NULL THEN 'AUTO_ACCEPTED' END AS confirmed_source, {', '.join(f'coalesce({n}_n.{n}, 0) AS {n}' for n in _CHILDREN)}
  FROM products p LEFT JOIN o USING (product_id) LEFT JOIN categories c USING (product_id) LEFT JOIN acc USING (product_id) LEFT JOIN man USING (product_id) {_COUNTS})"""
_ISSUES_SQL = {
    "without_price": "price IS NULL", "zero_price": "price = 0", "without_currency": "currency IS NULL", "without_sku": "nullif(trim(sku), '') IS NULL", "without_brand": "nullif(trim(brand), '') IS NULL",
    "without_model": "nullif(trim(own_model), '') IS NULL", "without_description": "nullif(trim(description), '') IS NULL", "without_properties": "properties = 0", "without_images": "images = 0",
    "without_category": "category = ''", "without_availability": "availability IS NULL OR availability = 'unknown'",
}


def product_export(s: SparkSession, d: str) -> DataFrame:
    rows = _listing(s, d).filter(L.ProductFilters(supplier="S3", content="complete").condition())
    return rows.orderBy("supplier", "product_id")


PRODUCT_EXPORT = f"WITH {_LISTING} SELECT * FROM listing WHERE active AND supplier = 'S3' AND coalesce(description, '') <> '' AND coalesce(brand, '') <> ''"
_FILTERS = {
    "brand": L.ProductFilters(brand="Brand#2"), "decision": L.ProductFilters(decision="CONFLICT"), "kind": L.ProductFilters(kind="PROMO"), "availability": L.ProductFilters(availability="in_stock"),
    "category": L.ProductFilters(category="brand#1"), "content": L.ProductFilters(content="missing"), "media": L.ProductFilters(media="complete"), "no_media": L.ProductFilters(media="missing"), "search": L.ProductFilters(search="t12"),
    **{name: L.ProductFilters(issue=name) for name in _ISSUES_SQL},
}


def product_filters(s: SparkSession, d: str) -> DataFrame:
    """How many products each filter shows, all in one pass."""
    counted = _listing(s, d).agg(*[F.count_if(f.condition()).alias(name) for name, f in _FILTERS.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("products")) for n in _FILTERS])).alias("x")).select("x.*")


_SEARCHED = " OR ".join(f"{c} ILIKE '%t12%'" for c in ("external_id", "sku", "name", "own_model", "reference_model", "best_candidate"))
_FILTERS_SQL = {
    "brand": "brand = 'Brand#2'", "decision": "decision = 'CONFLICT'", "kind": "product_kind = 'PROMO'", "availability": "availability = 'in_stock'", "category": "category ILIKE '%brand#1%'",
    "content": "NOT (coalesce(description, '') <> '' AND coalesce(brand, '') <> '')", "media": "images > 0", "no_media": "images = 0", "search": _SEARCHED, **_ISSUES_SQL,
}
PRODUCT_FILTERS = f"WITH {_LISTING} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS products FROM listing WHERE active AND ({c})" for n, c in _FILTERS_SQL.items())


def export_details(s: SparkSession, d: str) -> DataFrame:
    rows = _listing(s, d).filter(L.ProductFilters(issue="without_description").condition())
    return L.details(rows, role(s, d, "images"), "images", ("position", "line"))


EXPORT_DETAILS = f"WITH {_LISTING} SELECT l.supplier, l.external_id, i.* FROM listing l JOIN images i USING (product_id) WHERE active AND ({_ISSUES_SQL['without_description']})"


def export_totals(s: SparkSession, d: str) -> DataFrame:
    return L.export_totals(_listing(s, d).filter(L.ProductFilters().condition()))


EXPORT_TOTALS = f"WITH {_LISTING} SELECT count(*) AS products, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _CHILDREN)}, count(best_candidate) AS matched, count(*) - count(best_candidate) AS unmatched FROM listing WHERE active"


def export_counters(s: SparkSession, d: str) -> DataFrame:
    """The counters of all suppliers and of one."""
    c = F.col
    selection = _selection(s, d).select(c("product_id").alias("catalog_id"), "status", "offer_id")
    offers = _candidates(s, d).select("offer_id", F.concat(F.lit("S"), c("supplier_id") % 10).alias("supplier"), "price")
    offers = offers.groupBy("offer_id").agg(F.min("supplier").alias("supplier"), F.min("price").alias("price"))
    chosen = checkpointed(selection.join(offers, "offer_id", "left"))  # both scopes read the selection with its offers, in one plan that deals the lines once
    selection, offers = chosen.select("catalog_id", "status", "offer_id"), chosen.filter("offer_id is not null").select("offer_id", "supplier", "price").distinct()
    products = role(s, d, "products").select("product_id", "supplier", c("product_id").alias("catalog_id"), "decision")
    targets = t(s, d, "part").filter("p_partkey % 6 <> 0").select(c("p_partkey").alias("catalog_id"), c("p_type").alias("category_id"), F.when(c("p_partkey") % 10 == 0, "").otherwise(c("p_type")).alias("category_name"))
    decisions = products.select("product_id", "decision")
    both = [L.export_counters(selection, offers, products.drop("decision"), decisions, targets, which).select(F.lit(which or "").alias("scope"), "*") for which in (None, "S4")]
    return both[0].unionByName(both[1])


_COUNTERS = f"""WITH {OFFERS}, {roles_sql('products')},
of AS (SELECT offer_id, min('S' || (supplier_key % 10)) AS supplier, min(price) AS price FROM ranked GROUP BY offer_id),
tg AS (SELECT p_partkey AS k, p_partkey % 10 = 0 AS blank FROM part WHERE p_partkey % 6 <> 0),
r AS (SELECT s.part_key, s.status, of.supplier AS seller, of.price, coalesce(tg.blank, TRUE) AS blank, 'S' || (s.part_key % 10) AS own FROM selection s LEFT JOIN of USING (offer_id) LEFT JOIN tg ON tg.k = s.part_key)
"""
_COUNTED = """SELECT '{0}' AS scope, count(*) AS considered, count(*) FILTER (WHERE status = 'selected') AS selected, count(*) FILTER (WHERE status = 'no_eligible_offer') AS no_selected_offer,
  count(*) FILTER (WHERE status = 'selected' AND seller IS NOT NULL AND (price IS NULL OR price <= 0)) AS without_price, count(*) FILTER (WHERE status = 'selected' AND seller IS NOT NULL AND blank) AS without_category,
  (SELECT count(*) FROM products WHERE {2} AND decision = 'CONFLICT') AS blocked_by_conflict, (SELECT count(*) FROM products WHERE {2} AND decision IN ('REVIEW_EXISTING', 'INSUFFICIENT_IDENTITY')) AS needs_review,
  (SELECT count(*) FROM products WHERE {2} AND decision = 'SAFE_NEW_PRODUCT_CANDIDATE') AS safe_new, (SELECT count(*) FROM products WHERE {2} AND decision = 'ACCESSORY_OR_COMPATIBILITY_ITEM') AS accessories FROM r WHERE {1}"""
EXPORT_COUNTERS = _COUNTERS + _COUNTED.format("", "TRUE", "TRUE") + " UNION ALL " + _COUNTED.format("S4", "(status = 'selected' AND seller = 'S4') OR (status <> 'selected' AND own = 'S4')", "supplier = 'S4'")


def filter_options(s: SparkSession, d: str) -> DataFrame:
    return L.filter_options(role(s, d, "products"))


FILTER_OPTIONS = f"WITH {roles_sql('products')} SELECT DISTINCT 'supplier' AS field, supplier AS value FROM products UNION ALL SELECT DISTINCT 'brand', brand FROM products WHERE trim(brand) <> '' UNION ALL SELECT DISTINCT 'kind', product_kind FROM products"


def change_export(s: SparkSession, d: str) -> DataFrame:
    """How many changes each kind of period shows."""
    history = role(s, d, "history")
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-20'")
    parts = {"last_run": {}, "24h": {"as_of": as_of}, "7d": {"as_of": as_of}, "between": {"runs": (12, 3)}}
    out = None
    for period, options in parts.items():
        rows = L.changes_in(history, period, **options).groupBy("field").agg(F.count("*").alias("changes"), F.max("event_id").alias("last_id")).withColumn("period", F.lit(period))
        out = rows if out is None else out.unionByName(rows)
    return out


_PERIODS = {"last_run": "run_id = (SELECT max(run_id) FROM history)", "24h": "changed_at >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR", "7d": "changed_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY", "between": "run_id BETWEEN 3 AND 12"}
CHANGE_EXPORT = f"WITH {roles_sql('history')} " + " UNION ALL ".join(f"SELECT field, count(*) AS changes, max(event_id) AS last_id, '{n}' AS period FROM history WHERE {c} GROUP BY field" for n, c in _PERIODS.items())


def quality_dashboard(s: SparkSession, d: str) -> DataFrame:
    suppliers = s.range(11).select(F.concat(F.lit("S"), "id").alias("supplier"))
    return L.quality_dashboard(suppliers, _listing(s, d), role(s, d, "errors"), role(s, d, "runs"), role(s, d, "snapshots"), F.expr("TIMESTAMP_NTZ '2024-02-01'"))


_STATES = {"review": "decision IN ('REVIEW_EXISTING', 'INSUFFICIENT_IDENTITY')", "conflicts": "decision = 'CONFLICT'", "safe_new": "decision = 'SAFE_NEW_PRODUCT_CANDIDATE'"}
QUALITY_DASHBOARD = f"""WITH {_LISTING}, {roles_sql('errors', 'runs', 'snapshots')}, suppliers AS (SELECT 'S' || i AS supplier FROM range(11) r(i)),
snap AS (SELECT supplier, critical, codes FROM snapshots QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY created_at DESC, snapshot_id DESC) = 1)
SELECT s.supplier, count(l.product_id) AS total, count(*) FILTER (WHERE l.active) AS active_products, {', '.join(f'count(l.product_id) FILTER (WHERE {c}) AS {n}' for n, c in {**_ISSUES_SQL, **_STATES}.items())},
  (SELECT count(*) FROM errors e WHERE e.supplier = s.supplier AND e.created_at > TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) AS parser_errors,
  (SELECT max(finished_at) FROM runs r WHERE r.supplier = s.supplier AND status = 'succeeded') AS last_successful_crawl, any_value(snap.critical) AS critical, any_value(snap.codes) AS codes
FROM suppliers s LEFT JOIN listing l USING (supplier) LEFT JOIN snap USING (supplier) GROUP BY s.supplier"""


def quality_history(s: SparkSession, d: str) -> DataFrame:
    return L.quality_history(role(s, d, "snapshots"), role(s, d, "runs"), "S7", 25).select("snapshot_id", "created_at", "critical", "codes", "run_id", "status")


QUALITY_HISTORY = f"""WITH {roles_sql('snapshots', 'runs')} SELECT snapshot_id, created_at, critical, codes, run_id, status FROM snapshots LEFT JOIN (SELECT run_id, status FROM runs) USING (run_id)
WHERE supplier = 'S7' AND (status IS NULL OR status IN ('succeeded', 'partial')) ORDER BY created_at DESC, snapshot_id DESC LIMIT 25"""


def run_listing(s: SparkSession, d: str) -> DataFrame:
    rows = L.run_listing(role(s, d, "runs"), role(s, d, "jobs"))
    return rows.select("run_id", "status", "trigger_type", "seconds", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"))


RUN_LISTING = f"WITH {roles_sql('runs', 'jobs')} SELECT run_id, status, trigger_type, CAST(5400 AS BIGINT) AS seconds, strftime(started_at, '%Y-%m-%d %H:%M') AS started FROM runs LEFT JOIN jobs USING (run_id) ORDER BY started_at DESC, run_id DESC LIMIT 100"
_PROGRESS = ("o_orderkey AS run_id", "CAST(o_custkey % 90 AS BIGINT) AS total", "CAST(o_orderkey % 60 AS BIGINT) AS processed", "CAST(o_orderkey % 40 AS BIGINT) AS fetched", "CAST(o_custkey % 7 AS BIGINT) AS fetch_seconds", "CASE WHEN o_orderstatus = 'O' THEN 'FETCHING_PRODUCTS' ELSE 'MATCHING' END AS phase")


def run_progress(s: SparkSession, d: str) -> DataFrame:
    return L.run_progress(t(s, d, "orders").selectExpr(*_PROGRESS)).select("run_id", "percent", "rate_per_second", "eta_seconds")


RUN_PROGRESS = f"""WITH r AS (SELECT {', '.join(_PROGRESS)} FROM orders), q AS (SELECT *, CASE WHEN fetched > 0 AND fetch_seconds > 0 THEN fetched / fetch_seconds END AS rate FROM r)
SELECT run_id, CASE WHEN total = 0 THEN 100.0 ELSE round(least(100.0, CAST(processed AS DOUBLE) * 100.0 / total), 2) END::DOUBLE AS percent, round(rate, 3) AS rate_per_second,
  CASE WHEN phase = 'FETCHING_PRODUCTS' AND processed < total THEN CAST(round((total - processed) / rate) AS BIGINT) END AS eta_seconds FROM q"""


def export_names(s: SparkSession, d: str) -> DataFrame:
    """File names, fill rates as text, previews and escaped texts of parts."""
    c = F.col
    rates = F.map_from_arrays(F.array(F.lit("price"), F.lit("sku")), F.array(c("p_size") / 100.0, c("p_partkey") % 10 / 10.0))
    rows = t(s, d, "part")
    return rows.select(
        "p_partkey", L.export_filename(c("p_type"), F.when(c("p_partkey") % 2 == 0, c("p_brand")), F.lit("2024-05-06").cast("date"), "csv").alias("file"),
        L.fill_rates_text(rates, {"price": "Price", "brand": "Brand", "sku": "SKU"}).alias("rates"), P.preview(F.concat_ws(" \n ", "p_name", "p_type", "p_brand"), 18).alias("preview"), P.escaped(F.concat(F.lit("<a href=\"x&y\">"), "p_name")).alias("escaped"),
    )


EXPORT_NAMES = r"""
SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9_-]', '_', 'g') || CASE WHEN p_partkey % 2 = 0 THEN '_' || regexp_replace(lower(p_brand), '[^a-z0-9_-]', '_', 'g') ELSE '' END || '_2024-05-06.csv' AS file,
  'Price ' || p_size || '%, SKU ' || (p_partkey % 10) * 10 || '%' AS rates, CASE WHEN length(f) > 18 THEN rtrim(substr(f, 1, 17)) || '…' ELSE f END AS preview, '&lt;a href=&quot;x&amp;y&quot;&gt;' || p_name AS escaped
FROM (SELECT *, p_name || ' ' || p_type || ' ' || p_brand AS f FROM part)
"""


# Reports


def content_completeness(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    fields = {"name": c("name") != "", "brand": c("brand") != "", "model": c("own_model") != "", "sku": F.trim("sku") != "", "category": c("category") != "", "price": c("price").isNotNull(), "availability": c("availability").isNotNull(), "description": c("description") != "", "properties": c("properties") > 0, "images": c("images") > 0, "documents": c("documents") > 0, "relations": c("relations") > 0}
    return P.completeness(_listing(s, d), "product_id", fields).select("product_id", "missing_fields", "complete")


_FILLED = {"name": "name <> ''", "brand": "brand <> ''", "model": "own_model <> ''", "sku": "trim(sku) <> ''", "category": "category <> ''", "price": "price IS NOT NULL", "availability": "availability IS NOT NULL", "description": "coalesce(description, '') <> ''", "properties": "properties > 0", "images": "images > 0", "documents": "documents > 0", "relations": "relations > 0"}
_MISSING = ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _FILLED.items())
COMPLETENESS = f"WITH {_LISTING} SELECT product_id, concat_ws('|', {_MISSING}) AS missing_fields, concat_ws('|', {_MISSING}) = '' AS complete FROM listing"

_MEDIA = ("CASE l_returnflag WHEN 'R' THEN 'document' ELSE 'image' END AS media_type", "CASE WHEN l_quantity = 3 THEN '' ELSE 'u' || CAST(l_quantity AS BIGINT) END AS url", "l_linenumber = 1 AS is_primary", "CASE WHEN l_discount < 0.01 THEN NULL ELSE CAST(l_linenumber AS INT) END AS position")


def media_audit(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").filter("l_tax < 0.02").selectExpr("l_partkey AS product_id", *_MEDIA)
    cards = rows.groupBy("product_id").agg(F.collect_list(F.struct("media_type", "url", F.lit(None).cast("string").alias("title"), "position", "is_primary")).alias("media"))
    return P.media_audit(cards, "product_id")


MEDIA_AUDIT = f"""
WITH m AS (SELECT l_partkey AS product_id, {", ".join(_MEDIA)} FROM lineitem WHERE l_tax < 0.02), i AS (SELECT *, media_type = 'image' AS im, media_type = 'image' AND url <> '' AS ok FROM m)
SELECT product_id, CAST(count(*) FILTER (WHERE ok) AS INT) AS urls, coalesce(bool_or(is_primary) FILTER (WHERE ok), FALSE) AS primary_exists, CAST(count(*) FILTER (WHERE ok AND NOT is_primary) AS INT) AS gallery,
  CAST(count(*) FILTER (WHERE ok) - count(DISTINCT url) FILTER (WHERE ok) AS INT) AS duplicates, CAST(count(*) FILTER (WHERE im AND NOT ok) AS INT) AS broken, count(*) FILTER (WHERE im AND position IS NULL) = 0 AS metadata_present FROM i GROUP BY product_id
"""


def relation_buckets(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    kind = F.when(c("l_returnflag") == "R", "replacement").when(c("l_returnflag") == "A", "other").otherwise("")
    lines = t(s, d, "lineitem").filter("l_quantity < 4").groupBy(c("l_partkey").alias("product_id")).agg(F.collect_list(F.struct(kind.alias("kind"), c("l_suppkey").cast("string").alias("target"))).alias("relations"))
    rows = P.relation_buckets(lines, "product_id", F.when(c("product_id") % 3 == 0, F.lit("pp800f")))
    return rows.drop("relation_evidence")


RELATION_BUCKETS = """
SELECT l_partkey AS product_id, CAST(0 AS INT) AS accessory_count, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS INT) AS related_count, CAST(0 AS INT) AS compatible_with_count,
  CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INT) AS replacement_count, CAST(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS parent_reference_count FROM lineitem WHERE l_quantity < 4 GROUP BY l_partkey
"""
_NEW = ("p_partkey AS source_key", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'T' END AS candidate_key", "CASE WHEN p_partkey % 4 = 0 THEN 'NO_CANDIDATES' ELSE 'NO_IDENTITY_EVIDENCE' END AS method", "CAST(p_size / 50.0 AS DOUBLE) AS similarity", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS brand", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'M' END AS model", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'A' END AS sku")


def new_product_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "part").selectExpr(*_NEW)
    return rows.select("source_key", F.array_join(P.new_product_categories(rows), ";").alias("reasons"))


NEW_REASONS = f"""WITH r AS (SELECT {', '.join(_NEW)} FROM part), f AS (SELECT *, concat_ws(';', CASE WHEN candidate_key IS NULL OR method = 'NO_CANDIDATES' THEN 'NO_REGISTRY_CANDIDATE' END, CASE WHEN similarity >= 0.60 THEN 'POSSIBLE_NAME_VARIATION' END,
  CASE WHEN brand = '' THEN 'MISSING_BRAND' END, CASE WHEN model = '' THEN 'MISSING_MODEL' END, CASE WHEN sku IS NULL THEN 'INSUFFICIENT_IDENTIFIERS' END,
  CASE WHEN (method = 'NO_CANDIDATES' OR similarity < 0.45) AND sku IS NOT NULL AND brand <> '' THEN 'LIKELY_REAL_NEW_PRODUCT' END) AS x FROM r)
SELECT source_key, CASE WHEN x = '' THEN 'MANUAL_REVIEW_REQUIRED' WHEN similarity >= 0.60 OR brand = '' THEN x || ';MANUAL_REVIEW_REQUIRED' ELSE x END AS reasons FROM f"""


def nested_totals(s: SparkSession, d: str) -> DataFrame:
    """Sums of nested arrays of cards: words of titles, conversations' turns as options with their texts as values."""
    c = F.col
    cards = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.split(F.coalesce("text", F.lit("")), " ").alias("values"))).alias("options"))
    return P.nested_totals(cards, {"options": F.size("options"), "user_options": F.size(F.filter("options", lambda o: o["role"] == "user")), "values": F.aggregate("options", F.lit(0), lambda a, o: a + F.size(o["values"]))}).crossJoin(cards.agg(F.count(c("conv_id")).alias("cards")))


NESTED_TOTALS = "SELECT count(*) AS options, count(*) FILTER (WHERE role = 'user') AS user_options, CAST(sum(len(string_split(coalesce(text, ''), ' '))) AS BIGINT) AS values, count(DISTINCT conv_id) AS cards FROM conversations"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def table_counts(s: SparkSession, d: str) -> DataFrame:
    return P.table_counts({n: t(s, d, n) for n in _TABLES})


TABLE_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table, count(*) AS rows FROM {n}" for n in _TABLES)


def keep_best(s: SparkSession, d: str) -> DataFrame:
    """Pages of one address: the longest stays with the hosts of all, the others are its aliases."""
    c = F.col
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rows = t(s, d, "pages").select("page_id", path.alias("path"), F.length("html").alias("n"), F.array(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("hosts"))
    winners, aliases = P.keep_best(rows, ["path"], [F.desc("n"), c("page_id")], "page_id", "hosts")
    counted = aliases.groupBy("path").agg(F.count("*").alias("aliases"), F.min("alias_url").alias("first_alias"))
    return winners.join(counted, "path", "left").select("path", "page_id", F.array_join("hosts", ";").alias("hosts"), F.coalesce("aliases", F.lit(0).cast("bigint")).alias("aliases"), "first_alias")


KEEP_BEST = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, length(html) AS n, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, page_id) AS k FROM p)
SELECT path, min(page_id) FILTER (WHERE k = 1) AS page_id, array_to_string(list_sort(list(DISTINCT host)), ';') AS hosts, count(*) - 1 AS aliases, min(page_id) FILTER (WHERE k > 1) AS first_alias FROM r GROUP BY path
"""


def quota_sample(s: SparkSession, d: str) -> DataFrame:
    rows = role(s, d, "products").select("product_id", "decision")
    required = rows.filter("product_id in (7, 8, 49)")
    return P.quota_sample(rows, "product_id", "decision", {"CONFLICT": 5, "EXACT_EXISTING": 7, "REVIEW_EXISTING": 3}, [F.col("product_id") % 17, F.col("product_id")], required)


QUOTA_SAMPLE = f"""WITH {roles_sql('products')}, q(decision, quota) AS (VALUES ('CONFLICT', 5), ('EXACT_EXISTING', 7), ('REVIEW_EXISTING', 3)), m AS (SELECT product_id, decision FROM products WHERE product_id IN (7, 8, 49)),
r AS (SELECT product_id, decision, row_number() OVER (PARTITION BY decision ORDER BY product_id % 17, product_id) AS n FROM products WHERE product_id NOT IN (7, 8, 49))
SELECT product_id, decision, 'required' AS reason FROM m UNION ALL SELECT product_id, r.decision, 'quota' FROM r JOIN q USING (decision) WHERE n <= quota - (SELECT count(*) FROM m WHERE m.decision = r.decision)"""


def trace_rows(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = role(s, d, "products").select("product_id", "decision", "brand", "description")
    return P.first_of_each(rows, "product_id", {"conflict": c("decision") == "CONFLICT", "no_brand": c("brand") == "", "no_description": c("description").isNull(), "first": F.lit(True), "again": c("decision") == "CONFLICT"}, 5)


TRACE_ROWS = f"""WITH RECURSIVE {roles_sql('products')}, p(i, reason) AS (VALUES (1, 'conflict'), (2, 'no_brand'), (3, 'no_description'), (4, 'first'), (5, 'again')),
hit AS (SELECT i, reason, product_id FROM p, products WHERE (reason IN ('conflict', 'again') AND decision = 'CONFLICT') OR (reason = 'no_brand' AND brand = '') OR (reason = 'no_description' AND description IS NULL) OR reason = 'first'),
w AS (SELECT 1 AS i, [(SELECT min(product_id) FROM hit WHERE i = 1)] AS chosen UNION ALL SELECT w.i + 1, list_append(w.chosen, (SELECT min(h.product_id) FROM hit h WHERE h.i = w.i + 1 AND NOT list_contains(w.chosen, h.product_id))) FROM w WHERE w.i < 5)
SELECT unnest(chosen) AS product_id, unnest(['conflict', 'no_brand', 'no_description', 'first', 'again']) AS reason FROM w WHERE i = 5"""


def target_problems(s: SparkSession, d: str) -> DataFrame:
    targets = t(s, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("target"))
    return P.target_problems(targets, t(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("target")).unionByName(t(s, d, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("target"))), "target")


TARGET_PROBLEMS = """
WITH a AS (SELECT o_custkey AS target, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1), o AS (SELECT c_custkey AS target FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 4 = 0),
j AS (SELECT target, n, (SELECT count(*) FROM o WHERE o.target = a.target) AS seen FROM a)
SELECT target, 'DUPLICATE_TARGET' AS problem FROM j WHERE n > 1 UNION ALL SELECT target, CASE WHEN seen = 0 THEN 'MISSING_TARGET' ELSE 'AMBIGUOUS_TARGET:' || seen END FROM j WHERE seen <> 1
"""
_STATE = ("p_partkey AS id", "CASE p_size % 4 WHEN 0 THEN 'INCREASE' WHEN 1 THEN 'UNCHANGED' WHEN 2 THEN 'DECREASE' ELSE 'UNKNOWN_CURRENT' END AS price_change", "CASE WHEN p_partkey % 3 = 0 THEN 'CHANGE' ELSE 'UNCHANGED' END AS availability_change", "CAST(p_size AS BIGINT) AS current_price", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS current_availability")


def rollback_plan(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "part").selectExpr(*_STATE)
    return P.rollback_rows(rows.select("id", "price_change", "availability_change"), rows.select("id", "current_price", "current_availability"), "id")


ROLLBACK = f"""WITH r AS (SELECT {', '.join(_STATE)} FROM part) SELECT id, concat_ws('|', CASE WHEN price_change IN ('INCREASE', 'DECREASE') THEN 'price' END, CASE WHEN availability_change = 'CHANGE' THEN 'availability' END) AS changed_fields,
  current_price AS rollback_price, current_availability AS rollback_availability FROM r WHERE price_change IN ('INCREASE', 'DECREASE') OR availability_change = 'CHANGE'"""


def zero_write_check(s: SparkSession, d: str) -> DataFrame:
    before = t(s, d, "part").selectExpr(*_STATE).filter("id % 7 <> 0")
    after = t(s, d, "part").selectExpr(*_STATE).filter("id % 8 <> 0").withColumn("current_price", F.col("current_price") + F.when(F.col("id") % 9 == 0, 1).otherwise(0))
    return P.state_changes(before, after, "id", ["current_price", "current_availability"])


ZERO_WRITE = "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'ONLY_AFTER' WHEN p_partkey % 8 = 0 THEN 'ONLY_BEFORE' ELSE 'CHANGED' END AS problem FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 8 = 0) AND (p_partkey % 7 = 0 OR p_partkey % 8 = 0 OR p_partkey % 9 = 0)"


def xml_export(s: SparkSession, d: str) -> DataFrame:
    """Products with their images as XML, read back: what the export holds of each."""
    images = role(s, d, "images").select("product_id", "position", F.concat(F.lit("u"), "line").alias("url"))
    cards = rebuild_cards(role(s, d, "products").filter("active").select("product_id", "name", F.nullif("brand", F.lit("")).alias("brand")), {"images": images})
    xml = xml_rows(cards, "product")
    return xml.selectExpr("xpath_long(xml, '/product/product_id') AS product_id", "xpath_string(xml, '/product/name') AS name", "size(xpath(xml, '/product/brand')) AS brands", "size(xpath(xml, '/product/images')) AS images", "array_join(xpath(xml, '/product/images/url/text()'), ';') AS urls")


XML_EXPORT = f"""WITH {roles_sql('products', 'images')}, i AS (SELECT product_id, count(*) AS n, string_agg('u' || line, ';' ORDER BY position, 'u' || line) AS urls FROM images GROUP BY product_id)
SELECT product_id, name, CAST(brand <> '' AS INT) AS brands, CAST(coalesce(n, 0) AS INT) AS images, coalesce(urls, '') AS urls FROM products LEFT JOIN i USING (product_id) WHERE active"""
_DOCUMENT = (
    "p_partkey AS position", "CASE WHEN p_partkey % 20 = 0 THEN CAST(p_partkey - 1 AS STRING) WHEN p_partkey % 33 = 0 THEN CAST(p_partkey - 5 AS STRING) ELSE CAST(p_partkey AS STRING) END AS id", "CASE WHEN p_size = 9 THEN 'none' ELSE p_type END AS category_id",
    "CASE p_size % 8 WHEN 0 THEN '0' WHEN 1 THEN '1,5' WHEN 2 THEN NULL ELSE '12.50' END AS price", "CASE WHEN p_size % 6 = 0 THEN 'ftp://x' ELSE 'https://h/p' END AS url", "CASE p_size % 9 WHEN 0 THEN 'yes' ELSE 'true' END AS available",
)


def feed_document_check(s: SparkSession, d: str) -> DataFrame:
    part = t(s, d, "part")
    rows = document_problems(part.selectExpr(*_DOCUMENT), part.select(F.col("p_type").alias("category_id")))
    return rows.groupBy("id", "problem").agg(F.count("*").alias("n"))


FEED_DOCUMENT = f"""WITH o AS (SELECT {', '.join(_DOCUMENT)} FROM part), j AS (SELECT o.*, count(*) OVER (PARTITION BY id) AS n, lag(CAST(id AS BIGINT)) OVER (ORDER BY position) AS before FROM o),
p AS (SELECT id, unnest([CASE WHEN n > 1 THEN 'DUPLICATE_ID' END, CASE WHEN before > CAST(id AS BIGINT) THEN 'OUT_OF_ORDER' END, CASE WHEN category_id = 'none' THEN 'UNDECLARED_CATEGORY' END, CASE WHEN price IS NULL OR price <> '12.50' THEN 'INVALID_PRICE' END,
  CASE WHEN url <> 'https://h/p' THEN 'INVALID_URL' END, CASE WHEN available <> 'true' THEN 'UNKNOWN_AVAILABILITY' END]) AS problem FROM j) SELECT id, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL"""


# Selections as a whole


def selection_all_products(s: SparkSession, d: str) -> DataFrame:
    """The selection of every part, also of those without any offer."""
    rows = integrity.with_unoffered(_selection(s, d), t(s, d, "part").select(F.col("p_partkey").alias("product_id")).union(s.range(900_000_000, 900_000_005)), O.OfferPolicy().version)
    return rows.select(F.col("product_id").alias("part_key"), "status", "reason", "offer_id", "evaluated", "eligible")


SELECTION_ALL = f"""WITH {OFFERS} SELECT part_key, status, reason, offer_id, evaluated, eligible FROM selection UNION ALL SELECT k, 'no_eligible_offer', 'no_eligible_offer', NULL, 0, 0
FROM (SELECT p_partkey AS k FROM part UNION ALL SELECT i FROM range(900000000, 900000005) r(i)) WHERE k NOT IN (SELECT part_key FROM selection)"""


def selection_evidence(s: SparkSession, d: str) -> DataFrame:
    """What the evidence documents say, read back from them."""
    policy = O.OfferPolicy()
    evaluated = O.evaluate(_candidates(s, d), policy)
    made = integrity.selection_evidence(O.select(evaluated, policy), evaluated, policy, "lowest", "latest_crawl")
    one = lambda path: F.get_json_object("evidence", f"$.{path}")
    return made.select(
        F.col("product_id").alias("part_key"), one("selection_reason").alias("reason"), one("evaluated_candidate_count").cast("bigint").alias("evaluated"), one("selected_offer_id").cast("bigint").alias("offer_id"),
        F.size(F.json_object_keys("evidence")).cast("bigint").alias("fields"), F.json_array_length(one("candidate_offers")).cast("bigint").alias("offers"), one("availability_rank").cast("int").alias("availability_rank"),
    )


SELECTION_EVIDENCE = f"""WITH {OFFERS} SELECT s.part_key, reason, evaluated, s.offer_id, CAST(12 AS BIGINT) AS fields, (SELECT count(*) FROM ranked r WHERE r.part_key = s.part_key) AS offers,
  CASE s.availability WHEN 'in_stock' THEN 0 WHEN 'incoming' THEN 1 WHEN 'preorder' THEN 2 WHEN 'backorder' THEN 2 WHEN 'unknown' THEN 3 WHEN 'out_of_stock' THEN 4 WHEN 'discontinued' THEN 5 END::INT AS availability_rank FROM selection s"""


def selection_changes(s: SparkSession, d: str) -> DataFrame:
    """Which selections a second run would write anew, against a first run without some products and with another offer for some."""
    now = checkpointed(_selection(s, d))  # both runs read it
    before = now.filter("product_id % 4 <> 0").withColumn("offer_id", F.when(F.col("product_id") % 6 == 0, 1).otherwise(F.col("offer_id")))
    return integrity.changed_selections(before, now).groupBy("status", "changed").agg(F.count("*").alias("products"))


SELECTION_CHANGES = f"WITH {OFFERS} SELECT status, part_key % 4 = 0 OR (part_key % 6 = 0 AND offer_id IS DISTINCT FROM 1) AS changed, count(*) AS products FROM selection GROUP BY ALL"

QUERIES = {
    "product_export": (product_export, PRODUCT_EXPORT), "product_filters": (product_filters, PRODUCT_FILTERS), "export_details": (export_details, EXPORT_DETAILS), "export_totals": (export_totals, EXPORT_TOTALS),
    "export_counters": (export_counters, EXPORT_COUNTERS), "filter_options": (filter_options, FILTER_OPTIONS), "change_export": (change_export, CHANGE_EXPORT), "quality_dashboard": (quality_dashboard, QUALITY_DASHBOARD),
    "quality_history": (quality_history, QUALITY_HISTORY), "run_listing": (run_listing, RUN_LISTING), "run_progress": (run_progress, RUN_PROGRESS), "export_names": (export_names, EXPORT_NAMES),
    "content_completeness": (content_completeness, COMPLETENESS), "media_audit": (media_audit, MEDIA_AUDIT), "relation_buckets": (relation_buckets, RELATION_BUCKETS), "new_product_reasons": (new_product_reasons, NEW_REASONS),
    "nested_totals": (nested_totals, NESTED_TOTALS), "table_counts": (table_counts, TABLE_COUNTS), "keep_best": (keep_best, KEEP_BEST), "quota_sample": (quota_sample, QUOTA_SAMPLE), "trace_rows": (trace_rows, TRACE_ROWS),
    "target_problems": (target_problems, TARGET_PROBLEMS), "rollback_plan": (rollback_plan, ROLLBACK), "zero_write_check": (zero_write_check, ZERO_WRITE), "selection_all_products": (selection_all_products, SELECTION_ALL),
    "xml_export": (xml_export, XML_EXPORT), "feed_document_check": (feed_document_check, FEED_DOCUMENT), "selection_evidence": (selection_evidence, SELECTION_EVIDENCE), "selection_changes": (selection_changes, SELECTION_CHANGES),
}
