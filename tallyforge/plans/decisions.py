"""Queries of the decision operators: offers, matching, identity, feed, plans, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.models import extract_model, model_tokens
from tallyforge.functions.units import compare_property, mapping_score
from tallyforge.operators import feed as X
from tallyforge.operators import identity as I
from tallyforge.operators import matching as M
from tallyforge.operators import offers as O
from tallyforge.operators import quality as Q
from tallyforge.operators import relational as R
from tallyforge.plans.offers_sql import OFFERS
from tallyforge.session import checkpointed
from tallyforge.session import table as t


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """Offers of the test tables as selection candidates: the latest line per (part, supplier)."""
    c = F.col
    newest = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"))  # half of what max_by moves
    latest = t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(newest.alias("x")).select("l_partkey", "l_suppkey", "x.*")
    crawl = t(s, d, "lineitem").groupBy("l_suppkey").agg((F.max("l_shipdate") - F.expr("INTERVAL 365 DAYS")).alias("latest_crawl_at"))
    state = (
        F.when((c("l_returnflag") == "N") & (c("l_linestatus") == "O"), "in_stock").when(c("l_returnflag") == "N", "preorder").when(c("l_linestatus") == "O", "backorder")
        .when(c("l_returnflag") == "R", "out_of_stock").otherwise("discontinued")
    )
    price = F.expr("CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 100) DIV CAST(l_quantity AS BIGINT) / 10000.0BD AS DECIMAL(18,4))")
    supplier = t(s, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), (c("s_nationkey") % 2).alias("supplier_priority"))
    rows = latest.join(F.broadcast(supplier.join(crawl, "l_suppkey")), "l_suppkey")  # a row a supplier, so that the lines move for their pair only
    return rows.select(
        c("l_partkey").alias("product_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("offer_id"), c("l_suppkey").alias("source_id"), c("l_suppkey").alias("supplier_id"),
        c("l_suppkey").alias("offer_supplier_id"), F.lpad(c("l_suppkey").cast("string"), 12, "0").alias("supplier_code"), F.lit(True).alias("supplier_enabled"),
        c("l_partkey").alias("source_product_id_link"), F.lit(True).alias("source_active"), F.lit(0).alias("source_missed"), c("l_shipdate").alias("source_success_at"),
        F.lit(True).alias("offer_active"), F.lit("default").alias("offer_kind"), F.lit(0).alias("offer_missed"), c("l_shipdate").alias("offer_success_at"), "latest_crawl_at",
        price.alias("price"), F.lit("RUB").alias("currency"), state.alias("availability"), c("l_quantity").alias("quantity"), "supplier_priority",
    )


def _selection(s: SparkSession, d: str) -> DataFrame:
    policy = O.OfferPolicy()
    return O.select(O.evaluate(_candidates(s, d), policy), policy, ("availability", "quantity", "offer_success_at"))


def offer_selection(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _selection(s, d).select(c("product_id").alias("part_key"), "status", "reason", "offer_id", c("supplier_id").alias("supplier_key"), "price", "evaluated", "eligible")


OFFER_SELECTION = f"WITH {OFFERS} SELECT part_key, status, reason, offer_id, supplier_key, price, evaluated, eligible FROM selection"


def offer_eligibility_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = O.evaluate(_candidates(s, d), O.OfferPolicy())
    return rows.select(F.col("product_id").alias("part_key"), F.col("supplier_id").alias("supplier_key"), "offer_id", "eligible", F.array_join("exclusion_reasons", ";").alias("reasons"))


ELIGIBILITY = f"""
WITH {OFFERS} SELECT part_key, supplier_key, offer_id, ok AS eligible, concat_ws(';', CASE WHEN availability = 'discontinued' THEN 'availability_not_eligible' END,
  CASE WHEN NOT fresh THEN 'source_product_not_confirmed_by_latest_crawl;offer_not_confirmed_by_latest_crawl' END) AS reasons FROM ranked
"""


def offer_status_counts(s: SparkSession, d: str) -> DataFrame:
    return _selection(s, d).groupBy("status", "reason").agg(F.count("*").alias("products"))


STATUS_COUNTS = f"WITH {OFFERS} SELECT status, reason, count(*) AS products FROM selection GROUP BY ALL"


def _feed(s: SparkSession, d: str, selection: DataFrame | None = None) -> DataFrame:
    """Selected offers as feed rows, with some gaps that the rules must find."""
    c = F.col
    chosen = (_selection(s, d) if selection is None else selection).filter("status = 'selected'").withColumnRenamed("offer_success_at", "ship")
    part = t(s, d, "part").select(c("p_partkey").alias("product_id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    rows = chosen.join(part, "product_id", "left")
    return rows.select(
        c("product_id").alias("catalog_product_id"), c("status").alias("selection_status"), c("offer_id").alias("selected_offer_id"), "offer_id", c("supplier_id").alias("source_product_id"),
        c("product_id").alias("source_catalog_product_id"), c("supplier_id").alias("offer_supplier_id"), c("supplier_id").alias("source_supplier_id"),
        F.when(c("product_id") % 11 == 0, "REVIEW").otherwise("EXACT_MATCH").alias("match_status"), c("product_id").alias("match_catalog_product_id"), F.lit(True).alias("supplier_enabled"),
        F.lit(True).alias("source_active"), F.lit(True).alias("offer_active"), (c("p_size") < 48).alias("target_active"), c("product_id").cast("string").alias("target_id"),
        F.when(c("product_id") % 13 == 0, "  ").otherwise(c("p_name")).alias("target_name"),
        F.concat(F.when(c("product_id") % 17 == 0, "ftp").otherwise("https"), F.lit("://shop.example.com/p/"), "product_id").alias("target_url"), c("p_type").alias("category_name"),
        F.lower("p_type").alias("category_id"), c("p_brand").alias("target_brand"), "price", F.lit("RUB").alias("currency"), "availability", "quantity", "rule_version", "ship",
    )


_FEED_SQL = f"""{OFFERS}, feed AS (
  SELECT s.part_key, CASE WHEN s.part_key % 11 = 0 THEN 'REVIEW' ELSE 'EXACT_MATCH' END AS match_status, p_size, p_name, p_type, p_brand, price, s.availability, s.quantity, s.ship, s.part_key % 13 = 0 AS nameless, s.part_key % 17 = 0 AS urlless
  FROM selection s JOIN part ON p_partkey = s.part_key WHERE status = 'selected'
)"""


def feed_violations(s: SparkSession, d: str) -> DataFrame:
    rows = _feed(s, d)
    return X.exclusion_counts(rows.withColumn("violations", X.row_violations(rows)))


FEED_VIOLATIONS = f"""
WITH {_FEED_SQL} SELECT code, products FROM (SELECT 'NO_CURRENT_ACCEPTED_MATCH' AS code, count(*) FILTER (WHERE match_status = 'REVIEW') AS products FROM feed
  UNION ALL SELECT 'INACTIVE_OR_MISSING_TARGET_PRODUCT', count(*) FILTER (WHERE p_size >= 48) FROM feed
  UNION ALL SELECT 'MISSING_TARGET_NAME', count(*) FILTER (WHERE nameless) FROM feed
  UNION ALL SELECT 'INVALID_TARGET_URL', count(*) FILTER (WHERE urlless) FROM feed) WHERE products > 0
"""


def _clean_feed(s: SparkSession, d: str, selection: DataFrame | None = None) -> DataFrame:
    rows = _feed(s, d, selection)
    return rows.filter(F.size(X.row_violations(rows)) == 0)


def feed_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _clean_feed(s, d).withColumns({"supplier_sku": F.lit(None).cast("string"), "supplier_external_id": F.lit(None).cast("string"), "target_article": F.lit(None).cast("string"), "old_price": F.lit(None).cast("decimal(18,4)")})
    return X.feed_values(rows).select("id", "available", "url", "price", "currency_id", "category_id", "name", "vendor")


_CLEAN = "match_status <> 'REVIEW' AND p_size < 48 AND NOT nameless AND NOT urlless"
FEED_ROWS = f"""
WITH {_FEED_SQL} SELECT CAST(part_key AS VARCHAR) AS id, CASE WHEN availability = 'in_stock' THEN 'true' ELSE 'false' END AS available,
  'https://shop.example.com/p/' || part_key AS url, rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.') AS price, 'RUB' AS currency_id, lower(p_type) AS category_id, p_name AS name, p_brand AS vendor
FROM feed WHERE {_CLEAN}
"""


def feed_manifest(s: SparkSession, d: str) -> DataFrame:
    selection = checkpointed(_selection(s, d))  # both sides of the manifest read it
    return X.manifest(_clean_feed(s, d, selection), selection, ["ship"]).withColumn("price_sum", F.col("price_sum").cast("decimal(28,4)"))


FEED_MANIFEST = f"""
WITH {_FEED_SQL} SELECT count(*) AS offers, count(DISTINCT p_type) AS categories, CAST(sum(price) AS DECIMAL(28,4)) AS price_sum, max(ship) AS snapshot_at,
  (SELECT count(*) FROM selection WHERE status = 'selected') AS selected, (SELECT count(*) FROM selection WHERE status = 'review') AS review,
  (SELECT count(*) FROM selection WHERE status = 'no_eligible_offer') AS no_eligible_offer FROM feed WHERE {_CLEAN}
"""


def dry_run_plan(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    current = t(s, d, "part").select(c("p_partkey").alias("product_id"), F.when(c("p_partkey") % 7 != 0, c("p_retailprice").cast("decimal(18,2)").cast("decimal(18,4)")).alias("current_price"), F.when(c("p_size") % 5 != 0, F.when(c("p_size") % 2 == 0, "in_stock").otherwise("backorder")).alias("current_availability"), (c("p_partkey") % 19 != 0).cast("int").alias("targets"))
    chosen = _selection(s, d).filter("status = 'selected'").select("product_id", "price", "availability")
    states = chosen.join(current, "product_id").select(c("product_id").alias("id"), "price", "availability", "current_price", "current_availability", "targets", F.lit("").alias("error"))
    return X.plan_updates(states).select("id", "price_change", "availability_change", c("price_delta").cast("decimal(18,4)").alias("price_delta"), "action", "blocking_reason")


DRY_RUN = f"""
WITH {OFFERS}, st AS (
  SELECT s.part_key AS id, s.price, s.availability, CASE WHEN s.part_key % 7 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS cp,
    CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'backorder' END END AS ca, s.part_key % 19 <> 0 AS known
  FROM selection s JOIN part ON p_partkey = s.part_key WHERE status = 'selected'
), ch AS (
  SELECT *, CASE WHEN cp IS NULL THEN 'UNKNOWN_CURRENT' WHEN price = cp THEN 'UNCHANGED' WHEN price > cp THEN 'INCREASE' ELSE 'DECREASE' END AS price_change,
    CASE WHEN ca IS NULL THEN 'UNKNOWN_CURRENT' WHEN ca = availability THEN 'UNCHANGED' ELSE 'CHANGE' END AS availability_change FROM st
)
SELECT id, price_change, availability_change, CAST(price - cp AS DECIMAL(18,4)) AS price_delta,
  CASE WHEN NOT known THEN 'BLOCKED_IDENTITY' WHEN ca IS NULL THEN 'BLOCKED_UNSUPPORTED_STATE' WHEN price_change <> 'UNCHANGED' AND availability_change <> 'UNCHANGED' THEN 'WOULD_UPDATE_PRICE_AND_AVAILABILITY'
    WHEN price_change <> 'UNCHANGED' THEN 'WOULD_UPDATE_PRICE' WHEN availability_change <> 'UNCHANGED' THEN 'WOULD_UPDATE_AVAILABILITY' ELSE 'NO_CHANGE' END AS action,
  CASE WHEN NOT known THEN 'MISSING_TARGET' WHEN ca IS NULL THEN 'CURRENT_AVAILABILITY_NOT_MAPPABLE' ELSE '' END AS blocking_reason FROM ch
"""


def candidate_cascade(s: SparkSession, d: str) -> DataFrame:
    """Tiers of exact keys; each tier meets the registry's aggregate per key, so hot keys stay single rows."""
    part = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    source, registry = part.filter("p_partkey % 2 = 1"), part.filter("p_partkey % 2 = 0")
    found = None
    for tier, keys in enumerate((["p_name", "p_brand", "p_type", "p_size"], ["p_name", "p_brand", "p_type"], ["p_name", "p_brand"], ["p_brand"]), 1):
        known = registry.groupBy(*keys).agg(F.min("p_partkey").alias("candidate"), F.count("*").alias("candidates"))
        rows = source.join(known, keys).select("p_partkey", F.lit(tier).alias("tier"), "candidate", "candidates")
        found = rows if found is None else found.unionByName(rows)
    return R.first_tier(found, "p_partkey")


CASCADE = " UNION ALL ".join(
    f"SELECT p_partkey, {tier} AS tier, candidate, candidates FROM part JOIN (SELECT {keys}, min(p_partkey) AS candidate, count(*) AS candidates FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) USING ({keys}) WHERE p_partkey % 2 = 1"
    for tier, keys in enumerate(("p_name, p_brand, p_type, p_size", "p_name, p_brand, p_type", "p_name, p_brand", "p_brand"), 1)
)
CASCADE = f"WITH f AS ({CASCADE}) SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY p_partkey)"


def _products(s: SparkSession, d: str, odd: bool) -> DataFrame:
    """Parts as matching products: neighbours share a model; brands, names and sizes may differ."""
    c = F.col
    pair = F.floor(c("p_partkey") / 2)
    code = F.concat(F.lit("PX"), pair, F.upper(F.substring("p_type", 1, 1)) if not odd else F.lit(""))
    rows = t(s, d, "part").filter(c("p_partkey") % 2 == (1 if odd else 0))
    articles = F.create_map(F.lit("sup"), F.array(F.concat(F.lit("A-"), pair)))
    return rows.select(
        c("p_partkey").alias("key"), F.concat_ws(" ", "p_name", code).alias("name"), F.concat(F.lit("Brand#"), pair % 9).alias("brand"), F.concat(F.lit("PX"), pair).alias("model"),
        F.when(c("p_partkey") % 10 == 1, F.concat(F.lit("a"), pair)).otherwise("").alias("supplier_article"), F.lit("").alias("manufacturer_article"), c("p_type").alias("category"),
        F.create_map(F.lit("length"), F.concat(c("p_size").cast("string"), F.lit(" mm"))).alias("properties"), F.lit("sup").alias("supplier_code"), articles.alias("identifiers"), F.lit("").alias("kind"),
    )


def match_status(s: SparkSession, d: str) -> DataFrame:
    rows = M.match(_products(s, d, True), _products(s, d, False))
    return rows.select("source_key", "status", "method", F.round("confidence", 4).alias("confidence"), "candidate_key", F.array_join("conflicts", ";").alias("conflicts"), "auto_accepted")


def identity_decision(s: SparkSession, d: str) -> DataFrame:
    matches, sources, registry = M.resolve(_products(s, d, True), _products(s, d, False))
    return I.classify(matches, sources, registry).select("source_key", "decision", "product_kind", "model_role", "own_model", "candidate_ids", "auto_accepted")


#: Titles with a family before a code, an execution after one, a gap between letters and digits, and no model.
_TITLE = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' DH ' || p_size || 'V ' || p_partkey WHEN 1 THEN ' PX-' || p_size || 'F NEW' WHEN 2 THEN ' TU ' || (p_size + 10) || ' V' ELSE '' END"


def model_tokens_query(s: SparkSession, d: str) -> DataFrame:
    title = F.expr(_TITLE)
    return t(s, d, "part").select("p_partkey", extract_model(title).alias("model"), F.array_join(model_tokens(title), ";").alias("models"))


MODEL_TOKENS = rf"""
WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part), w AS (SELECT p_partkey, title, string_split(title, ' ') AS words FROM t),
i AS (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS at_ FROM w),
f AS (SELECT p_partkey, at_, words[at_] AS word, lower(regexp_replace(words[at_], '[^A-Za-z0-9]', '', 'g')) AS form, CASE WHEN at_ > 1 THEN words[at_ - 1] END AS before, CASE WHEN at_ < len(words) THEN words[at_ + 1] END AS after_ FROM i),
c AS (SELECT p_partkey, at_, form || CASE WHEN lower(after_) IN ('new', 'pro', 'plus', 'max', 'mini') OR (regexp_full_match(after_, '[A-Z]{{1,2}}') AND lower(after_) NOT IN ('w', 'g', 'm', 'kw')) THEN lower(after_) ELSE '' END AS own, CASE WHEN regexp_full_match(before, '[A-Z]{{1,6}}') THEN lower(before) ELSE '' END AS family
  FROM f WHERE regexp_matches(form, '[a-z]') AND regexp_matches(form, '[0-9]')),
g AS (SELECT p_partkey, array_to_string(list(own ORDER BY at_), ';') AS models, arg_min(family || own, at_) AS model FROM c GROUP BY p_partkey),
s AS (SELECT p_partkey, regexp_extract(lower(title), '\b([a-z]{{1,12}})[ -]+([0-9]{{2,}})', 1) || regexp_extract(lower(title), '\b([a-z]{{1,12}})[ -]+([0-9]{{2,}})', 2) AS gap, regexp_extract(title, '[0-9]{{2,}} ([A-Z]{{1,2}})$', 1) AS tail FROM w)
SELECT p_partkey, coalesce(model, gap || CASE WHEN gap <> '' THEN lower(tail) ELSE '' END) AS model, coalesce(models, gap) AS models FROM w LEFT JOIN g USING (p_partkey) LEFT JOIN s USING (p_partkey)
"""


def name_similarity_blocked(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "part").select(F.col("p_partkey").alias("key"), "p_name", F.concat_ws("/", "p_brand", "p_type", "p_size", "p_name").alias("BRAND_TYPE_SIZE_NAME"), F.concat_ws("/", "p_brand", F.substring("p_name", 1, 12)).alias("names"))
    return M.duplicate_candidates(rows, ["BRAND_TYPE_SIZE_NAME"], "names", "p_name")


def property_compare(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    right = (
        F.when(c("p_partkey") % 4 == 0, F.concat(c("p_size").cast("string"), F.lit("mm"))).when(c("p_partkey") % 4 == 1, F.concat(F.floor(c("p_size") / 10), F.lit(","), c("p_size") % 10, F.lit(" cm")))
        .when(c("p_partkey") % 4 == 2, F.concat((c("p_size") + 1).cast("string"), F.lit(" mm"))).otherwise(F.concat(c("p_size").cast("string"), F.lit(" kg")))
    )
    left = F.concat(c("p_size").cast("string"), F.lit(" mm"))
    weight = F.concat(c("p_size").cast("string"), F.lit(" kg"))
    heavier = F.concat((c("p_size") + c("p_partkey") % 3).cast("string"), F.lit(" кг"))
    return t(s, d, "part").select("p_partkey", compare_property(left, right, "length").alias("length_class"), compare_property(weight, heavier, "weight").alias("weight_class"))


PROPERTY_COMPARE = r"""
WITH v AS (SELECT p_partkey, p_size || ' mm' AS a, CASE p_partkey % 4 WHEN 0 THEN p_size || 'mm' WHEN 1 THEN p_size // 10 || ',' || p_size % 10 || ' cm' WHEN 2 THEN (p_size + 1) || ' mm' ELSE p_size || ' kg' END AS b, p_size || ' kg' AS c, (p_size + p_partkey % 3) || ' кг' AS d FROM part),
l(unit, factor) AS (VALUES ('mm', 1), ('cm', 10), ('m', 1000)), k(unit, factor) AS (VALUES ('g', 0.001), ('kg', 1), ('t', 1000), ('кг', 1)),
n AS (SELECT *, [struct_pack(raw := x, number := TRY_CAST(replace(regexp_extract(x, '^([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DECIMAL(18,6)), unit := regexp_extract(x, '([^0-9., ]+)$', 1)) FOR x IN [a, b, c, d]] AS p FROM v),
m AS (SELECT p_partkey, p, p[1].number * l1.factor AS la, p[2].number * l2.factor AS lb, p[3].number * k1.factor AS wa, p[4].number * k2.factor AS wb FROM n LEFT JOIN l l1 ON l1.unit = p[1].unit LEFT JOIN l l2 ON l2.unit = p[2].unit LEFT JOIN k k1 ON k1.unit = p[3].unit LEFT JOIN k k2 ON k2.unit = p[4].unit)
SELECT p_partkey, CASE WHEN la = lb THEN CASE WHEN p[1].unit <> p[2].unit THEN 'PROPERTY_UNIT_VARIATION' WHEN p[1].raw <> p[2].raw THEN 'PROPERTY_FORMAT_VARIATION' ELSE 'PROPERTY_EQUAL' END WHEN la <> lb THEN 'PROPERTY_IDENTITY_CONFLICT' ELSE 'PROPERTY_DATA_QUALITY_WARNING' END AS length_class,
  CASE WHEN wa = wb THEN CASE WHEN p[3].unit <> p[4].unit THEN 'PROPERTY_UNIT_VARIATION' ELSE 'PROPERTY_EQUAL' END WHEN abs(wa - wb) <= 1 THEN 'PROPERTY_WITHIN_TOLERANCE' ELSE 'PROPERTY_DATA_QUALITY_WARNING' END AS weight_class FROM m
"""


def property_mapping_score(s: SparkSession, d: str) -> DataFrame:
    names = t(s, d, "part").select("p_name").distinct()
    canonical = s.createDataFrame([("small_ring", "small ring size"), ("ring", "ring"), ("length", "length of the rod")], "property string, words string")
    rows = names.crossJoin(F.broadcast(canonical))
    unit_ok, category_ok = F.col("property") == "ring", F.col("p_name").startswith("s")
    return rows.select("p_name", "property", F.round(mapping_score(F.col("p_name"), F.col("words"), unit_ok, category_ok), 4).alias("score"))


MAPPING_SCORE = """
WITH c(property, words) AS (VALUES ('small_ring', 'small ring size'), ('ring', 'ring'), ('length', 'length of the rod')),
n AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS a FROM part), w AS (SELECT property, list_distinct(string_split(words, ' ')) AS b FROM c)
SELECT p_name, property, round(0.65 * (len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))) + 0.25 * (property = 'ring')::INT + 0.10 * starts_with(p_name, 's')::INT, 4)::DOUBLE AS score FROM n, w
"""


def review_queue(s: SparkSession, d: str) -> DataFrame:
    """Cases of two days compared by fingerprint, as the review sync sees them."""
    c = F.col
    events = t(s, d, "events").select("event_id", "ts", c("user_id").alias("product_id"), c("event_type").alias("fingerprint"), (c("value") > 100).alias("urgent"))
    split = F.expr("TIMESTAMP_NTZ '2024-01-16'")
    order = ["ts", "event_id"]
    current, incoming = R.latest_by(events.filter(c("ts") < split), ["product_id"], order), R.latest_by(events.filter(c("ts") >= split), ["product_id"], order)
    rows = Q.review_cases(current, incoming)
    return rows.select("product_id", "event_id", "action", F.when(c("urgent"), 1).otherwise(2).alias("priority"))


REVIEW_QUEUE = """
WITH c AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS p FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
i AS (SELECT user_id, event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT i.user_id AS product_id, event_id, CASE WHEN p IS NULL THEN 'INSERT' WHEN p = event_type THEN 'UNCHANGED' ELSE 'REOPEN' END AS action, CASE WHEN value > 100 THEN 1 ELSE 2 END AS priority
FROM i LEFT JOIN c USING (user_id)
"""

QUERIES = {
    "offer_selection": (offer_selection, OFFER_SELECTION), "offer_eligibility_reasons": (offer_eligibility_reasons, ELIGIBILITY), "offer_status_counts": (offer_status_counts, STATUS_COUNTS),
    "feed_violations": (feed_violations, FEED_VIOLATIONS), "feed_rows": (feed_rows, FEED_ROWS), "feed_manifest": (feed_manifest, FEED_MANIFEST), "dry_run_plan": (dry_run_plan, DRY_RUN),
    "candidate_cascade": (candidate_cascade, CASCADE), "match_status": (match_status, None), "identity_decision": (identity_decision, None), "model_tokens": (model_tokens_query, MODEL_TOKENS),
    "name_similarity_blocked": (name_similarity_blocked, None), "property_compare": (property_compare, PROPERTY_COMPARE), "property_mapping_score": (property_mapping_score, MAPPING_SCORE),
    "review_queue": (review_queue, REVIEW_QUEUE),
}
