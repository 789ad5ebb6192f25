"""Relational queries over the catalog tables: (query, oracle SQL) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import fold, normalize_brand, normalize_model
from tallyforge.operators import checks
from tallyforge.operators import relational as R
from tallyforge.operators.feed import guard_leaks
from tallyforge.session import table as t


def latest_run_per_customer(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return R.latest_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


LATEST_RUN = """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
"""


def first_offer_per_product(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return R.latest_by(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], earliest=True)


FIRST_OFFER = """
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1
"""


def product_child_counts(s: SparkSession, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_discount")
    children = {"offers": lines, "returned": lines.filter("l_returnflag = 'R'"), "discounted": lines.filter("l_discount > 0.05")}
    return R.child_counts(t(s, d, "part").select("p_partkey", "p_brand"), "p_partkey", children)


CHILD_COUNTS = """
SELECT p_partkey, p_brand, coalesce(offers, 0) AS offers, coalesce(returned, 0) AS returned, coalesce(discounted, 0) AS discounted
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS offers, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
"""


def _tree(s: SparkSession, d: str) -> DataFrame:
    region = t(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nation = t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    supplier = t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("label"))
    return region.unionByName(nation).unionByName(supplier)


_TREE_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS key, NULL AS parent, r_name AS label FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
), walk AS (
  SELECT key AS node, key AS at, parent, label AS path, 0 AS depth FROM nodes
  UNION ALL SELECT w.node, n.key, n.parent, n.label || ' / ' || w.path, w.depth + 1 FROM walk w JOIN nodes n ON w.parent = n.key
)
"""


def category_path_concat(s: SparkSession, d: str) -> DataFrame:
    up = R.ancestors(_tree(s, d), "key", "parent", "label")
    return up.groupBy("node").agg(R.ordered_text(F.col("label"), -F.col("depth"), " / ").alias("path"))


CATEGORY_PATH = f"WITH RECURSIVE {_TREE_SQL} SELECT node, path FROM walk WHERE parent IS NULL"


def category_tree_depth(s: SparkSession, d: str) -> DataFrame:
    return R.ancestors(_tree(s, d), "key", "parent", "label").groupBy("node").agg(F.max("depth").cast("bigint").alias("depth"))


CATEGORY_DEPTH = f"WITH RECURSIVE {_TREE_SQL} SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY node"


def lineage_origin(s: SparkSession, d: str) -> DataFrame:
    turns = t(s, d, "conversations").select("conv_id", "turn")
    nodes = turns.select(F.concat_ws(":", "conv_id", "turn").alias("event"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("previous"))
    return R.origins(nodes, "event", "previous").select(F.col("node").alias("event"), "origin", F.col("depth").cast("bigint").alias("depth"))


LINEAGE = """
WITH islands AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id || ':' || turn AS event, conv_id || ':' || min(turn) OVER w AS origin, turn - min(turn) OVER w AS depth
FROM islands WINDOW w AS (PARTITION BY conv_id, island)
"""


def semi_exists(s: SparkSession, d: str) -> DataFrame:
    returned = t(s, d, "lineitem").filter("l_returnflag = 'R' AND l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return t(s, d, "part").join(returned, "p_partkey", "left_semi").select("p_partkey", "p_brand", "p_type")


SEMI = "SELECT p_partkey, p_brand, p_type FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount >= 0.09)"


def anti_not_exists(s: SparkSession, d: str) -> DataFrame:
    recent = t(s, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return t(s, d, "customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


ANTI = "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')"


def overlap_products(s: SparkSession, d: str) -> DataFrame:
    pairs = t(s, d, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("supplier")).distinct()
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("suppliers"), R.distinct_text(F.col("supplier")).alias("supplier_list")).filter("suppliers > 1")


OVERLAP = """
SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS supplier_list
FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1
"""


def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return R.repeated(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def supplier_quality_dashboard(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    issues = {
        "returned": c("l_returnflag") == "R", "open_lines": c("l_linestatus") == "O", "discontinued": (c("l_returnflag") == "A") & (c("l_linestatus") == "F"),
        "cheap": c("l_extendedprice") < 5000, "untaxed": c("l_tax") == 0, "deep_discount": c("l_discount") >= 0.1,
    }
    lines = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last_ship"), *R.conditional_counts(issues))
    products = t(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("products"))
    joined = t(s, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name").join(lines, "l_suppkey", "left").join(products, "l_suppkey", "left")
    return joined.na.fill(0, ["lines", "products", *issues])


DASHBOARD = """
SELECT s_suppkey AS l_suppkey, s_name, count(l_suppkey) AS lines, max(l_shipdate) AS last_ship, count(DISTINCT l_partkey) AS products,
  count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines,
  count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS discontinued, count(*) FILTER (WHERE l_extendedprice < 5000) AS cheap,
  count(*) FILTER (WHERE l_tax = 0) AS untaxed, count(*) FILTER (WHERE l_discount >= 0.1) AS deep_discount
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name
"""


def product_filter_page(s: SparkSession, d: str) -> DataFrame:
    conditions = [F.col("p_brand").isin("Brand#2", "Brand#4"), R.contains_text(["p_type"], "Econ"), F.col("p_size") >= 10]
    rows = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    for condition in conditions:
        rows = rows.filter(condition)
    found, total = R.page(rows, [F.desc("p_retailprice"), F.asc("p_partkey")], 1, 25)
    return found.crossJoin(F.broadcast(total))


FILTER_PAGE = """
WITH hits AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
  WHERE p_brand IN ('Brand#2', 'Brand#4') AND p_type ILIKE '%econ%' AND p_size >= 10)
SELECT *, (SELECT count(*) FROM hits) AS total, (SELECT greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) FROM hits) AS pages
FROM (SELECT * FROM hits ORDER BY p_retailprice DESC, p_partkey LIMIT 25)
"""


def text_search(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").filter(R.contains_text(["p_name", "p_type", "p_brand"], "SMALL") | R.contains_text(["p_name"], "ring")).select("p_partkey", "p_name", "p_type", "p_brand")


TEXT_SEARCH = """
SELECT p_partkey, p_name, p_type, p_brand FROM part
WHERE p_name ILIKE '%small%' OR p_type ILIKE '%small%' OR p_brand ILIKE '%small%' OR p_name ILIKE '%ring%'
"""


def fill_rates(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    fields = {"value": c("value") > 0, "props": R.blank_to_null(c("props")).isNotNull(), "k": F.get_json_object("props", "$.k").isNotNull(), "purchase": c("event_type") == "purchase", "user": c("user_id").isNotNull()}
    return R.coverage(t(s, d, "events"), fields)


FILL_RATES = """
SELECT field, present, n - present AS missing, CASE WHEN n = 0 THEN 0.0 ELSE round(present * 100.0 / n, 4)::DOUBLE END AS percent FROM (
  SELECT unnest(['value', 'props', 'k', 'purchase', 'user']) AS field, unnest([v, p, k, e, u]) AS present, n FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE value > 0) AS v, count(*) FILTER (WHERE nullif(trim(props), '') IS NOT NULL) AS p,
      count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS k, count(*) FILTER (WHERE event_type = 'purchase') AS e, count(user_id) AS u FROM events))
"""


def normalize_text_ascii(s: SparkSession, d: str) -> DataFrame:
    made = t(s, d, "documents").select("doc_id", fold(F.col("text")).alias("x"))
    return made.select("doc_id", F.length("x").cast("bigint").alias("n_chars"), F.sha2(F.col("x"), 256).alias("text_sha256"))


NORMALIZE_TEXT = r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё‐‑‒–—―−', 'е-------'), '[\s\x0B\x{85}\x{A0}]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM n
"""


def normalize_brand_model(s: SparkSession, d: str) -> DataFrame:
    model = F.concat(F.upper("p_brand"), F.lit(" "), F.substring("p_type", 1, 3), F.lit("-"), "p_size", F.lit("/"), "p_partkey")
    made = normalize_model(model, F.col("p_brand"), unicode=False)
    brand = normalize_brand(F.when(F.col("p_brand") == "Brand#1", " JET  Tools ").otherwise(F.col("p_brand")), unicode=False)
    return t(s, d, "part").select("p_partkey", brand.alias("brand"), made["model"].alias("model"), F.array_join(made["flags"], ";").alias("flags"))


BRAND_MODEL = """
WITH m AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b,
  regexp_replace(lower(upper(p_brand) || ' ' || substr(p_type, 1, 3) || '-' || p_size || '/' || p_partkey), '[^a-z0-9]', '', 'g') AS w FROM part)
SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'jet' ELSE lower(p_brand) END AS brand,
  CASE WHEN starts_with(w, b) THEN substr(w, length(b) + 1) ELSE w END AS model, CASE WHEN starts_with(w, b) THEN 'MODEL_CONTAINS_BRAND_PREFIX' ELSE '' END AS flags FROM m
"""


def exact_duplicate_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "documents").select("doc_id", "lang", "source", F.sha2(fold(F.col("text")), 256).alias("text_sha256"))
    return rows.groupBy("lang", "source", "text_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


EXACT_DUPLICATES = NORMALIZE_TEXT.rsplit("SELECT", 1)[0].replace("SELECT doc_id,", "SELECT doc_id, lang, source,", 1) + """
SELECT lang, source, sha256(x) AS text_sha256, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM n GROUP BY ALL HAVING count(*) > 1
"""


def false_match_guard(s: SparkSession, d: str) -> DataFrame:
    """Documents that a guard table forbids, by language; before publishing there must be none."""
    forbidden = t(s, d, "labels").filter("quality = 0").select("doc_id")
    hits = guard_leaks(t(s, d, "documents").select("doc_id", "lang"), forbidden, ["doc_id"])
    return hits.groupBy("lang").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


FALSE_MATCH = "SELECT lang, count(*) AS documents, min(doc_id) AS first_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY lang"


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    return R.stratified(t(s, d, "documents").select("doc_id", "source", "lang"), "source", ["doc_id"], 50)


STRATIFIED = """
SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 AS extra FROM documents)
ORDER BY extra, doc_id LIMIT 50
"""


def top_k_per_group(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.desc(F.col("l_orderkey").cast("string")), F.desc("l_linenumber"), F.desc("l_partkey")]
    return R.top_k(rows, ["l_suppkey"], order, 10).withColumn("rank", F.col("rank").cast("bigint"))


TOP_K = """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice DESC, CAST(l_orderkey AS VARCHAR) DESC, l_linenumber DESC, l_partkey DESC) AS rank FROM lineitem) WHERE rank <= 10
"""


def union_distinct_ids(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    b = t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return a.union(b).distinct()


UNION_IDS = "SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem"


def period_changes(s: SparkSession, d: str) -> DataFrame:
    events = t(s, d, "events").select("event_id", "ts", "event_type")
    as_of = events.agg(F.max("ts").alias("as_of"))
    spans = {"24h": "24 HOURS", "7d": "7 DAYS"}
    rows = events.crossJoin(F.broadcast(as_of))
    inside = [F.when(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {span}"), F.lit(name)) for name, span in spans.items()]
    return rows.select("event_type", F.explode(F.array_compact(F.array(*inside))).alias("period")).groupBy("event_type", "period").agg(F.count("*").alias("events"))


PERIODS = """
WITH m AS (SELECT max(ts) AS as_of FROM events)
SELECT event_type, period, count(*) AS events FROM (
  SELECT event_type, '24h' AS period FROM events, m WHERE ts >= as_of - INTERVAL 24 HOUR
  UNION ALL SELECT event_type, '7d' FROM events, m WHERE ts >= as_of - INTERVAL 7 DAY) GROUP BY ALL
"""


def constraint_suite(s: SparkSession, d: str) -> DataFrame:
    tables = {n: t(s, d, n) for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "pages")}
    c = F.col
    return checks.suite({
        "line_quantity_positive": checks.must_hold(tables["lineitem"], c("l_quantity") > 0),
        "line_discount_range": checks.must_hold(tables["lineitem"], c("l_discount").between(0, 0.05)),
        "order_status_known": checks.must_hold(tables["orders"], c("o_orderstatus").isin("O", "F")),
        "page_url_shape": checks.must_hold(tables["pages"], c("url").rlike("^https?://")),
        "line_key_unique": checks.unique(tables["lineitem"], ["l_orderkey", "l_linenumber"]),
        "order_key_unique": checks.unique(tables["orders"], ["o_orderkey"]),
        "one_open_order": checks.unique(tables["orders"], ["o_custkey"], c("o_orderstatus") == "O"),
        "line_part_known": checks.references(tables["lineitem"], ["l_partkey"], tables["part"], ["p_partkey"]),
        "line_order_known": checks.references(tables["lineitem"], ["l_orderkey"], tables["orders"], ["o_orderkey"]),
        "nation_region_known": checks.references(tables["nation"], ["n_regionkey"], tables["region"], ["r_regionkey"]),
        "label_document_known": checks.references(tables["labels"], ["doc_id"], tables["documents"], ["doc_id"]),
        "part_not_in_both_states": checks.exactly_one(tables["events"], ["event_type", "props"]),
    })


CONSTRAINTS = """
SELECT 'line_quantity_positive' AS check_name, count(*) AS violations FROM lineitem WHERE NOT l_quantity > 0
UNION ALL SELECT 'line_discount_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05
UNION ALL SELECT 'order_status_known', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'page_url_shape', count(*) FROM pages WHERE NOT regexp_matches(url, '^https?://')
UNION ALL SELECT 'line_key_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'order_key_unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'one_open_order', count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'line_part_known', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'line_order_known', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'nation_region_known', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'label_document_known', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'part_not_in_both_states', count(*) FROM events WHERE (event_type IS NOT NULL)::INT + (props IS NOT NULL)::INT <> 1
"""


def json_extract(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    has = F.array_contains(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")), "k")
    rows = t(s, d, "events").select("event_type", k.alias("k"), has.alias("has"))
    return rows.groupBy("event_type").agg(F.count_if("has").alias("with_key"), F.sum("k").alias("k_sum"), F.min("k").alias("k_min"), F.max("k").alias("k_max"))


JSON_EXTRACT = """
WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_contains(json_keys(props), 'k') AS has FROM events)
SELECT event_type, count(*) FILTER (WHERE has) AS with_key, CAST(sum(k) AS BIGINT) AS k_sum, min(k) AS k_min, max(k) AS k_max FROM e GROUP BY event_type
"""

QUERIES = {
    "latest_run_per_customer": (latest_run_per_customer, LATEST_RUN), "first_offer_per_product": (first_offer_per_product, FIRST_OFFER),
    "product_child_counts": (product_child_counts, CHILD_COUNTS), "category_path_concat": (category_path_concat, CATEGORY_PATH),
    "category_tree_depth": (category_tree_depth, CATEGORY_DEPTH), "lineage_origin": (lineage_origin, LINEAGE), "semi_exists": (semi_exists, SEMI),
    "anti_not_exists": (anti_not_exists, ANTI), "overlap_products": (overlap_products, OVERLAP), "duplicate_keys": (duplicate_keys, DUPLICATES),
    "supplier_quality_dashboard": (supplier_quality_dashboard, DASHBOARD), "product_filter_page": (product_filter_page, FILTER_PAGE), "text_search": (text_search, TEXT_SEARCH),
    "fill_rates": (fill_rates, FILL_RATES), "normalize_text_ascii": (normalize_text_ascii, NORMALIZE_TEXT), "normalize_brand_model": (normalize_brand_model, BRAND_MODEL),
    "exact_duplicate_blocks": (exact_duplicate_blocks, EXACT_DUPLICATES), "false_match_guard": (false_match_guard, FALSE_MATCH), "stratified_sample": (stratified_sample, STRATIFIED),
    "top_k_per_group": (top_k_per_group, TOP_K), "union_distinct_ids": (union_distinct_ids, UNION_IDS), "period_changes": (period_changes, PERIODS),
    "constraint_suite": (constraint_suite, CONSTRAINTS), "json_extract": (json_extract, JSON_EXTRACT),
}
