"""Queries of upkeep: merges, history, quality, missing products, rules, previews, URLs, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import merge as U
from tallyforge.operators import quality as Q
from tallyforge.operators import relational as R
from tallyforge.session import shared_folder
from tallyforge.session import table as t
from tallyforge.sources.readers import normalize_url, parse_page

_GROUPS = {"state": ["o_orderstatus"], "commercial": ["o_orderpriority", "price"]}


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over orders: the second lacks some, adds some, and changes prices and states."""
    c = F.col
    orders = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round(c("o_totalprice") * 100).cast("bigint").alias("price"))
    first = orders.filter("o_orderkey % 3 <> 0")
    second = orders.filter("o_orderkey % 5 <> 0").withColumns({"price": c("price") + F.when(c("o_orderkey") % 7 == 0, 100).otherwise(0), "o_orderstatus": F.when(c("o_orderkey") % 11 == 0, "X").otherwise(c("o_orderstatus"))})
    return first, second


_RUNS_SQL = """
o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
a AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, price + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS price FROM o WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS fresh, b.o_orderkey IS NULL AS gone,
  a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS state, a.price IS DISTINCT FROM b.price OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS commercial,
  a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_orderpriority AS p1, b.o_orderpriority AS p2, a.price AS c1, b.price AS c2 FROM a FULL JOIN b USING (o_orderkey))
"""


def change_detection(s: SparkSession, d: str) -> DataFrame:
    rows = U.compare(*_runs(s, d), ["o_orderkey"], _GROUPS)
    return rows.select("o_orderkey", "status", F.array_join("changed_groups", ";").alias("changed_groups"))


CHANGES = f"""
WITH {_RUNS_SQL} SELECT o_orderkey, CASE WHEN fresh THEN 'NEW' WHEN gone THEN 'MISSING' WHEN state OR commercial THEN 'CHANGED' ELSE 'UNCHANGED' END AS status,
  CASE WHEN fresh OR gone THEN '' ELSE concat_ws(';', CASE WHEN state THEN 'state' END, CASE WHEN commercial THEN 'commercial' END) END AS changed_groups FROM j
"""


def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    first, second = _runs(s, d)
    values = ["o_orderstatus", "o_orderpriority", "price"]
    return U.merge_snapshot(first.withColumn("last_changed_at", F.lit(1).cast("bigint")), second, ["o_orderkey"], values, F.lit(2).cast("bigint"))


MERGE = f"""
WITH {_RUNS_SQL} SELECT o_orderkey, CASE WHEN gone THEN s1 ELSE s2 END AS o_orderstatus, CASE WHEN gone THEN p1 ELSE p2 END AS o_orderpriority,
  CASE WHEN gone THEN c1 ELSE c2 END AS price, CAST(CASE WHEN gone OR (NOT fresh AND NOT state AND NOT commercial) THEN 1 ELSE 2 END AS BIGINT) AS last_changed_at FROM j
"""


def history_events(s: SparkSession, d: str) -> DataFrame:
    rows = U.compare(*_runs(s, d), ["o_orderkey"], _GROUPS)
    return U.history(rows, ["o_orderkey"], _GROUPS, F.lit(2).cast("bigint"))


HISTORY = f"""
WITH {_RUNS_SQL}, k AS (SELECT * FROM j WHERE NOT fresh AND NOT gone)
SELECT o_orderkey, 'state' AS field_group, '{{"o_orderstatus":"' || s1 || '"}}' AS old_value, '{{"o_orderstatus":"' || s2 || '"}}' AS new_value, CAST(2 AS BIGINT) AS observed_at FROM k WHERE state
UNION ALL SELECT o_orderkey, 'commercial', '{{"o_orderpriority":"' || p1 || '","price":' || c1 || '}}', '{{"o_orderpriority":"' || p2 || '","price":' || c2 || '}}', 2 FROM k WHERE commercial
"""


def decision_persistence(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    events = t(s, d, "events").select("event_id", "ts", "user_id", c("event_type").alias("fingerprint"))
    split = F.expr("TIMESTAMP_NTZ '2024-01-16'")
    current = R.latest_by(events.filter(c("ts") < split), ["user_id"], ["ts", "event_id"]).withColumn("is_current", F.lit(True))
    incoming = R.latest_by(events.filter(c("ts") >= split), ["user_id"], ["ts", "event_id"], earliest=True)
    rows = U.decision_events(current, incoming, "user_id", "fingerprint")
    quarantined = (c("action") == "INSERT") & c("previous_event_id").isNotNull() & (c("fingerprint") == "error")
    return rows.select("user_id", "event_id", "previous_event_id", "action", quarantined.alias("quarantined"))


DECISIONS = """
WITH c AS (SELECT user_id, event_id AS previous_event_id, event_type AS p FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
i AS (SELECT user_id, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT user_id, event_id, previous_event_id, CASE WHEN p = event_type THEN 'TOUCH' ELSE 'INSERT' END AS action,
  coalesce(p <> event_type, FALSE) AND event_type = 'error' AS quarantined FROM i LEFT JOIN c USING (user_id)
"""


def _url_rows(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    role = F.when(c("url").contains("?"), "redirect").when(c("url").contains("#"), "alias").when(c("url").startswith("https://www."), "canonical_override").otherwise("source")
    bare = F.regexp_replace(F.regexp_replace(normalize_url(c("url")), r"\?.*$", ""), r"(\.html)?/?$", "")
    return t(s, d, "pages").select("page_id", bare.alias("url"), role.alias("role"))


_URLS_SQL = r"""
u AS (SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '(\.html)?/?$', '') AS k,
  CASE WHEN contains(url, '?') THEN 'redirect' WHEN contains(url, '#') THEN 'alias' WHEN starts_with(url, 'https://www.') THEN 'canonical_override' ELSE 'source' END AS role FROM pages)
"""


def url_roles(s: SparkSession, d: str) -> DataFrame:
    return U.latest_role(_url_rows(s, d), ["url"], {"source": 0, "redirect": 1, "alias": 2, "canonical_override": 3})


URL_ROLES = f"""
WITH {_URLS_SQL} SELECT k AS url, arg_min(role, CASE role WHEN 'source' THEN 0 WHEN 'redirect' THEN 1 WHEN 'alias' THEN 2 ELSE 3 END) AS role FROM u GROUP BY k
"""


def relation_rebuild(s: SparkSession, d: str) -> DataFrame:
    """Edges from each page to the first page of its URL, by equality of URLs; no page points at itself."""
    rows = _url_rows(s, d).select("page_id", "url")
    first = rows.groupBy("url").agg(F.min("page_id").alias("to_page"))
    return rows.join(first, "url").filter("page_id <> to_page").select(F.col("page_id").alias("from_page"), "to_page")


RELATIONS = f"WITH {_URLS_SQL} SELECT page_id AS from_page, first AS to_page FROM (SELECT page_id, min(page_id) OVER (PARTITION BY k) AS first FROM u) WHERE page_id <> first"


def anomaly_detection(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    days = t(s, d, "events").select("event_type", F.to_date("ts").alias("day"), "value", "user_id")
    runs = Q.profile(days, {"value": c("value") > 60, "user": c("user_id") % 3 == 0}, ["event_type", "day"])
    rows = Q.against_latest_healthy(runs, "event_type", "day", c("products") % 5 != 0, ["products", "value", "user"])
    codes = Q.anomalies("current", "previous", ["value", "user"], Q.AnomalyLimits(0.95, 0.02, 0.6))
    return rows.select("event_type", "day", "products", F.array_join(codes, ";").alias("codes"))


ANOMALIES = """
WITH r AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS products, avg((value > 60)::INT::DOUBLE) AS v, avg((user_id % 3 = 0)::INT::DOUBLE) AS u FROM events GROUP BY ALL),
p AS (SELECT *, last_value(CASE WHEN products % 5 <> 0 THEN {'products': products, 'v': v, 'u': u} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT event_type, day, products, concat_ws(';', CASE WHEN products / b.products < 0.95 THEN 'CRAWL_COUNT_COLLAPSE' END,
  CASE WHEN b.v - v >= 0.02 AND v <= 0.6 THEN 'FIELD_COVERAGE_COLLAPSE:value' END, CASE WHEN b.v >= 0.5 AND v = 0 THEN 'SCHEMA_SIGNAL:value' END,
  CASE WHEN b.u - u >= 0.02 AND u <= 0.6 THEN 'FIELD_COVERAGE_COLLAPSE:user' END, CASE WHEN b.u >= 0.5 AND u = 0 THEN 'SCHEMA_SIGNAL:user' END) AS codes FROM p
"""


def _evidence() -> Column:
    c = F.col("event_type")
    return F.when(c == "purchase", "SEEN").when(c == "error", "HTTP_404").when(c == "view", "NOT_IN_SITEMAP").otherwise("TIMEOUT")


def _observations(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select(F.col("user_id"), "ts", "event_id", _evidence().alias("evidence"), (F.col("value") > 120).alias("guarded"))


def missing_state(s: SparkSession, d: str) -> DataFrame:
    rows = Q.missing_states(_observations(s, d), "user_id", ["ts", "event_id"])
    return rows.select("event_id", "user_id", "evidence", "misses", "state")


MISSING = """
WITH o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'SEEN' WHEN 'error' THEN 'HTTP_404' WHEN 'view' THEN 'NOT_IN_SITEMAP' ELSE 'TIMEOUT' END AS evidence, value > 120 AS guarded FROM events),
g AS (SELECT *, count(*) FILTER (WHERE evidence = 'SEEN') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM o),
m AS (SELECT *, count(*) FILTER (WHERE evidence IN ('HTTP_404', 'NOT_IN_SITEMAP') AND NOT guarded) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS misses FROM g)
SELECT event_id, user_id, evidence, misses, CASE WHEN misses >= 3 THEN 'MISSING_CANDIDATE' WHEN misses >= 2 THEN 'WARNING' WHEN misses >= 1 THEN 'WATCH' ELSE 'ACTIVE' END AS state FROM m
"""


def missing_state_stream(s: SparkSession, d: str) -> DataFrame:
    """The same fold as a stream: one available-now run over the events, states in the state store."""
    import uuid

    from tallyforge.streaming.missing import stream_missing_states

    out = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    schema = t(s, d, "events").schema
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    whole = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if whole else "events.parquet")  # a stream reads folders
    events = reader.parquet(f"{d}/events.parquet" if whole else d)
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), _evidence().alias("evidence"), (F.col("value") > 120).alias("guarded"))
    query = stream_missing_states(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{out}/rows").select(F.col("seq").alias("event_id"), F.col("key").cast("bigint").alias("user_id"), "evidence", F.col("misses").cast("bigint").alias("misses"), "state")


def _rules(s: SparkSession) -> DataFrame:
    rows = [
        (1, None, "supplier", "", "BRAND_OVERRIDE", "House"), (2, 3, "supplier", "", "FORCE_REVIEW", ""), (3, None, "category", "PROMO", "DO_NOT_IMPORT", ""), (4, 5, "category", "SMALL", "CATEGORY_OVERRIDE", "Tiny"),
        (5, None, "product", "7", "BRAND_OVERRIDE", "Seven"), (6, None, "category", "LARGE", "DO_NOT_USE_SUPPLIER_FIELD", "price"), (7, 2, "product", "12", "IGNORE_PRODUCT", ""),
    ]
    return s.createDataFrame(rows, "rule_id bigint, supplier_id bigint, scope string, entity_key string, rule_type string, value string")


def business_rules(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    products = t(s, d, "part").select(c("p_partkey").alias("product_id"), (c("p_partkey") % 10).alias("supplier_id"), c("p_type").alias("category"))
    rows = Q.apply_rules(products, _rules(s))
    return rows.select("product_id", "excluded", "force_review", "brand_override", "category_override", F.array_join("forbidden_fields", ";").alias("forbidden_fields"), F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), ";").alias("rule_ids"))


RULES = """
WITH r(rule_id, supplier_id, scope, entity_key, rule_type, value) AS (VALUES (1, NULL, 'supplier', '', 'BRAND_OVERRIDE', 'House'), (2, 3, 'supplier', '', 'FORCE_REVIEW', ''), (3, NULL, 'category', 'PROMO', 'DO_NOT_IMPORT', ''),
  (4, 5, 'category', 'SMALL', 'CATEGORY_OVERRIDE', 'Tiny'), (5, NULL, 'product', '7', 'BRAND_OVERRIDE', 'Seven'), (6, NULL, 'category', 'LARGE', 'DO_NOT_USE_SUPPLIER_FIELD', 'price'), (7, 2, 'product', '12', 'IGNORE_PRODUCT', '')),
j AS (SELECT p_partkey AS product_id, r.* FROM part LEFT JOIN r ON (supplier_id IS NULL OR supplier_id = p_partkey % 10)
  AND (scope = 'supplier' OR (scope = 'category' AND entity_key = p_type) OR (scope = 'product' AND entity_key = CAST(p_partkey AS VARCHAR))))
SELECT product_id, coalesce(bool_or(rule_type IN ('IGNORE_PRODUCT', 'DO_NOT_IMPORT')), FALSE) AS excluded, coalesce(bool_or(rule_type = 'FORCE_REVIEW'), FALSE) AS force_review,
  arg_max(value, rule_id) FILTER (WHERE rule_type = 'BRAND_OVERRIDE') AS brand_override, arg_max(value, rule_id) FILTER (WHERE rule_type = 'CATEGORY_OVERRIDE') AS category_override,
  coalesce(string_agg(DISTINCT value, ';') FILTER (WHERE rule_type = 'DO_NOT_USE_SUPPLIER_FIELD'), '') AS forbidden_fields, array_to_string(list_sort(list(rule_id)), ';') AS rule_ids FROM j GROUP BY product_id
"""


def change_preview(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    offers = t(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    rows = t(s, d, "part").join(offers, c("p_partkey") == c("l_partkey"), "left").select(
        "p_partkey", F.struct(c("p_name").alias("name"), c("p_size").cast("string").alias("price"), c("p_brand").alias("brand")).alias("current"),
        F.struct(F.when(c("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(c("p_name")).alias("name"), c("n").cast("string").alias("price"), F.when(c("flag") == "R", c("p_brand")).alias("brand")).alias("proposed"),
        F.when(c("p_type") == "LARGE", F.array(F.lit("price"))).otherwise(F.array().cast("array<string>")).alias("forbidden"), (c("p_partkey") % 17 == 0).alias("anomaly"), (c("p_type") == "PROMO").alias("excluded"),
        (c("p_partkey") % 13 == 0).alias("identity_blocked"),
    )
    return Q.change_preview(rows, "p_partkey", ["name", "price", "brand"], {"name": "PROTECTED", "price": "SUPPLIER_ALLOWED"})


_PREVIEW_SQL = """
o AS (SELECT l_partkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1),
p AS (SELECT * FROM part LEFT JOIN o ON p_partkey = l_partkey),
f AS (SELECT p_partkey, p_type, 'name' AS field, p_name AS current, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS proposed, 'PROTECTED' AS policy FROM p
  UNION ALL SELECT p_partkey, p_type, 'price', CAST(p_size AS VARCHAR), CAST(n AS VARCHAR), 'SUPPLIER_ALLOWED' FROM p
  UNION ALL SELECT p_partkey, p_type, 'brand', p_brand, CASE WHEN flag = 'R' THEN p_brand END, 'REVIEW_REQUIRED' FROM p),
preview AS (SELECT p_partkey, field, current, proposed, policy, CASE WHEN p_type = 'LARGE' AND field = 'price' THEN 'EXCLUDED_BY_RULE' WHEN p_partkey % 17 = 0 THEN 'ANOMALY_GUARD_BLOCKED' WHEN p_type = 'PROMO' THEN 'EXCLUDED_BY_RULE'
  WHEN p_partkey % 13 = 0 THEN 'IDENTITY_BLOCKED' WHEN policy = 'SUPPLIER_ALLOWED' THEN 'PROPOSE_UPDATE' WHEN policy = 'REVIEW_REQUIRED' THEN 'NEEDS_REVIEW' ELSE 'NO_UPDATE' END AS decision
  FROM f WHERE current IS DISTINCT FROM proposed)
"""
PREVIEW = f"WITH {_PREVIEW_SQL} SELECT * FROM preview"
_DECISIONS = ("EXCLUDED_BY_RULE", "ANOMALY_GUARD_BLOCKED", "IDENTITY_BLOCKED", "PROPOSE_UPDATE", "NEEDS_REVIEW", "NO_UPDATE")


def preview_summary(s: SparkSession, d: str) -> DataFrame:
    counts = {x.lower(): F.col("decision") == x for x in _DECISIONS}
    return change_preview(s, d).groupBy("field").agg(F.count("*").alias("changes"), F.countDistinct("p_partkey").alias("products"), *R.conditional_counts(counts))


SUMMARY = f"WITH {_PREVIEW_SQL} SELECT field, count(*) AS changes, count(DISTINCT p_partkey) AS products, " + ", ".join(f"count(*) FILTER (WHERE decision = '{x}') AS {x.lower()}" for x in _DECISIONS) + " FROM preview GROUP BY field"


def page_extract(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "pages").select("page_id", normalize_url(F.col("url")).alias("url"), parse_page(F.col("html")).alias("p"))
    return rows.select("page_id", "url", "p.title", "p.heading", F.size("p.links").cast("bigint").alias("links"), "p.signals", "p.page_type")


QUERIES = {
    "change_detection": (change_detection, CHANGES), "merge_upsert": (merge_upsert, MERGE), "history_events": (history_events, HISTORY), "decision_persistence": (decision_persistence, DECISIONS),
    "url_roles": (url_roles, URL_ROLES), "relation_rebuild": (relation_rebuild, RELATIONS), "anomaly_detection": (anomaly_detection, ANOMALIES), "missing_state": (missing_state, MISSING),
    "missing_state_stream": (missing_state_stream, MISSING), "business_rules": (business_rules, RULES), "change_preview": (change_preview, PREVIEW), "preview_summary": (preview_summary, SUMMARY),
    "page_extract": (page_extract, None),
}
