"""The registry as stored tables: rows of a snapshot, its suppliers' articles, upserts, and the join for publication.

A snapshot row has: id, name, article_raw, supplier_article_raw, normalized_supplier_article, brand_raw,
manufacturer_raw, model_raw, category_id, category_name, category_path, category_ids (array), properties (array of
structs with property_id, property_code and value, a JSON text, among others), product_url, active (text),
raw_data (JSON), snapshot_hash and captured_at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import normalize_brand, normalize_model, normalized_name

#: Texts that say active.
ACTIVE = ("Y", "TRUE", "1")


def _filled(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def registry_rows(snapshot: DataFrame) -> DataFrame:
    """The 23 stored columns of each snapshot row; texts that are empty are null."""
    c = F.col
    return snapshot.select(
        c("id").cast("string").alias("id"), "name", normalized_name(c("name")).alias("normalized_name"), _filled(c("article_raw")).alias("article_raw"), _filled(c("supplier_article_raw")).alias("supplier_article_raw"),
        _filled(c("normalized_supplier_article")).alias("normalized_supplier_article"), _filled(c("brand_raw")).alias("brand_raw"), _filled(normalize_brand(c("brand_raw"))).alias("normalized_brand"),
        _filled(c("manufacturer_raw")).alias("manufacturer_raw"), _filled(c("model_raw")).alias("model_raw"), _filled(normalize_model(c("model_raw"), c("brand_raw"))["model"]).alias("normalized_model"),
        _filled(c("category_id")).alias("category_id"), _filled(c("category_name")).alias("category_name"), _filled(c("category_path")).alias("category_path"),
        F.to_json(F.struct(F.coalesce("category_ids", F.array()).alias("category_ids"))).alias("category_metadata"), F.to_json(F.struct(F.coalesce("properties", F.array()).alias("items"))).alias("properties"),
        _filled(F.trim("product_url")).alias("product_url"), F.coalesce(F.upper("active").isin(*ACTIVE), F.lit(False)).alias("active"), F.coalesce("raw_data", F.lit("{}")).alias("raw_data"), "snapshot_hash",
        c("captured_at").alias("first_seen_at"), c("captured_at").alias("last_seen_at"), c("captured_at").alias("last_synced_at"),
    )


def upsert_registry(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next registry: incoming rows win but keep when they were first seen; others stay."""
    seen = current.select("id", F.col("first_seen_at").alias("_first"))
    rows = incoming.join(seen, "id", "left").withColumn("first_seen_at", F.coalesce("_first", "first_seen_at")).drop("_first")
    return current.join(incoming.select("id"), "id", "left_anti").unionByName(rows.select(*current.columns))


def _inner(value: Column) -> Column:
    """Of an object its enum or else its value; other texts as they are."""
    return F.when(value.startswith("{"), F.coalesce(F.nullif(F.get_json_object(value, "$.valueEnum"), F.lit("")), F.get_json_object(value, "$.value"))).otherwise(value)


def registry_identifiers(snapshot: DataFrame, suppliers: Mapping[str, str]) -> DataFrame:
    """(id, supplier_code, property_id, property_code, raw_value, normalized_value) of the properties that hold suppliers' articles.

    suppliers: supplier code by property code. Values are texts, lists, or objects, at most two deep.
    """
    codes = F.create_map(*[F.lit(x) for pair in sorted(suppliers.items()) for x in pair]) if suppliers else F.create_map().cast("map<string,string>")
    rows = snapshot.select(F.col("id").cast("string").alias("id"), F.explode("properties").alias("p")).withColumn("supplier_code", F.try_element_at(codes, F.col("p.property_code"))).filter("supplier_code is not null")
    value = F.col("p.value")
    values = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    rows = rows.withColumn("v", F.explode(values)).withColumn("raw_value", F.trim(F.coalesce(_inner(_inner(F.col("v"))), F.lit(""))))
    rows = rows.withColumn("normalized_value", normalize_model(F.col("raw_value"), F.lit(""))["model"]).filter("normalized_value <> ''")
    return rows.select("id", "supplier_code", F.col("p.property_id").alias("property_id"), F.col("p.property_code").alias("property_code"), "raw_value", "normalized_value").distinct()


def catalog_identifiers(registry: DataFrame, known: DataFrame) -> DataFrame:
    """known, and the identifiers that linked registry products give their catalog products, where they are new.

    known: catalog_id, identifier_type, normalized_value and others; registry: id, catalog_id. A registry product
    without a catalog product means that the bootstrap isn't complete, and raises.
    """
    if lacking := registry.filter("catalog_id is null").limit(3).collect():
        raise ValueError("registry products without a catalog product: " + ", ".join(str(r.id) for r in lacking))
    own = F.col("id").cast("string")
    made = registry.select(
        "catalog_id", F.lit("registry_id").alias("identifier_type"), own.alias("normalized_value"), own.alias("raw_value"), F.lit("registry").alias("source_kind"), own.alias("source_record_id"), F.lit("supporting").alias("reliability"),
    )
    return known.unionByName(made.join(known, ["catalog_id", "identifier_type", "normalized_value"], "left_anti").select(*known.columns))


def publication_rows(selections: DataFrame, offers: DataFrame, sources: DataFrame, suppliers: DataFrame, targets: DataFrame, matches: DataFrame) -> DataFrame:
    """Every selected product with its offer, the offer's source and supplier, its target products and its source's current match.

    A chain of five left joins: what is missing is null, and a product with several targets or a source with several
    current matches gives several rows, which the feed's rules over all rows find. Only current matches count, so they
    are a condition of the join. Columns: selections catalog_id, status, offer_id, rule_version; offers offer_id, source_id,
    supplier_id, sku, price, old_price, currency, availability, quantity, active; sources source_id, supplier_id,
    catalog_id, external_id, sku, active; suppliers supplier_id, code, enabled; targets catalog_id, target_id, name, url,
    category_id, category_name, brand, article, active; matches source_id, catalog_id, status, is_current.
    """
    c, o, p, s, r, m = (df.alias(name) for df, name in zip((selections, offers, sources, suppliers, targets, matches), "copsrm", strict=True))
    f = F.col
    rows = (
        c.filter("c.status = 'selected'").join(o, f("o.offer_id") == f("c.offer_id"), "left").join(p, f("p.source_id") == f("o.source_id"), "left").join(s, f("s.supplier_id") == f("o.supplier_id"), "left")
        .join(r, f("r.catalog_id") == f("c.catalog_id"), "left").join(m, (f("m.source_id") == f("p.source_id")) & f("m.is_current"), "left")
    )
    return rows.select(
        f("c.catalog_id").alias("catalog_product_id"), f("c.status").alias("selection_status"), f("c.offer_id").alias("selected_offer_id"), f("o.offer_id").alias("offer_id"), f("p.source_id").alias("source_product_id"),
        f("p.catalog_id").alias("source_catalog_product_id"), f("o.supplier_id").alias("offer_supplier_id"), f("p.supplier_id").alias("source_supplier_id"), f("s.code").alias("supplier_code"), f("s.enabled").alias("supplier_enabled"),
        f("p.external_id").alias("supplier_external_id"), _filled(F.trim(F.coalesce("o.sku", "p.sku"))).alias("supplier_sku"), f("o.price").alias("price"), f("o.old_price").alias("old_price"), f("o.currency").alias("currency"),
        f("o.availability").alias("availability"), f("o.quantity").alias("quantity"), f("o.active").alias("offer_active"), f("p.active").alias("source_active"), f("r.target_id").alias("target_id"), f("r.name").alias("target_name"),
        f("r.url").alias("target_url"), f("r.category_id").alias("category_id"), f("r.category_name").alias("category_name"), f("r.brand").alias("target_brand"), f("r.active").alias("target_active"),
        _filled(F.trim("r.article")).alias("target_article"), f("m.status").alias("match_status"), f("m.catalog_id").alias("match_catalog_product_id"), f("c.rule_version").alias("rule_version"),
    )
