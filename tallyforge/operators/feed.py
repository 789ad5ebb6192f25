"""Feed rows, coded violations, manifest, XML documents, and the dry-run update plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import plain_decimal

#: Match states that may be published, and the codes of row violations by column rule.
ACCEPTED = ("EXACT_MATCH", "HIGH_CONFIDENCE_MATCH")


def valid_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#]+"), F.lit(False))


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def row_violations(rows: DataFrame, currencies: Iterable[str] = ("RUB",), availability: Iterable[str] = ("in_stock", "incoming", "preorder", "backorder", "unknown", "out_of_stock")) -> Column:
    """Array of the codes that a feed row breaks, in fixed order."""
    c = F.col

    def same(a: str, b: str) -> Column:
        return c(a).isNotNull() & c(b).isNotNull() & (c(a) == c(b))

    checks: list[tuple[str, Column]] = [
        ("NOT_SELECTED", ~c("selection_status").eqNullSafe("selected")),
        ("MISSING_SELECTED_OFFER", c("selected_offer_id").isNull()),
        ("SELECTED_OFFER_MISMATCH", c("offer_id").isNull() | ~c("offer_id").eqNullSafe(c("selected_offer_id"))),
        ("MISSING_SOURCE_PRODUCT", c("source_product_id").isNull()),
        ("SOURCE_CATALOG_PRODUCT_MISMATCH", ~c("source_catalog_product_id").eqNullSafe(c("catalog_product_id"))),
        ("SUPPLIER_RELATIONSHIP_MISMATCH", ~same("offer_supplier_id", "source_supplier_id")),
        ("NO_CURRENT_ACCEPTED_MATCH", ~F.coalesce(c("match_status").isin(*ACCEPTED), F.lit(False))),
        ("MATCH_CATALOG_PRODUCT_MISMATCH", ~c("match_catalog_product_id").eqNullSafe(c("catalog_product_id"))),
        ("DISABLED_OR_MISSING_SUPPLIER", ~c("supplier_enabled").eqNullSafe(True)),
        ("INACTIVE_OR_MISSING_SOURCE_PRODUCT", ~c("source_active").eqNullSafe(True)),
        ("INACTIVE_OR_MISSING_SELECTED_OFFER", ~c("offer_active").eqNullSafe(True)),
        ("INACTIVE_OR_MISSING_TARGET_PRODUCT", ~c("target_active").eqNullSafe(True)),
        ("MISSING_TARGET_ID", _blank("target_id")), ("MISSING_TARGET_NAME", _blank("target_name")), ("INVALID_TARGET_URL", ~valid_url(c("target_url"))),
        ("MISSING_TARGET_CATEGORY_ID", _blank("category_id")), ("MISSING_TARGET_CATEGORY_NAME", _blank("category_name")),
        ("NULL_SELECTED_PRICE", c("price").isNull()), ("NON_POSITIVE_SELECTED_PRICE", F.coalesce(c("price") <= 0, F.lit(False))),
        ("UNSUPPORTED_CURRENCY", ~F.coalesce(c("currency").isin(*currencies), F.lit(False))),
        ("UNMAPPED_AVAILABILITY", ~F.coalesce(c("availability").isin(*availability), F.lit(False))),
        ("DISCONTINUED_SELECTED_OFFER", c("availability").eqNullSafe("discontinued")), ("MISSING_SELECTION_POLICY_VERSION", _blank("rule_version")),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in checks]))


def set_violations(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """(code, detail) of rules over all rows: count, repeated keys, mixed policy versions."""
    parts = [
        rows.groupBy("catalog_product_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_CATALOG_PRODUCT").alias("code"), F.concat_ws(":", "catalog_product_id", "n").alias("detail")),
        rows.filter(~_blank("target_id")).groupBy("target_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_FEED_OFFER_ID"), F.concat_ws(":", "target_id", "n")),
        rows.agg(F.array_sort(F.collect_set(F.nullif(F.col("rule_version"), F.lit("")))).alias("v")).filter("size(v) > 1").select(F.lit("MIXED_SELECTION_POLICY_VERSIONS"), F.array_join("v", ",")),
    ]
    if expected is not None:
        parts.append(rows.agg(F.count("*").alias("n")).filter(F.col("n") != expected).select(F.lit("SELECTED_JOIN_CARDINALITY"), F.concat(F.col("n").cast("string"), F.lit(f"!={expected}"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def exclusion_counts(violated: DataFrame) -> DataFrame:
    """Violation codes and how many products break each."""
    return violated.select("catalog_product_id", F.explode("violations").alias("code")).groupBy("code").agg(F.countDistinct("catalog_product_id").alias("products"))


def feed_values(rows: DataFrame, available: Iterable[str] = ("in_stock",), with_quantity: bool = True) -> DataFrame:
    """What an offer element must hold, from a valid row."""
    sku, external, article = (F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("supplier_sku", "supplier_external_id", "target_article"))
    own = F.when(article.isNotNull() & ~article.eqNullSafe(sku) & ~F.lower(article).rlike("^(artikul|артикул)_"), article)
    return rows.select(
        F.col("target_id").cast("string").alias("id"), F.when(F.col("availability").isin(*available), "true").otherwise("false").alias("available"), F.col("target_url").alias("url"),
        plain_decimal(F.col("price")).alias("price"), F.col("currency").alias("currency_id"), F.col("category_id").cast("string").alias("category_id"), F.col("category_name"),
        F.col("target_name").alias("name"), F.nullif(F.col("target_brand"), F.lit("")).alias("vendor"), F.when(~sku.eqNullSafe(external), sku).alias("vendor_code"), own.alias("article"),
        F.when(F.col("old_price") > F.col("price"), plain_decimal(F.col("old_price"))).alias("old_price"), (plain_decimal(F.col("quantity")) if with_quantity else F.lit(None).cast("string")).alias("quantity"),
    )


def categories(rows: DataFrame) -> DataFrame:
    """The category dictionary, with the number of names an id has (more than one is a conflict)."""
    return rows.groupBy("category_id").agg(F.min("category_name").alias("category_name"), F.countDistinct("category_name").alias("names"))


def manifest(rows: DataFrame, statuses: DataFrame, times: list[str]) -> DataFrame:
    """One row: products by state, categories, the latest time of any of `times` in any row."""
    latest = F.max(F.greatest(*times)) if len(times) > 1 else F.max(times[0])
    one = rows.agg(F.count("*").alias("offers"), F.countDistinct("category_id").alias("categories"), F.sum("price").alias("price_sum"), latest.alias("snapshot_at"))
    by_state = statuses.groupBy().pivot("status", ["selected", "review", "no_eligible_offer"]).count()
    return one.crossJoin(by_state.na.fill(0))


def document(values: DataFrame, shop: Mapping[str, str], snapshot_at: str) -> Iterable[str]:
    """The feed as XML text, piece by piece, offers in numeric id order; reads rows as a stream."""
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<yml_catalog date={quoteattr(snapshot_at)}>\n<shop>\n'
    yield "".join(f"<{k}>{escape(v)}</{k}>\n" for k, v in shop.items())
    number = F.expr("try_cast(category_id AS DECIMAL(38,0))")
    yield "<categories>\n"
    for row in values.select("category_id", "category_name").distinct().orderBy(number.asc_nulls_last(), "category_id").toLocalIterator():
        yield f"<category id={quoteattr(row.category_id)}>{escape(row.category_name)}</category>\n"
    yield "</categories>\n<offers>\n"
    ordered = values.orderBy(F.expr("try_cast(id AS DECIMAL(38,0))").asc_nulls_last(), "id")
    names = {"url": "url", "price": "price", "old_price": "oldprice", "currency_id": "currencyId", "category_id": "categoryId", "name": "name", "vendor": "vendor", "vendor_code": "vendorCode"}
    for row in ordered.toLocalIterator():
        body = "".join(f"<{tag}>{escape(row[c])}</{tag}>" for c, tag in names.items() if row[c] is not None)
        body += "".join(f"<param name={quoteattr(c)}>{escape(row[c])}</param>" for c in ("article", "quantity") if row[c] is not None)
        yield f"<offer id={quoteattr(row.id)} available={quoteattr(row.available)}>{body}</offer>\n"
    yield "</offers>\n</shop>\n</yml_catalog>\n"


def validate_document(document_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids that differ between a parsed document and the expected values: MISSING, EXTRA or DIFFERENT."""
    columns = [c for c in expected.columns if c != "id"]
    a = expected.select("id", F.struct(*columns).alias("e"))
    b = document_rows.select("id", F.struct(*columns).alias("d"))
    state = F.when(F.col("d").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").when(~F.col("e").eqNullSafe(F.col("d")), "DIFFERENT")
    return a.join(b, "id", "fullouter").withColumn("problem", state).filter("problem is not null").select("id", "problem")


def document_problems(offers: DataFrame, categories: DataFrame, available: Iterable[str] = ("true", "false")) -> DataFrame:
    """(id, problem) of a parsed document's offers: position, id, category_id, price, url, available, all but position as text.

    Ids must be unique and rise by number, then text, from one offer to the next; categories must be
    declared, prices be positive decimals of at most four places, URLs be valid and availability known. The
    order is checked by a join of neighbours, so no task reads the whole document.
    """
    known = categories.select("category_id", F.lit(True).alias("_declared")).distinct()
    repeated = offers.groupBy("id").agg(F.count("*").alias("_n"), F.min("position").alias("position"))
    rows = offers.join(known, "category_id", "left").join(repeated.drop("position"), "id")
    order = lambda c: F.struct(F.expr(f"try_cast({c} AS DECIMAL(38,0))").isNull(), F.expr(f"try_cast({c} AS DECIMAL(38,0))"), F.col(c))
    before = offers.select((F.col("position") + 1).alias("position"), order("id").alias("_before"))
    rows = rows.join(before, "position", "left").withColumn("_own", order("id"))
    tests = {
        "DUPLICATE_ID": F.col("_n") > 1, "OUT_OF_ORDER": F.coalesce(F.col("_before") > F.col("_own"), F.lit(False)), "UNDECLARED_CATEGORY": F.col("_declared").isNull(),
        "INVALID_PRICE": ~F.coalesce(F.col("price").rlike(r"^\d+(\.\d{1,4})?$") & (F.col("price").try_cast("decimal(18,4)") > 0), F.lit(False)), "INVALID_URL": ~valid_url(F.col("url")), "UNKNOWN_AVAILABILITY": ~F.coalesce(F.col("available").isin(*available), F.lit(False)),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))).alias("problem"))


def plan_updates(states: DataFrame, blockers: tuple[str, ...] = ()) -> DataFrame:
    """Dry-run plan per target: deltas and the action, from desired and current price and availability.

    Columns: id, price, availability, current_price, current_availability, targets (how many current
    rows match), error. blockers: what still forbids writing at all.
    """
    c = F.col
    delta = c("price") - c("current_price")
    price = F.when(c("current_price").isNull(), "UNKNOWN_CURRENT").when(delta == 0, "UNCHANGED").when(delta > 0, "INCREASE").otherwise("DECREASE")
    stock = F.when(c("current_availability").isNull(), "UNKNOWN_CURRENT").when(c("current_availability") == c("availability"), "UNCHANGED").otherwise("CHANGE")
    rows = states.withColumns({"price_change": price, "availability_change": stock, "price_delta": delta, "price_delta_percent": F.round(F.try_divide(delta * 100, c("current_price")), 4)})
    moved, restocked = c("price_change") != "UNCHANGED", c("availability_change") != "UNCHANGED"
    broken = (c("targets") != 1) | (F.coalesce(c("error"), F.lit("")) != "")
    action = (
        F.when(broken, "BLOCKED_IDENTITY").when(F.lit(bool(blockers)), "BLOCKED_IMPORT_CONTRACT").when(c("current_availability").isNull(), "BLOCKED_UNSUPPORTED_STATE")
        .when(moved & restocked, "WOULD_UPDATE_PRICE_AND_AVAILABILITY").when(moved, "WOULD_UPDATE_PRICE").when(restocked, "WOULD_UPDATE_AVAILABILITY").otherwise("NO_CHANGE")
    )
    why = (
        F.when(c("targets") == 0, "MISSING_TARGET").when(c("targets") > 1, "AMBIGUOUS_TARGET").when(broken, c("error"))
        .when(F.lit(bool(blockers)), F.lit("|".join(blockers))).when(c("current_availability").isNull(), "CURRENT_AVAILABILITY_NOT_MAPPABLE").otherwise("")
    )
    return rows.withColumns({"action": action, "blocking_reason": why})


def guard_leaks(rows: DataFrame, forbidden: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a table of known false matches forbids; must be empty before anything is published."""
    return rows.join(forbidden.select(*keys).distinct(), keys, "left_semi")
