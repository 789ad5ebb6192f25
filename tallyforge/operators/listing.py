"""Product listings: filters, wide and detail exports, counters, change periods, runs.

Product rows: product_id, supplier, external_id, sku, name, brand, description, active, decision,
product_kind, own_model, reference_model, best_candidate; listing() adds the first active offer, the
category path, the confirmed link and the counts of child tables by one join each.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.relational import blank_to_null, conditional_counts, contains_text, latest_by
from tallyforge.sources.writers import without_secrets

#: Decisions on a product.
DECISIONS = ("EXACT_EXISTING", "HIGH_CONFIDENCE_EXISTING", "REVIEW_EXISTING", "SAFE_NEW_PRODUCT_CANDIDATE", "ACCESSORY_OR_COMPATIBILITY_ITEM", "CONFLICT", "INSUFFICIENT_IDENTITY")
#: The kinds of detail exports.
DETAILS = ("properties", "images", "documents", "relations", "options", "provenance", "matches", "decisions")


#: The quality issues of a product.
ISSUES = (
    "without_price", "zero_price", "without_currency", "without_sku", "without_brand", "without_model", "without_description", "without_properties", "without_images", "without_category", "without_availability",
)


def content_complete() -> Column:
    """Description and brand are filled."""
    return (F.coalesce("description", F.lit("")) != "") & (F.coalesce("brand", F.lit("")) != "")


def media_complete() -> Column:
    return F.coalesce("images", F.lit(0)) > 0


def issues() -> dict[str, Column]:
    """The quality issues of a product row, by name; filters and dashboards use the same ones."""
    c = F.col
    return {
        "without_price": c("price").isNull(), "zero_price": F.coalesce(c("price") == 0, F.lit(False)), "without_currency": c("currency").isNull(),
        "without_sku": blank_to_null(c("sku")).isNull(), "without_brand": blank_to_null(c("brand")).isNull(), "without_model": blank_to_null(c("own_model")).isNull(),
        "without_description": blank_to_null(c("description")).isNull(), "without_properties": F.coalesce("properties", F.lit(0)) == 0, "without_images": ~media_complete(),
        "without_category": F.coalesce("category", F.lit("")) == "", "without_availability": F.coalesce("availability", F.lit("unknown")) == "unknown",
    }


@dataclass(frozen=True)
class ProductFilters:
    """What a listing shows; None or empty filters nothing."""

    supplier: str = ""
    brand: str = ""
    decision: str = ""
    kind: str = ""
    availability: str = ""
    category: str = ""
    content: str = ""
    media: str = ""
    search: str = ""
    issue: str = ""
    page: int = 1
    page_size: int = 50

    def __post_init__(self) -> None:
        if self.page < 1 or self.page_size not in (25, 50, 100):
            raise ValueError("invalid pagination")
        if self.decision and self.decision not in DECISIONS:
            raise ValueError("invalid decision")
        if self.issue and self.issue not in ISSUES:
            raise ValueError("invalid quality issue")

    def condition(self) -> Column:
        """All filters together, on listing() rows; only active products pass."""
        equal = {"supplier": self.supplier, "brand": self.brand, "decision": self.decision, "product_kind": self.kind, "availability": self.availability}
        found = F.col("active")
        for column, value in equal.items():
            if value:
                found = found & (F.col(column) == value)
        for text, columns in ((self.category, ["category"]), (self.search, ["external_id", "sku", "name", "own_model", "reference_model", "best_candidate"])):
            if text:
                found = found & contains_text(columns, text)
        for wanted, complete in ((self.content, content_complete()), (self.media, media_complete())):
            if wanted in ("complete", "missing"):
                found = found & (complete if wanted == "complete" else ~complete)
        return found & issues()[self.issue] if self.issue else found


def listing(products: DataFrame, offers: DataFrame, children: Mapping[str, DataFrame], categories: DataFrame, accepted: DataFrame, manual: DataFrame) -> DataFrame:
    """Products with their first active offer, category path, confirmed link and counts.

    offers: product_id, offer_id, active and commercial columns; children: product_id by name of the
    count; categories: product_id, path; accepted (product_id, target, linked_at, event_id) are accepted current
    matches and manual those of resolved reviews; the latest of each counts, a manual one first.
    """
    first = latest_by(offers.filter("active").drop("active"), ["product_id"], ["offer_id"], earliest=True).drop("offer_id")
    rows = products.join(first, "product_id", "left").join(categories.select("product_id", F.col("path").alias("category")), "product_id", "left")
    for name, links in (("_auto", accepted), ("_manual", manual)):
        latest = latest_by(links.select("product_id", "target", "linked_at", "event_id"), ["product_id"], ["linked_at", "event_id"])
        rows = rows.join(latest.select("product_id", F.col("target").alias(name)), "product_id", "left")
    for name, child in children.items():
        rows = rows.join(child.groupBy("product_id").agg(F.count("*").alias(name)), "product_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    source = F.when(F.col("_manual").isNotNull(), "MANUAL_CONFIRMED").when(F.col("_auto").isNotNull(), "AUTO_ACCEPTED")
    return rows.withColumns({"category": F.coalesce("category", F.lit("")), "confirmed_link": F.coalesce("_manual", "_auto"), "confirmed_source": source}).drop("_auto", "_manual")


def details(rows: DataFrame, child: DataFrame, kind: str, order: tuple[str, ...] = ("position",)) -> DataFrame:
    """The child rows of the listed products, in order, with what names the product: one join, no chunks."""
    if kind not in DETAILS:
        raise ValueError("unknown export detail kind")
    return rows.select("supplier", "external_id", "product_id").join(child, "product_id").orderBy("product_id", *order)


def export_totals(rows: DataFrame) -> DataFrame:
    """One row: products, sums of their child counts, and how many have a best candidate."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("properties", "images", "documents", "relations", "options")]
    known = F.coalesce("best_candidate", F.lit("")) != ""
    return rows.agg(F.count("*").alias("products"), *sums, F.count_if(known).alias("matched"), F.count_if(~known).alias("unmatched"))


def export_counters(selection: DataFrame, offers: DataFrame, products: DataFrame, decisions: DataFrame, targets: DataFrame, supplier: str | None = None) -> DataFrame:
    """One row of the export page's nine counters, of all suppliers or of one.

    selection: catalog_id, status, offer_id; offers: offer_id, supplier, price; products: product_id,
    supplier, catalog_id; decisions: product_id, decision; targets: catalog_id, category_id,
    category_name. Of one supplier, a selected row counts by its offer's supplier and any other by a
    product of the supplier in the catalog product. Products, targets and decisions are as many as the catalog has,
    though their files are small: their joins are merged, not broadcast by the size of a file's columns.
    """
    chosen = selection.join(offers.select("offer_id", F.col("supplier").alias("_by"), "price"), "offer_id", "left")
    known = targets.select("catalog_id", ((F.coalesce("category_id", F.lit("")) == "") | (F.coalesce("category_name", F.lit("")) == "")).alias("_blank"))
    rows = chosen.join(known.hint("merge"), "catalog_id", "left")
    own = products.select("product_id", "supplier").join(decisions.hint("merge"), "product_id")
    selected = F.col("status") == "selected"
    if supplier is not None:
        theirs = products.filter(F.col("supplier") == supplier).select("catalog_id", F.lit(True).alias("_theirs")).distinct()
        rows = rows.join(theirs.hint("merge"), "catalog_id", "left").filter((selected & (F.col("_by") == supplier)) | (~selected & F.col("_theirs")))
        own = own.filter(F.col("supplier") == supplier)
    offered = selected & F.col("_by").isNotNull()
    one = rows.agg(F.count("*").alias("considered"), *conditional_counts({
        "selected": selected, "no_selected_offer": F.col("status") == "no_eligible_offer",
        "without_price": offered & (F.col("price").isNull() | (F.col("price") <= 0)), "without_category": offered & F.coalesce("_blank", F.lit(True)),
    }))
    d = F.col("decision")
    two = own.agg(*conditional_counts({
        "blocked_by_conflict": d == "CONFLICT", "needs_review": d.isin("REVIEW_EXISTING", "INSUFFICIENT_IDENTITY"),
        "safe_new": d == "SAFE_NEW_PRODUCT_CANDIDATE", "accessories": d == "ACCESSORY_OR_COMPATIBILITY_ITEM",
    }))
    return one.crossJoin(two)  # one row each


def filter_options(products: DataFrame) -> DataFrame:
    """(field, value): the distinct filled values that the filters offer, in order."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("supplier", "supplier"), ("brand", "brand"), ("kind", "product_kind"))]))
    rows = products.select(values.alias("x")).select("x.*")
    return rows.filter(blank_to_null(F.col("value")).isNotNull()).distinct().orderBy("field", "value")


def changes_in(history: DataFrame, period: str, as_of: Column | None = None, runs: tuple[int, int] | None = None) -> DataFrame:
    """History rows of the last run, of the 24 hours or 7 days up to as_of, or between two runs in either order."""
    if period == "last_run":
        return history.join(F.broadcast(history.agg(F.max("run_id").alias("run_id"))), "run_id")
    if period in ("24h", "7d") and as_of is not None:
        return history.filter(F.col("changed_at") >= as_of - F.expr("INTERVAL 24 HOURS" if period == "24h" else "INTERVAL 7 DAYS"))
    if period == "between" and runs is not None:
        return history.filter(F.col("run_id").between(min(runs), max(runs)))
    raise ValueError("invalid change export period")


def product_history(history: DataFrame, products: DataFrame, supplier: str, external_id: str) -> DataFrame:
    """The changes of one product, the latest first."""
    one = products.filter((F.col("supplier") == supplier) & (F.col("external_id") == external_id)).select("product_id", "supplier")
    return history.join(F.broadcast(one), "product_id").orderBy(F.desc("changed_at"), F.desc("event_id"))  # one product


def section_rows(entity: str, sections: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of a section's export without columns that speak of secrets; unknown sections raise."""
    if entity not in sections:
        raise ValueError(f"unknown export section {entity}")
    return without_secrets(sections[entity])


def quality_dashboard(suppliers: DataFrame, rows: DataFrame, errors: DataFrame, runs: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Per supplier: products, active ones, all quality issues, decisions, recent errors, and the latest run and snapshot.

    rows: listing() rows; errors: supplier, created_at; runs: supplier, status, finished_at; snapshots:
    supplier, snapshot_id, created_at, critical, codes. Each table is reduced to the supplier before it is joined.
    """
    d = F.col("decision")
    counts = {
        "active_products": F.col("active"), **issues(), "review": d.isin("REVIEW_EXISTING", "INSUFFICIENT_IDENTITY"), "conflicts": d == "CONFLICT", "safe_new": d == "SAFE_NEW_PRODUCT_CANDIDATE",
    }
    per = rows.groupBy("supplier").agg(F.count("*").alias("total"), *conditional_counts(counts))
    recent = errors.filter(F.col("created_at") > as_of - F.expr("INTERVAL 30 DAYS")).groupBy("supplier").agg(F.count("*").alias("parser_errors"))
    crawled = runs.filter("status = 'succeeded'").groupBy("supplier").agg(F.max("finished_at").alias("last_successful_crawl"))
    latest = latest_by(snapshots, ["supplier"], ["created_at", "snapshot_id"]).select("supplier", "critical", "codes")
    joined = suppliers.select("supplier").join(per, "supplier", "left").join(recent, "supplier", "left").join(crawled, "supplier", "left").join(latest, "supplier", "left")
    return joined.na.fill(0, [c for c in per.columns if c != "supplier"] + ["parser_errors"])


def quality_history(snapshots: DataFrame, runs: DataFrame, supplier: str | None = None, limit: int = 10) -> DataFrame:
    """The latest snapshots of finished runs, or of no run, newest first."""
    rows = snapshots.join(runs.select("run_id", "status"), "run_id", "left").filter("status is null or status in ('succeeded', 'partial')")
    if supplier is not None:
        rows = rows.filter(F.col("supplier") == supplier)
    return rows.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(limit)


def run_listing(runs: DataFrame, jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest runs with what triggered them and how many seconds they took, to the whole second."""
    seconds = F.round((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6).cast("bigint")
    rows = runs.join(jobs.select("run_id", "trigger_type"), "run_id", "left").withColumn("seconds", seconds)
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def run_progress(runs: DataFrame) -> DataFrame:
    """Percent, rate and seconds to go of runs (processed, total, fetched, fetch_seconds, phase)."""
    c = F.col
    rate = F.when((c("fetched") > 0) & (c("fetch_seconds") > 0), c("fetched") / c("fetch_seconds"))
    percent = F.when(c("total") == 0, 100.0).otherwise(F.least(F.lit(100.0), c("processed") * 100.0 / c("total")))
    left = (c("phase") == "FETCHING_PRODUCTS") & (c("processed") < c("total"))
    return runs.withColumns({"percent": F.round(percent, 2), "rate_per_second": F.round(rate, 3), "eta_seconds": F.when(left, F.round((c("total") - c("processed")) / rate)).cast("bigint")})


def fill_rates_text(rates: Column, labels: Mapping[str, str]) -> Column:
    """A map of fill rates as text, in the order of the labels; a dash if there are none."""
    found = F.array_compact(F.array(*[F.when(F.try_element_at(rates, F.lit(k)).isNotNull(), F.concat(F.lit(f"{label} "), F.bround(F.try_element_at(rates, F.lit(k)) * 100).cast("int"), F.lit("%"))) for k, label in labels.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("—")


def export_filename(kind: Column, supplier: Column, day: Column, extension: str) -> Column:
    """A name of letters, digits, dashes and underscores, with the supplier, if any, and the day."""
    clean = lambda x: F.substring(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9_-]", "_"), 1, 50)
    return F.concat(F.coalesce(F.nullif(clean(kind), F.lit("")), F.lit("export")), F.when(clean(supplier) != "", F.concat(F.lit("_"), clean(supplier))).otherwise(""), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(f".{extension}"))
