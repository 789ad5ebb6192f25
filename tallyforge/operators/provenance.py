"""Where values come from and what runs leave behind: observations, prices, missing products, run results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.merge import append_event, merge_json
from tallyforge.operators.quality import CONFIRMED_MISSING, state_of
from tallyforge.operators.relational import latest_by

#: The kinds of prices and sources that are known.
PRICE_TYPES = ("RRP", "retail", "wholesale", "dealer", "promo", "unknown")
SOURCE_KINDS = ("supplier_html", "supplier_json", "supplier_xml", "supplier_api")
#: Errors that say nothing of whether a product is gone.
UNCERTAIN = ("TIMEOUT", "HTTP_403", "HTTP_429", "NETWORK_ERROR", "PARSER_ERROR")


def price_provenance(card: Mapping[str, Column], raw: Column) -> Column:
    """A struct of price type, raw price and source: the card's own, else its raw record's, else a default.

    card: price, price_type, price_raw, price_source; raw: the record's JSON, whose commercial part lies
    under source_record.
    """
    def chain(name: str, *more: Column) -> Column:
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in (card[name], F.get_json_object(raw, f"$.{name}"), F.get_json_object(raw, f"$.source_record.commercial.{name}"), *more)])

    kind = F.coalesce(chain("price_type"), F.lit("unknown"))
    known = card["price"].isNotNull()
    return F.struct(
        F.when(kind.isin(*PRICE_TYPES), kind).otherwise("unknown").alias("price_type"),
        chain("price_raw", F.get_json_object(raw, "$.source_record.commercial.price"), card["price"].cast("string")).alias("price_raw"),
        F.coalesce(chain("price_source"), F.when(known, F.lit("adapter card price"))).alias("price_source"),
    )


def with_defaults(code: Column, settings: Column, defaults: Mapping[str, str]) -> Column:
    """JSON settings with what a supplier's defaults add; settings that are there stay, suppliers without defaults too."""
    chosen = F.coalesce(*[F.when(code == name, F.lit(text)) for name, text in defaults.items()], F.lit(None).cast("string"))
    return F.when(chosen.isNotNull(), merge_json(chosen, settings)).otherwise(settings)


def field_observations(cards: DataFrame, key: str, fields: Mapping[str, tuple[Column, Column | str, Column | str]], kind: Column, observed_at: Column) -> DataFrame:
    """One row per product and field: the value as JSON, where it was found and how it was made.

    fields: by name the value, its path and the step that normalized it. An unknown kind of source counts as a page.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    entries = F.array(*[
        F.struct(F.lit(name).alias("field"), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}).alias("json"), as_column(path).alias("path"), as_column(step).alias("step"))
        for name, (value, path, step) in fields.items()
    ])
    rows = cards.select(key, F.when(kind.isin(*SOURCE_KINDS), kind).otherwise("supplier_html").alias("source_kind"), observed_at.alias("observed_at"), F.explode(entries).alias("e"))
    value = F.col("e.json").substr(F.lit(6), F.length("e.json") - 6)  # without {"v": and }
    return rows.select(key, F.col("e.field").alias("field"), value.alias("value"), "source_kind", F.col("e.path").alias("source_path"), F.col("e.step").alias("normalized_by"), "observed_at")


def latest_observations(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The latest observation of every field of every product."""
    return latest_by(current.unionByName(incoming), [key, "field"], ["observed_at", "value", "source_kind", "source_path", "normalized_by"])


def latest_error(products: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Products with the type of their latest error, found by source or canonical URL, without a slash at the end.

    The two URLs become keys of one equi-join instead of an OR of two comparisons.
    """
    bare = lambda c: F.rtrim(c, F.lit("/"))
    urls = F.explode(F.array_distinct(F.array(bare(F.col("source_url")), bare(F.coalesce("canonical_url", "source_url")))))
    hits = products.select(key, urls.alias("_url")).join(errors.select(bare(F.col("url")).alias("_url"), "error_type", "processed_at"), "_url")
    latest = hits.groupBy(key).agg(F.max_by("error_type", F.struct("processed_at", "error_type")).alias("error_type"))
    return products.join(latest, key, "left")


def unseen_evidence(error_type: Column, discovered: Column) -> Column:
    """What a product that a run didn't see shows: its error, a page that was found but not read, or nothing found."""
    return F.when(error_type.isin(*UNCERTAIN, "HTTP_404", "HTTP_410"), error_type).when(discovered, "PARSER_ERROR").otherwise("NOT_DISCOVERED")


def apply_missing(products: DataFrame, unseen: DataFrame, key: str, run: Column, observed_at: Column, guarded: Column, warning_at: int = 2, candidate_at: int = 3) -> DataFrame:
    """The next version of products after a run that didn't see some of them.

    products: key, misses, active, threshold, state, first_missing_at, history (JSON); unseen: key,
    evidence. Confirmed, unguarded evidence counts: the counter rises, the product is switched off at its
    threshold and the state follows; other evidence leaves only an event. item_status says what the run's
    item row holds: missing where the counter rose. Offers mirror misses and activity.
    """
    rows = products.join(unseen.select(key, "evidence"), key, "left")
    absent = F.col("evidence").isNotNull()
    counts = absent & F.col("evidence").isin(*CONFIRMED_MISSING) & ~guarded
    misses = F.col("misses") + F.when(counts, 1).otherwise(0)
    event = F.to_json(F.struct(run.alias("run"), F.col("evidence"), counts.alias("counted"), F.when(counts, misses).alias("misses")))
    return rows.select(
        key, misses.alias("misses"), F.when(counts, F.col("active") & (misses < F.col("threshold"))).otherwise(F.col("active")).alias("active"), "threshold",
        F.when(counts, state_of(misses, warning_at, candidate_at)).otherwise(F.col("state")).alias("state"), F.when(counts, F.coalesce("first_missing_at", observed_at)).otherwise(F.col("first_missing_at")).alias("first_missing_at"),
        F.when(absent, append_event(F.col("history"), event)).otherwise(F.col("history")).alias("history"), F.when(counts, "missing").alias("item_status"),
    )


def mirror_offers(offers: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Default offers of products whose counter rose: one miss more, switched off at the product's threshold."""
    rose = applied.filter("item_status = 'missing'").select(key, F.col("threshold").alias("_limit"))
    rows = offers.join(rose, key, "left")
    counts = F.col("_limit").isNotNull() & (F.col("offer_kind") == "default")
    misses = F.col("misses") + F.when(counts, 1).otherwise(0)
    made = {"misses": misses, "active": F.when(counts & (misses >= F.col("_limit")), False).otherwise(F.col("active"))}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in offers.columns])


def missing_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: products whose counter rose, and those that were switched off."""
    both = after.join(before.select(key, F.col("active").alias("_was")), key)
    return both.agg(F.count_if(F.col("item_status") == "missing").alias("missing_products"), F.count_if(F.col("_was") & ~F.col("active")).alias("deactivated_products"))


def current_paths(paths: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes): category paths with those of the observed products closed and theirs added as current.

    paths: product_id, path_id, is_current; observed: product_id, path_id, categories
    array<struct<name,url>>. Nodes number a path's categories from 1, each with the one before it.
    """
    seen = observed.select("product_id", F.lit(True).alias("_seen"))
    old = paths.join(seen, "product_id", "left").select("product_id", "path_id", (F.col("is_current") & F.col("_seen").isNull()).alias("is_current"))
    flat = observed.select("product_id", "path_id", "categories", F.posexplode("categories").alias("at", "x"))
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(x["url"], F.lit("")), r"([^/]+)/*$", 1), F.lit("")), x["name"])
    nodes = flat.select("product_id", "path_id", (F.col("at") + 1).alias("position"), name(F.col("x")).alias("category"), F.when(F.col("at") > 0, name(F.get("categories", F.col("at") - 1))).alias("parent"))
    return old.unionByName(observed.select("product_id", "path_id", F.lit(True).alias("is_current"))), nodes


def finish_runs(runs: DataFrame, results: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Runs with the status, counters and end of the results that name them; metadata are merged, keys of the result win."""
    new = results.select("run_id", F.struct(*[c for c in results.columns if c != "run_id"]).alias("_n"))
    rows = runs.join(new, "run_id", "left")
    done = F.col("_n").isNotNull()
    made = {c: F.when(done, F.col(f"_n.{c}")).otherwise(F.col(c)) for c in ("status", "finished_at", *counters)}
    made["metadata"] = F.when(done, merge_json(F.col("metadata"), F.col("_n.metadata"))).otherwise(F.col("metadata"))
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in runs.columns])
