"""Reconciliation: links, matches and identities of all sources, in full or of what a change touches.

A change of the registry can alter a source's decision only through the keys of the cascade: an
article, a number in a title, a model, a base, a similar name of the brand, or its link. So a product that
came, went or changed names, by its old and its new keys, the sources that are matched again; all other
decisions are carried over as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import matching as M
from tallyforge.operators.identity import classify
from tallyforge.operators.similar import similar_names
from tallyforge.session import checkpointed


def decide_all(sources: DataFrame, registry: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Decisions of prepared sources: of their link where it leads to a product, else of the cascade.

    links: source_key, candidate_key, origin, manual.
    """
    if links is None:
        return M.decide(checkpointed(M.judged(M.assess(M.pairs(sources, registry, M.candidates(sources, registry))))), sources)
    valid = links.join(registry.select(F.col("key").alias("candidate_key")), "candidate_key", "left_semi")
    valid = checkpointed(valid.join(sources.select(F.col("key").alias("source_key")), "source_key", "left_semi"))
    free = sources.join(valid.select(F.col("source_key").alias("key")), "key", "left_anti")
    return M.relinked(sources, registry, valid).unionByName(decide_all(free, registry))


def reconcile(sources: DataFrame, registry: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, identities) of all prepared sources."""
    decided = checkpointed(decide_all(sources, registry, links))
    return decided, classify(decided, sources, registry)


def _key(kind: str, *columns: Column | str) -> Column:
    filled = F.lit(True)
    for c in columns:
        filled = filled & (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != "")
    return F.when(filled, F.concat_ws("\x1f", F.lit(kind), *columns))


def source_keys(sources: DataFrame) -> DataFrame:
    """(source_key, k): every key by which a product can become a source's candidate."""
    role = F.coalesce(F.nullif(F.col("n_role.own"), F.lit("")), F.col("n_role.reference"))
    keys = F.array(_key("article", "supplier_code", "n_article"), _key("number", "n_article"), _key("model", "n_model"), _key("model", "n_evidence.base"), _key("model", role))
    return sources.select(F.col("key").alias("source_key"), F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))


def product_keys(registry: DataFrame) -> DataFrame:
    """(candidate_key, k): every key by which a product can become a candidate."""
    articles = F.flatten(F.transform(F.map_entries("n_identifiers"), lambda e: F.transform(e["value"], lambda a: _key("article", e["key"], a))))
    numbers = F.transform(F.regexp_extract_all("name", F.lit(r"(?<!\d)(\d{5,10})(?!\d)"), F.lit(1)), lambda n: _key("number", n))
    keys = F.concat(articles, numbers, F.array(_key("model", "n_model")))
    return registry.select(F.col("key").alias("candidate_key"), F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either table (same columns, unique key) whose key the other lacks or has with other values."""
    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.sha2(F.to_json(F.struct(*[F.col(c) for c in before.columns])), 256))

    old, new = hashed(before), hashed(after.select(*before.columns))
    both = old.select("key", F.col("_h").alias("_a")).join(new.select("key", F.col("_h").alias("_b")), "key", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("key")
    return old.unionByName(new).join(both, "key", "left_semi").drop("_h")


def touched_sources(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """source_key of sources whose candidates the changed products (old and new rows) were, or may become."""
    by_key = source_keys(sources).join(product_keys(changed).select("k").distinct(), "k", "left_semi").select("source_key")
    named = sources.filter("n_brand <> ''").select(F.col("key").alias("source_key"), F.col("n_brand").alias("block"), F.col("n_name").alias("name"))
    alike = similar_names(named, changed.filter("n_brand <> ''").select(F.col("n_brand").alias("block"), F.col("n_name").alias("name")), M.RETRIEVE, None)
    by_name = named.join(alike.select("block", F.col("left_name").alias("name")).distinct(), ["block", "name"]).select("source_key")
    return by_key.unionByName(by_name).distinct()


def reconcile_changes(
    sources_before: DataFrame, sources: DataFrame, registry_before: DataFrame, registry: DataFrame, decided: DataFrame, identified: DataFrame,
    links_before: DataFrame | None = None, links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, identities, touched): what reconcile gives of sources and registry, from what it gave of those before.

    Only the sources in touched (source_key) are matched and decided again: those that came or changed, that a
    changed product touches, and whose link came, went, changed or leads to a changed product.
    """
    changed = checkpointed(changed_rows(registry_before, registry))
    touched = changed_rows(sources_before, sources).select(F.col("key").alias("source_key")).unionByName(touched_sources(sources, changed))
    if links is not None and links_before is not None:
        moved = links_before.exceptAll(links).unionByName(links.exceptAll(links_before)).select("source_key")
        led = links.join(changed.select(F.col("key").alias("candidate_key")).distinct(), "candidate_key", "left_semi").select("source_key")
        touched = touched.unionByName(moved).unionByName(led)
    touched = checkpointed(touched.distinct())
    some = sources.join(touched.withColumnRenamed("source_key", "key"), "key", "left_semi")
    again, identities = reconcile(some, registry, links)
    known = sources.select(F.col("key").alias("source_key"))

    def carried(rows: DataFrame, fresh: DataFrame) -> DataFrame:
        return rows.join(touched, "source_key", "left_anti").join(known, "source_key", "left_semi").unionByName(fresh)

    return carried(decided, again), carried(identified, identities), touched
