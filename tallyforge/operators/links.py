"""Links of sources to registry products over time: contexts, persistence, quarantine, audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.relational import latest_by, walk


def existing_links(sources: DataFrame, events: DataFrame) -> DataFrame:
    """(source_key, target, auto_accepted, origin, manual) of linked sources.

    sources: source_key, linked (null without a link); events: event_id, previous_id, source_key,
    method, auto_accepted, is_current. The origin is the method of the earliest accepted event in the
    current event's chain; a link without a current accepted event counts as manual.
    """
    walked = walk(events, "event_id", "previous_id", F.when(F.col("auto_accepted"), F.col("method")))
    heads = events.filter("is_current").select(F.col("event_id").alias("node"), "source_key").join(walked, "node")
    if not heads.filter("not ended").isEmpty():
        raise ValueError("the events form a cycle")
    origin = heads.filter("value is not null").groupBy("source_key").agg(F.max_by("value", F.struct("depth", "node")).alias("origin"))
    current = events.filter("is_current").groupBy("source_key").agg(F.bool_or("auto_accepted").alias("auto_accepted"))
    rows = sources.filter("linked is not null").join(current, "source_key", "left").join(origin, "source_key", "left")
    accepted = F.coalesce("auto_accepted", F.lit(False))
    return rows.select("source_key", F.col("linked").alias("target"), accepted.alias("auto_accepted"), F.coalesce("origin", F.lit("")).alias("origin"), (~accepted).alias("manual"))


def quarantined(previous_accepted: Column, status: Column) -> Column:
    """Whether an automatic link goes: the engine made it and now says conflict, review or new."""
    return F.coalesce(previous_accepted, F.lit(False)) & status.isin("CONFLICT", "REVIEW", "NEW_CANDIDATE")


def persist_matches(sources: DataFrame, current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, next sources): each incoming decision against the current one of its source.

    sources: source_key, linked; current: source_key, event_id, fingerprint, warning_fingerprint,
    auto_accepted, target; incoming: source_key, status, fingerprint, warning_fingerprint,
    auto_accepted, target. An equal decision is only touched (VALIDATED_UNCHANGED), another one inserted
    after the current (INSERTED_EVENT). Accepted decisions set the link; a quarantined automatic link is
    taken back if it still is the one that the engine made; manual links stay.
    """
    old = current.select("source_key", F.col("event_id").alias("previous_id"), F.struct("fingerprint", "warning_fingerprint").alias("_old"), F.col("auto_accepted").alias("_auto"), F.col("target").alias("_target"))
    same = F.coalesce(F.col("_old") == F.struct("fingerprint", "warning_fingerprint"), F.lit(False))
    accepted = F.col("auto_accepted") & F.col("target").isNotNull()
    taken = ~same & ~accepted & F.col("previous_id").isNotNull() & quarantined(F.col("_auto"), F.col("status"))
    rows = incoming.join(old, "source_key", "left").withColumns({"action": F.when(same, "VALIDATED_UNCHANGED").otherwise("INSERTED_EVENT"), "accepted": accepted, "taken_back": taken})
    actions = rows.select("source_key", "action", "status", "target", F.when(~same, F.col("previous_id")).alias("previous_id"), "accepted", "taken_back")
    said = rows.select("source_key", "accepted", "taken_back", F.col("target").alias("_new"), "_target")
    link = F.when(F.coalesce("accepted", F.lit(False)), F.col("_new")).when(F.coalesce("taken_back", F.lit(False)) & F.col("linked").eqNullSafe(F.col("_target")), None).otherwise(F.col("linked"))
    return actions, sources.join(said, "source_key", "left").select("source_key", link.alias("linked"))


def audit_accepted(assessed: DataFrame) -> DataFrame:
    """Accepted links looked at again: assessed pairs (matching.assess) with result_accepted and result_status."""
    s, c = F.col("s.n_kind"), F.col("c.n_kind")
    kinds = (s == c) & (s != "unknown")
    roles = ~((F.col("s.n_role.role") == "REFERENCE_MODEL") & (F.col("c.n_role.role") != "REFERENCE_MODEL"))
    execution = ~(F.array_contains("conflicts", "model") & (F.col("result_status") == "CONFLICT"))
    properties = F.size(F.filter("conflicts", lambda x: x.startswith("property:") | x.startswith("category_property:"))) == 0
    passed = F.col("result_accepted") & kinds & roles & execution & properties
    why = F.when(passed, F.concat(F.lit("same product kind ("), s, F.lit(") and no reference, execution or critical property conflict"))).otherwise(F.concat(F.lit("blocked by "), F.array_join(F.array_sort("conflicts"), ",")))
    return assessed.select(
        "source_key", "candidate_key", kinds.alias("same_kind"), roles.alias("no_reference_mismatch"), execution.alias("no_execution_mismatch"), properties.alias("no_property_conflict"),
        F.when(passed, "PASS").otherwise("DEMOTED_TO_REVIEW").alias("result"), why.alias("reason"),
    )


def relationship_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accepted decisions of after whose relationship before did not hold: other target, or not accepted."""
    old = before.select("source_key", *[F.col(c).alias(f"old_{c}") for c in ("status", "method", "auto_accepted", "target")])
    rows = after.filter("auto_accepted").join(old, "source_key", "left")
    same = F.coalesce(F.col("old_auto_accepted") & F.col("old_target").eqNullSafe(F.col("target")), F.lit(False))
    return rows.filter(~same).select(
        "source_key", F.coalesce("old_status", F.lit("")).alias("old_status"), F.coalesce("old_method", F.lit("")).alias("old_method"), F.coalesce("old_auto_accepted", F.lit(False)).alias("old_auto_accepted"),
        F.col("old_target"), F.col("status").alias("new_status"), F.col("method").alias("new_method"), F.col("target").alias("new_target"),
    )


def supplier_identifiers(registry: DataFrame, suppliers: Mapping[str, str], prefix: str = "ARTIKUL_") -> DataFrame:
    """(id, property_code, supplier, article): the registry's articles by supplier; unknown codes have none.

    registry: id, properties (array of structs with property_code and value_flat).
    """
    rows = registry.select("id", F.explode("properties").alias("p")).filter(F.col("p.property_code").startswith(prefix) & (F.trim(F.coalesce("p.value_flat", F.lit(""))) != ""))
    known = F.create_map(*[F.lit(x) for pair in sorted(suppliers.items()) for x in pair]) if suppliers else F.create_map().cast("map<string,string>")
    return rows.select("id", F.col("p.property_code").alias("property_code"), F.try_element_at(known, F.col("p.property_code")).alias("supplier"), F.trim("p.value_flat").alias("article")).distinct()


def match_report(decided: DataFrame, sources: DataFrame) -> DataFrame:
    """A flat row per decision, ready for CSV: the source's identity, the decision, and lists as text."""
    names = sources.select(F.col("key").alias("source_key"), "name", "brand", "model", "supplier_article")
    lists = [F.array_join(c, "|").alias(c) for c in ("conflicts", "warnings")]
    return names.join(decided, "source_key").select("source_key", "name", "brand", "model", "supplier_article", "status", "method", "confidence", "candidate_key", *lists, F.upper(F.col("auto_accepted").cast("string")).alias("auto_accepted"))


def latest_links(events: DataFrame) -> DataFrame:
    """The latest accepted current event per source."""
    rows = events.filter("is_current and auto_accepted and status in ('EXACT_MATCH', 'HIGH_CONFIDENCE_MATCH')")
    return latest_by(rows.select("source_key", "target", "at", "event_id"), ["source_key"], ["at", "event_id"])
