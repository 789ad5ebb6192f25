"""The registry of canonical properties and how suppliers' and the catalog's properties map to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import first_match, fold
from tallyforge.functions.units import DIMENSIONS, POLICIES, UNIT_NAMES
from tallyforge.operators.matching import PROFILE_POLICIES
from tallyforge.operators.merge import insert_absent, merge_json

#: Units of the canonical properties that have one.
UNITS = {
    **dict.fromkeys(("power", "motor_power"), "W"), "voltage": "V", "weight": "kg", "capacity": "L", "spindle_speed": "rpm",
    **dict.fromkeys((
        "length", "width", "height", "diameter", "max_turning_diameter", "distance_between_centers", "spindle_bore", "travel_x", "travel_y", "travel_z",
        "max_drilling_diameter", "spindle_travel", "jaw_width", "clamping_range", "working_radius",
    ), "mm"),
}
#: States of a supplier's mapping that a later reconciliation may change.
AUTOMATIC = ("UNMAPPED", "AUTO_PROPOSED")
_CANONICAL = "code string, data_type string, unit string, usable_for_identity boolean, identity_critical boolean, usable_as_filter boolean"


def canonical_registry(spark: SparkSession, current: DataFrame | None = None) -> DataFrame:
    """One row per property that the policies know; what current has already stays as it is."""
    rows = []
    for name, policy in sorted({**POLICIES, **PROFILE_POLICIES}.items()):
        kind = "range" if policy.kind in ("range", "thread_range") else "string" if policy.kind in ("string", "dimension", "execution") else "number"
        critical = policy.importance == "IDENTITY_CRITICAL"
        rows.append((name.upper(), kind, UNITS.get(name), critical, critical, True))
    known = spark.createDataFrame(rows, _CANONICAL)
    return known if current is None else insert_absent(current, known, ["code"])


def observed_properties(properties: DataFrame, categories: DataFrame) -> DataFrame:
    """Each property name of a supplier with its unit, a sample, how often it occurs and in which categories.

    properties: supplier, product_id, name, unit, value; categories: product_id, category. Categories are
    joined after names are counted by product, so that a product's many categories don't multiply counts.
    """
    unit = F.coalesce("unit", F.lit(""))
    named = properties.groupBy("supplier", "product_id", "name", unit.alias("unit")).agg(F.min("value").alias("sample"), F.count("*").alias("n"))
    counted = named.groupBy("supplier", "name", "unit").agg(F.min("sample").alias("sample"), F.sum("n").alias("occurrences"))
    where = named.select("supplier", "name", "unit", "product_id").join(categories.select("product_id", "category").distinct(), "product_id")
    context = where.groupBy("supplier", "name", "unit").agg(F.array_join(F.array_sort(F.collect_set("category")), " / ").alias("category_context"))
    return counted.join(context, ["supplier", "name", "unit"], "left").withColumn("category_context", F.coalesce("category_context", F.lit("")))


def propose_mappings(observed: DataFrame, canonical: DataFrame, canonical_name: Column) -> DataFrame:
    """Observed properties as proposals: type by the sample, the canonical property by its name, status and confidence."""
    known = canonical.select("code", F.lit(True).alias("_known"))
    rows = observed.withColumn("code", F.upper(canonical_name)).join(F.broadcast(known), "code", "left")
    number = F.coalesce(F.col("sample").rlike(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(False))
    evidence = F.to_json(F.struct(F.col("occurrences"), F.lit("product_properties").alias("discovered_from"), F.nullif(F.lower("code"), F.lit("")).alias("taxonomy_key")), {"ignoreNullFields": "false"})
    return rows.select(
        "supplier", "category_context", F.col("name").alias("source_name"), fold(F.col("name")).alias("normalized_name"), "sample", F.nullif(F.col("unit"), F.lit("")).alias("source_unit"),
        F.when(number, "number").otherwise("string").alias("inferred_type"), F.when(F.col("_known"), F.col("code")).alias("canonical"),
        F.when(F.col("_known"), "AUTO_PROPOSED").otherwise("UNMAPPED").alias("status"), F.when(F.col("_known"), 0.95).alias("confidence"), evidence.alias("evidence"),
    )


def reconcile_mappings(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """The next version of the mappings: what is observed is refreshed; decisions that people took stay.

    Evidence of both sides is merged, the newer value of a key wins; mappings that are no longer observed
    are carried over. Of several proposals for one key the one with the greatest source name counts.
    """
    keys = ["supplier", "category_context", "normalized_name"]
    rest = [c for c in proposed.columns if c not in keys]
    one = proposed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("source_name", F.coalesce("source_unit", F.lit("")))).alias("new"))
    rows = current.select(*keys, F.struct(*rest).alias("old")).join(one, keys, "fullouter")
    automatic = F.col("old").isNull() | F.col("old.status").isin(*AUTOMATIC)
    taken = {c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in ("source_name", "sample", "source_unit", "inferred_type")}
    decided = {c: F.when(F.col("new").isNull() | ~automatic, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in ("canonical", "status", "confidence")}
    made = {**taken, **decided, "evidence": merge_json(F.col("old.evidence"), F.col("new.evidence"))}
    return rows.select(*keys, *[made[c].alias(c) for c in rest])


def override_mappings(mappings: DataFrame, rules: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mappings with the active rules that set them by hand: an update from a join.

    rules: rule_id, supplier, entity_key, config (JSON), active; canonical: code, property_id. A config's
    canonical_property_id that is not a number, or not known, sets nothing; of several rules the greatest
    rule_id wins.
    """
    target = F.get_json_object("config", "$.canonical_property_id")
    asked = rules.filter("active").select("rule_id", "supplier", F.col("entity_key").alias("normalized_name"), F.when(target.rlike("^[0-9]+$"), target.try_cast("bigint")).alias("property_id"))
    known = asked.join(F.broadcast(canonical.select("property_id", F.col("code").alias("_code"))), "property_id")
    last = known.groupBy("supplier", "normalized_name").agg(F.max(F.struct("rule_id", "_code")).alias("_r"))
    rows = mappings.join(last, ["supplier", "normalized_name"], "left")
    ruled = F.col("_r").isNotNull()
    made = {
        "canonical": F.when(ruled, F.col("_r._code")).otherwise(F.col("canonical")), "status": F.when(ruled, "MANUAL_CONFIRMED").otherwise(F.col("status")),
        "evidence": F.when(ruled, merge_json(F.col("evidence"), F.to_json(F.struct(F.col("_r.rule_id").alias("business_rule_id"))))).otherwise(F.col("evidence")),
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in mappings.columns])


def catalog_evidence(observed: DataFrame, canonical: DataFrame, canonical_name: Column, current: DataFrame | None = None) -> DataFrame:
    """(canonical, property_id, property_code, name, evidence, status): the catalog's properties seen for canonical ones.

    observed: property_id, property_code, name. Only what was seen is recorded, for review; a mapping
    that current holds as MATCHED stays so. Of several observations the greatest (code, id) counts.
    """
    seen = observed.filter(F.coalesce("property_id", "property_code").isNotNull()).distinct()
    rows = seen.withColumn("canonical", F.upper(canonical_name)).join(F.broadcast(canonical.select(F.col("code").alias("canonical"))), "canonical", "left_semi")
    evidence = F.to_json(F.struct(F.col("property_id").isNotNull().alias("id_observed"), F.col("property_code").isNotNull().alias("code_observed")))
    one = rows.withColumn("evidence", evidence).groupBy("canonical").agg(F.max(F.struct("property_code", "property_id", "name", "evidence")).alias("x"))
    one = one.select("canonical", "x.property_id", "x.property_code", "x.name", "x.evidence")
    if current is None:
        return one.withColumn("status", F.lit("REVIEW"))
    old = current.select("canonical", F.col("status").alias("_status"))
    return one.join(old, "canonical", "left").withColumn("status", F.when(F.col("_status") == "MATCHED", "MATCHED").otherwise("REVIEW")).drop("_status")


def filter_profiles(profiles: DataFrame, members: DataFrame, canonical: DataFrame) -> DataFrame:
    """Profiles with their properties as a JSON array in order of position; [] for a profile without any."""
    rows = members.join(F.broadcast(canonical.select("code", "unit")), "code")
    item = F.struct("position", "code", "unit", "use_as_filter")
    found = rows.groupBy("profile_id").agg(F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("properties"))
    return profiles.join(found, "profile_id", "left").withColumn("properties", F.coalesce("properties", F.lit("[]")))


def mapping_statuses(mappings: DataFrame) -> DataFrame:
    """One row: mappings in all and in each state, 0 where there are none."""
    states = ("AUTO_PROPOSED", "MANUAL_CONFIRMED", "MANUAL_REJECTED", "IGNORED", "UNMAPPED")
    return mappings.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in states])


def mapping_compatibility(inferred: Column, source_unit: Column, active: Column, data_type: Column, target_unit: Column) -> Column:
    """Whether a mapping may be confirmed: COMPATIBLE, UNAVAILABLE, TYPE_MISMATCH or DIMENSION_MISMATCH."""
    def dimension(unit: Column) -> Column:
        names = F.create_map(*[F.lit(x) for k, v in UNIT_NAMES.items() for x in (k, DIMENSIONS[v])])
        return F.try_element_at(names, F.lower(F.trim(F.coalesce(unit, F.lit("")))))

    differ = dimension(source_unit).isNotNull() & dimension(target_unit).isNotNull() & (dimension(source_unit) != dimension(target_unit))
    return first_match([
        (~F.coalesce(active, F.lit(False)), F.lit("UNAVAILABLE")),
        ((inferred == "number") & ~data_type.isin("number", "integer", "range"), F.lit("TYPE_MISMATCH")), (differ, F.lit("DIMENSION_MISMATCH")),
    ], "COMPATIBLE")
