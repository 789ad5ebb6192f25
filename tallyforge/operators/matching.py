"""Catalog matching: candidate cascade, identity conflicts and explainable decisions.

Products (sources and registry) have: key, name, brand, model, supplier_article, manufacturer_article,
category, properties (map<string,string>), supplier_code, identifiers (map<string,array<string>>: the
articles that suppliers use for a registry product) and kind. prepare() adds the normalized columns
once; pairs are joined on them, never all against all. Decisions are columns over the pairs of a
source, reduced by one aggregate per source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.models import similarity, title_facts
from tallyforge.functions.taxonomy import canonical_properties, model_role, product_kind, profile_of
from tallyforge.functions.text import compact, first_match, fold, nfkc, normalize_brand, normalize_model, normalized_name, same_parts, short_suffix
from tallyforge.functions.units import POLICIES, PropertyPolicy, compare_properties
from tallyforge.operators.relational import top_k
from tallyforge.operators.similar import similar_pairs
from tallyforge.session import checkpointed

#: Thresholds of name similarity.
RETRIEVE, CONFLICT, REVIEW, SEMANTIC = 0.60, 0.75, 0.72, 0.45
#: Policies of the canonical properties that a kind's profile compares.
PROFILE_POLICIES = {
    **{n: PropertyPolicy("length", "IDENTITY_CRITICAL") for n in ("distance_between_centers", "travel_x", "travel_y", "travel_z", "spindle_travel", "jaw_width", "clamping_range", "working_radius")},
    **{n: PropertyPolicy("diameter", "IDENTITY_CRITICAL") for n in ("max_turning_diameter", "spindle_bore", "max_drilling_diameter")},
    **{n: PropertyPolicy("string", "IDENTITY_CRITICAL") for n in ("spindle_taper", "machine_mode", "vise_type", "drive_type")},
    **{n: PropertyPolicy("dimension", "IDENTITY_CRITICAL") for n in ("table_size", "wheel_size")},
    "motor_power": PropertyPolicy("power", "IDENTITY_CRITICAL"), "voltage": PropertyPolicy("voltage", "IDENTITY_CRITICAL", absolute="10"),
    "spindle_speed": PropertyPolicy("rpm", "SUPPORTING"), "thread_range": PropertyPolicy("thread_range", "IDENTITY_CRITICAL"),
    "tool_range": PropertyPolicy("range", "IDENTITY_CRITICAL"), "physical_size": PropertyPolicy("dimension", "SUPPORTING"),
}
_EMPTY = "array<string>"
#: Most keys that an unclear decision names.
KEYS = 25


def prepare(products: DataFrame) -> DataFrame:
    """products with n: normalized brand, model, articles, name, kind, role, title models, canonical properties.

    Texts are put into NFKC, and titles read for models, by one Python step; the rest stays in the JVM. This is
    the dearest step, so tables of fewer files than there are cores are dealt to all cores first.
    """
    cores = products.sparkSession.sparkContext.defaultParallelism
    if 0 < len(products.inputFiles()) < cores:
        products = products.repartition(cores)
    texts = ("name", "brand", "model", "category", "supplier_article", "manufacturer_article")
    rows = products.withColumns({**{f"_{c}": nfkc(F.col(c)) for c in texts}, "_title": title_facts(F.col("name"))})
    plain = {c: F.col(f"_{c}") for c in texts}
    made = normalize_model(plain["model"], plain["brand"], unicode=False)
    kind = product_kind(plain["name"], plain["category"], unicode=False)["kind"]
    rows = rows.withColumns({"_made": made, "_kind": kind})
    rows = rows.withColumns({
        "n_brand": normalize_brand(plain["brand"], unicode=False), "n_model": F.col("_made.model"), "n_flags": F.col("_made.flags"),
        "n_article": compact(fold(plain["supplier_article"])), "n_maker_article": compact(fold(plain["manufacturer_article"])), "n_name": normalized_name(plain["name"], unicode=False),
        "n_kind": F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.col("_kind")), "n_models": F.col("_title.models"), "n_evidence": F.col("_title").dropFields("models"),
        "n_role": model_role(plain["name"], plain["category"], plain["model"], False, F.col("_title.identity"), F.col("_title.models"), F.col("_kind")),
        "n_props": canonical_properties(F.coalesce("properties", F.create_map().cast("map<string,string>"))), "n_identifiers": _articles(F.col("identifiers")),
    })
    return rows.drop(*[f"_{c}" for c in texts], "_title", "_made", "_kind")


def _articles(identifiers: Column) -> Column:
    """The map's articles in the form in which articles are compared."""
    lists = F.array_join(F.transform(F.map_values(identifiers), lambda x: F.array_join(x, "\x1f")), "\x1e")
    made = F.transform(F.split(nfkc(lists), "\x1e"), lambda x: F.filter(F.transform(F.split(x, "\x1f"), lambda a: compact(fold(a))), lambda a: a != ""))
    return F.when(F.size(identifiers) > 0, F.map_from_arrays(F.map_keys(identifiers), made)).otherwise(F.create_map().cast("map<string,array<string>>"))


def candidates(sources: DataFrame, registry: DataFrame, top: int = 10, title_rules: Mapping[str, str] | None = None) -> DataFrame:
    """(source_key, candidate_key, tier, ratio): the candidates of each source's first tier that has any.

    Tiers: 1 the supplier's article among the product's identifiers, 2 that article in the registry
    title, 3 the model, 4 the base of the source's title among the registry's models, 5 names of one brand
    with similarity of at least 0.60, the best `top` by similarity and key, with that ratio. Tiers 1 to 4
    are equi-joins; tier 5 only takes sources without any of those, through the index of similar_pairs.
    title_rules: pattern by supplier code; tier 2 then takes only these suppliers' articles, from titles that
    match the pattern.
    """
    s = sources.select(F.col("key").alias("source_key"), "supplier_code", "n_article", "n_model", "n_brand", "n_name", F.col("n_evidence.base").alias("base"))
    ids = registry.select("key", F.explode("n_identifiers").alias("supplier_code", "articles")).select(F.col("key").alias("candidate_key"), "supplier_code", F.explode(F.array_distinct("articles")).alias("n_article"))
    number = F.array_distinct(F.regexp_extract_all("name", F.lit(r"(?<!\d)(\d{5,10})(?!\d)"), F.lit(1)))
    titles, title_keys = registry.select(F.col("key").alias("candidate_key"), "name", F.explode(number).alias("n_article")), ["n_article"]
    if title_rules is not None:
        fitting = F.array_compact(F.array(*[F.when(F.col("name").rlike(f"(?iU){pattern}"), F.lit(code)) for code, pattern in sorted(title_rules.items())]))
        titles, title_keys = titles.withColumn("supplier_code", F.explode(fitting)), ["supplier_code", "n_article"]
    models = registry.select(F.col("key").alias("candidate_key"), "n_model").filter("n_model <> ''")
    article = s.filter("n_article <> ''")
    tiers = [
        article.join(ids, ["supplier_code", "n_article"]), article.join(titles, title_keys),
        s.join(models, "n_model"), s.drop("n_model").join(models.withColumnRenamed("n_model", "base"), "base"),
    ]
    found = None
    for tier, rows in enumerate(tiers, 1):
        rows = rows.select("source_key", "candidate_key", F.lit(tier).alias("tier")).distinct()
        found = rows if found is None else found.unionByName(rows)
    first = found.groupBy("source_key").agg(F.min("tier").alias("tier"))
    exact = found.join(first, ["source_key", "tier"]).select("source_key", "candidate_key", "tier", F.lit(None).cast("double").alias("ratio"))
    named = [F.col("n_brand").alias("block"), F.col("n_name").alias("name")]
    alone = s.filter("n_brand <> ''").join(first, "source_key", "left_anti").select(F.col("source_key").alias("key"), *named)
    alike = similar_pairs(alone, registry.filter("n_brand <> ''").select("key", *named), RETRIEVE, top, F.col("right_key").cast("string").desc())
    return exact.unionByName(alike.select(F.col("left_key").alias("source_key"), F.col("right_key").alias("candidate_key"), F.lit(5).alias("tier"), "ratio"))


#: What the rules read of a product.
_READ = ("properties", "n_brand", "n_model", "n_flags", "n_article", "n_maker_article", "n_name", "n_kind", "n_models", "n_evidence", "n_role", "n_props")


def pairs(sources: DataFrame, registry: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs (source_key, candidate_key, and ratio if it is known) with both products as structs s and c."""
    left = sources.select(F.col("key").alias("source_key"), F.struct("supplier_code", *_READ).alias("s"))
    right = registry.select(F.col("key").alias("candidate_key"), F.struct("n_identifiers", *_READ).alias("c"))
    return found.join(left, "source_key").join(right, "candidate_key")


def _differ(name: str) -> Column:
    return (F.col(f"s.{name}") != "") & (F.col(f"c.{name}") != "") & (F.col(f"s.{name}") != F.col(f"c.{name}"))


def conflict_class(confirmed: Column) -> Column:
    """Of an assessed pair, if the supplier's article is known to be the product's, or not."""
    return first_match([(F.col("hard"), F.lit("IDENTITY_CONFLICT")), (confirmed, F.col("quality")), (_differ("n_model"), F.lit("IDENTITY_CONFLICT"))], "")


def assess(joined: DataFrame) -> DataFrame:
    """Pairs with conflicts, property classes, equalities, article quality and name similarity."""
    ratio = F.col("ratio") if "ratio" in joined.columns else F.lit(None).cast("double")
    own = (F.col("s.n_role.role") == "REFERENCE_MODEL") & (F.col("c.n_role.role") == "OWN_MODEL") & (F.col("s.n_role.reference") != "") & (F.col("s.n_role.reference") == F.col("c.n_role.own"))
    kinds = (F.col("s.n_kind") != "unknown") & (F.col("c.n_kind") != "unknown") & (F.col("s.n_kind") != F.col("c.n_kind"))
    rows = joined.withColumns({
        "properties": compare_properties(F.col("s.properties"), F.col("c.properties"), POLICIES, "property:"),
        "profile": F.filter(compare_properties(F.col("s.n_props"), F.col("c.n_props"), PROFILE_POLICIES), lambda x: F.array_contains(profile_of(F.col("s.n_kind")), x["name"])),
        "name_similarity": F.coalesce(ratio, similarity(*[F.when(ratio.isNull(), F.col(f"{side}.n_name")) for side in "sc"])),
    })
    clash = F.transform(F.filter("properties", lambda x: x["class"] == "PROPERTY_IDENTITY_CONFLICT"), lambda x: x["name"])
    category = F.transform(F.filter("profile", lambda x: x["class"] == "PROPERTY_IDENTITY_CONFLICT"), lambda x: F.concat(F.lit("category_property:"), x["name"]))
    named = F.array_compact(F.array(
        F.when(_differ("n_brand"), F.lit("brand")), F.when(_differ("n_model"), F.lit("model")), F.when(_differ("n_maker_article"), F.lit("manufacturer_article")),
        F.when(kinds, F.lit("product_kind")), F.when(own, F.lit("model_role")),
    ))
    articles = F.coalesce(F.try_element_at(F.col("c.n_identifiers"), F.col("s.supplier_code")), F.array().cast(_EMPTY))
    held = F.coalesce((F.col("s.n_article") != "") & F.array_contains(articles, F.col("s.n_article")), F.lit(False))
    rows = rows.withColumns({
        "conflicts": F.array_sort(F.concat(named, clash, category)),
        "warnings": F.transform(F.filter("properties", lambda x: x["class"] == "PROPERTY_DATA_QUALITY_WARNING"), lambda x: x["name"]),
        "article_confirmed": held,
        "maker_equal": (F.col("s.n_maker_article") != "") & (F.col("s.n_maker_article") == F.col("c.n_maker_article")),
        "brand_equal": (F.col("s.n_brand") != "") & (F.col("s.n_brand") == F.col("c.n_brand")),
        "model_equal": (F.col("s.n_model") != "") & (F.col("s.n_model") == F.col("c.n_model")),
    })
    a, b = F.col("s.n_model"), F.col("c.n_model")
    one_new = a.isin(F.lit("")) | (b == F.concat(a, F.lit("new"))) | (a == F.concat(b, F.lit("new")))
    titled = (F.size(F.array_intersect("s.n_models", "c.n_models")) > 0) | F.array_contains("c.n_models", a)
    reordered = (F.col("s.n_article") != "") & (F.col("s.n_article") == F.col("c.n_maker_article")) & F.array_contains("c.n_models", b) & same_parts(a, b)
    flagged = F.size("s.n_flags") + F.size("c.n_flags") > 0
    quality = first_match([
        (~_differ("n_model"), F.when(flagged, "EXTRACTION_CONFLICT").otherwise("")),
        (titled & one_new, F.lit("EXTRACTION_CONFLICT")), (titled, F.lit("FIELD_DATA_CONFLICT")), (reordered, F.lit("EXTRACTION_CONFLICT")),
    ], "IDENTITY_CONFLICT")
    rows = rows.withColumns({"hard": F.size(F.filter("conflicts", lambda x: x != "model")) > 0, "quality": quality})
    rows = rows.withColumn("conflict_class", conflict_class(F.col("article_confirmed")))
    refers = F.col("s.n_role.role") == "REFERENCE_MODEL"
    execution = (F.col("s.n_evidence.base") != "") & (F.col("s.n_evidence.base") == F.col("c.n_evidence.base")) & (F.col("s.n_evidence.qualifier") != F.col("c.n_evidence.qualifier"))
    return rows.withColumn("vetoes", F.array_compact(F.array(
        F.when(refers, F.lit("source_model_is_reference_or_compatibility_model")), F.when(kinds, F.lit("product_kind_mismatch")),
        F.when(refers & (F.col("c.n_role.role") == "OWN_MODEL") & (F.col("s.n_role.reference") == F.col("c.n_role.own")), F.lit("reference_model_cannot_match_candidate_own_model")),
        F.when(execution, F.lit("execution_or_version_mismatch")), F.when(F.col("name_similarity") < SEMANTIC, F.lit("name_compatibility_below_brand_model_threshold")),
    )))


def judged(assessed: DataFrame) -> DataFrame:
    """What decide reads of each assessed pair: (source_key, e)."""
    suffix = short_suffix(F.col("s.n_model"), F.col("c.n_model"))
    strong = (F.size("conflicts") == 0) & F.col("brand_equal") & (F.col("maker_equal") | F.col("model_equal"))
    clash = (F.size("conflicts") > 0) & ((F.col("name_similarity") >= CONFLICT) | F.col("maker_equal") | (F.col("brand_equal") & F.col("model_equal")))
    return assessed.select("source_key", F.struct(
        "candidate_key", "name_similarity", "conflicts", "warnings", "maker_equal", "brand_equal", "model_equal", "conflict_class", "vetoes",
        suffix.alias("suffix"), (F.col("s.n_article") != "").alias("has_article"), F.col("article_confirmed").alias("confirmed"), strong.alias("strong"), clash.alias("clash"),
    ).alias("e"))


def decide(pairs_judged: DataFrame, sources: DataFrame) -> DataFrame:
    """One decision per source: status, method, confidence, candidate, conflicts, warnings, auto_accepted; also
    conflict_class of the candidate, candidate_keys (the first KEYS, in key order, where several are confirmed or
    strong) and evidence (JSON).

    Sources without candidates are NEW_CANDIDATE. Of a source's candidates (rows of judged) the rules need
    counts and four single ones, which aggregates find that combine on the map side: the first confirmed
    and the first strong one by key, and the likest of the clashing ones and of all, the first by key of equals.
    """
    confirmed, strong, clash, key = (F.col(f"e.{c}") for c in ("confirmed", "strong", "clash", "candidate_key"))
    likest = F.struct(-F.col("e.name_similarity"), key)

    def first(test: Column, order: Column) -> Column:
        return F.min_by(F.when(test, F.col("e")), F.when(test, order))

    found = pairs_judged.groupBy("source_key").agg(
        F.count("*").alias("n"), F.count_if(confirmed).alias("n_confirmed"), F.count_if(strong).alias("n_strong"), F.count_if(clash).alias("n_clash"),
        first(confirmed, key).alias("a"), first(strong, key).alias("g"), first(clash, likest).alias("k"), first(F.lit(True), likest).alias("top"),
    )
    several = top_k(pairs_judged.filter(confirmed | strong).select("source_key", confirmed.alias("_c"), key.alias("_k")), ["source_key"], [F.desc("_c"), F.asc("_k")], KEYS)
    several = several.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("rank", "_c", "_k"))).alias("_several"))
    rows = sources.select(F.col("key").alias("source_key")).join(found, "source_key", "left").join(several, "source_key", "left").na.fill(0, ["n", "n_confirmed", "n_strong", "n_clash"])
    model_only = F.col("k.conflicts") == F.array(F.lit("model"))
    soft = F.col("k.brand_equal") & F.col("k.model_equal") & (F.size(F.array_except("k.conflicts", F.array(F.lit("product_kind"), F.lit("model_role")))) == 0)
    one, exact = F.lit(1.0), F.col("g.maker_equal")
    similar, nothing, nobody = F.round("top.name_similarity", 4), F.array().cast(_EMPTY), F.lit(None).cast(rows.schema["a"].dataType)
    rules = [  # condition, status, method, confidence, candidate, conflicts, accepted
        (F.col("n") < 1, "NEW_CANDIDATE", "NO_CANDIDATES", F.lit(0.0), nobody, nothing, False),
        (F.col("n_confirmed") > 1, "REVIEW", "DUPLICATE_SUPPLIER_ARTICLE", one, nobody, nothing, False),
        ((F.col("n_confirmed") == 1) & (F.col("a.conflict_class") == "IDENTITY_CONFLICT"), "CONFLICT", "SUPPLIER_ARTICLE_IDENTITY_CONFLICT", one, F.col("a"), F.col("a.conflicts"), False),
        (F.col("n_confirmed") == 1, "EXACT_MATCH", "SUPPLIER_ARTICLE_EXACT", one, F.col("a"), nothing, True),
        ((F.col("n_strong") == 1) & exact, "EXACT_MATCH", "MANUFACTURER_IDENTIFIER", one, F.col("g"), nothing, True),
        ((F.col("n_strong") == 1) & (F.size("g.vetoes") > 0), "REVIEW", "BRAND_MODEL_IDENTITY_REVIEW", F.round("g.name_similarity", 4), F.col("g"), F.array(F.lit("semantic_identity")), False),
        (F.col("n_strong") == 1, "HIGH_CONFIDENCE_MATCH", "BRAND_MODEL", F.lit(0.94), F.col("g"), nothing, True),
        (F.col("n_strong") > 1, "REVIEW", "NON_UNIQUE_STRONG_CANDIDATES", F.lit(0.8), nobody, nothing, False),
        ((F.col("n_clash") > 0) & (soft | (model_only & ((F.col("k.has_article") & ~F.col("k.maker_equal")) | F.col("k.suffix")))), "REVIEW", "BRAND_MODEL_IDENTITY_REVIEW", F.round("k.name_similarity", 4), F.col("k"), F.col("k.conflicts"), False),
        (F.col("n_clash") > 0, "CONFLICT", "IDENTITY_CONFLICT", F.round("k.name_similarity", 4), F.col("k"), F.col("k.conflicts"), False),
        (F.col("top.name_similarity") >= REVIEW, "REVIEW", "NAME_CANDIDATE_ONLY", similar, F.col("top"), F.col("top.conflicts"), False),
    ]
    last = ("NEW_CANDIDATE", "NO_IDENTITY_EVIDENCE", similar, F.col("top"), F.col("top.conflicts"), False)

    def column(k: int) -> Column:
        return first_match([(rule[0], rule[k]) for rule in rules], last[k - 1])

    names = ("status", "method", "confidence", "best", "conflicts", "auto_accepted")
    unclear = F.col("method").isin("DUPLICATE_SUPPLIER_ARTICLE", "NON_UNIQUE_STRONG_CANDIDATES")
    counted = F.when(F.col("method") == "DUPLICATE_SUPPLIER_ARTICLE", F.col("n_confirmed")).when(F.col("method").startswith("SUPPLIER_ARTICLE"), F.lit(1).cast("bigint"))
    keys = F.transform(F.filter("_several", lambda x: x["_c"] == (F.col("n_confirmed") > 0)), lambda x: x["_k"].cast("string"))
    rows = rows.withColumns({name: column(k) for k, name in enumerate(names, 1)})
    rows = rows.withColumn("candidate_keys", F.when(unclear, keys).otherwise(nothing))
    evidence = F.to_json(F.struct(
        F.when(F.size("candidate_keys") > 0, F.col("candidate_keys")).alias("candidate_keys"), counted.alias("candidate_count"), F.nullif(F.col("best.conflict_class"), F.lit("")).alias("conflict_class"),
        F.when(F.col("n_confirmed") > 0, True).alias("supplier_specific_article_confirmed"), *[F.col(f"best.{c}").alias(c) for c in ("brand_equal", "model_equal")], F.col("best.maker_equal").alias("manufacturer_article_equal"),
        F.round("best.name_similarity", 4).alias("name_similarity"), F.when(F.array_contains("conflicts", "semantic_identity"), F.col("best.vetoes")).alias("semantic_identity_contradictions"),
        F.when((F.col("n_confirmed") == 1) & (F.size("best.warnings") > 0), F.array_sort("best.warnings")).alias("data_quality_flags"),
    ))
    warnings = F.when(F.col("n_confirmed") == 1, F.col("a.warnings")).otherwise(nothing)
    return rows.select(
        "source_key", "status", "method", "confidence", F.col("best.candidate_key").cast("string").alias("candidate_key"), "conflicts", "auto_accepted", warnings.alias("warnings"),
        "candidate_keys", F.coalesce("best.conflict_class", F.lit("")).alias("conflict_class"), evidence.alias("evidence"),
    )


def resolve(sources: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, and the prepared sources and registry.

    Prepared tables are checkpointed, since many joins read them and normalizing titles is the dearest
    step, and what the rules read of the pairs, which two aggregates read.
    """
    left, right = checkpointed(prepare(sources)), checkpointed(prepare(registry))
    return decide(checkpointed(judged(assess(pairs(left, right, candidates(left, right))))), left), left, right


def match(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """The whole cascade: prepare, find candidates, assess the pairs, decide."""
    return resolve(sources, registry)[0]


def revalidate(links: DataFrame) -> DataFrame:
    """Existing links, as assessed pairs with `manual` and `origin`: kept, or in conflict."""
    semantic = (F.col("origin") == "BRAND_MODEL") & (F.size("vetoes") > 0)
    conflict = (F.col("conflict_class") == "IDENTITY_CONFLICT") | semantic
    status = F.when(F.col("manual"), "EXACT_MATCH").when(conflict, "CONFLICT").otherwise("EXACT_MATCH")
    method = F.when(F.col("manual"), "EXISTING_LINK_MANUAL").when(conflict, "EXISTING_LINK_CONFLICT").otherwise("EXISTING_LINK")
    return links.withColumns({"semantic": semantic, "status": status, "method": method, "confidence": F.lit(1.0), "auto_accepted": ~F.col("manual") & ~conflict})


def relinked(sources: DataFrame, registry: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions, as decide gives them, of prepared sources whose link leads to a registry product.

    links: source_key, candidate_key, origin (the method that made the link) and manual. conflict_class is
    that of a second look, where the article counts as the product's if it made the link.
    """
    rows = revalidate(assess(pairs(sources, registry, links.select("source_key", "candidate_key")).join(links.drop("candidate_key"), "source_key")))
    kept = F.col("method") == "EXISTING_LINK"
    confirmed = kept & F.col("origin").contains("SUPPLIER_ARTICLE") & (F.col("s.n_article") != "")
    again = F.when(F.col("manual"), "").when(kept & F.col("semantic"), "IDENTITY_CONFLICT").otherwise(conflict_class(confirmed))
    semantic = F.when(F.col("semantic"), F.array(F.lit("semantic_identity"))).otherwise(F.array().cast(_EMPTY))
    conflicts = F.when(F.col("method") == "EXISTING_LINK_CONFLICT", F.array_sort(F.concat("conflicts", semantic))).otherwise(F.array().cast(_EMPTY))
    evidence = F.to_json(F.struct(
        F.lit(True).alias("existing_link"), (~F.col("manual")).alias("existing_link_revalidated"), F.when(F.col("manual"), "MANUAL_OR_HUMAN_CONFIRMED").otherwise("AUTOMATIC_ENGINE").alias("mapping_provenance"),
        F.when(~F.col("manual"), F.col("origin")).alias("origin_match_method"), F.when(~F.col("manual") & F.col("semantic"), F.col("vetoes")).alias("semantic_identity_contradictions"),
    ))
    return rows.select(
        "source_key", "status", "method", "confidence", F.col("candidate_key").cast("string").alias("candidate_key"), conflicts.alias("conflicts"), "auto_accepted",
        F.when(F.col("manual"), F.array().cast(_EMPTY)).otherwise(F.col("warnings")).alias("warnings"), F.array().cast(_EMPTY).alias("candidate_keys"), again.alias("conflict_class"), evidence.alias("evidence"),
    )


#: The least ratio of names in the audit, the most products of a key's block and of a names' block.
AUDIT_RATIO, AUDIT_BLOCK, AUDIT_NAMES = 0.95, 100, 25


def audit_blocks(registry: DataFrame) -> DataFrame:
    """A prepared registry with the keys of the duplicate audit: one column a rule, null where it doesn't apply.

    Also names, the block of like names: brand, category and the name's first two words.
    """
    words = F.split("n_name", " ")

    def key(*columns: str, also: Column | None = None) -> Column:
        filled = F.lit(True) if also is None else also
        for c in columns:
            filled = filled & (F.coalesce(F.col(c), F.lit("")) != "")
        return F.when(filled, F.concat_ws("\x1f", *columns))

    return registry.withColumns({
        "SAME_BRAND_MODEL": key("n_brand", "n_model", also=F.length("n_model") >= 3), "SAME_BRAND_SUPPLIER_ARTICLE": key("n_brand", "n_article"),
        "MANUFACTURER_ARTICLE_BRAND": key("n_brand", "n_maker_article"), "EXACT_NORMALIZED_NAME_CATEGORY": key("category", "n_name"),
        "names": F.when((F.size(words) >= 2) & (F.coalesce(F.col("category"), F.lit("")) != "") & (F.col("n_brand") != ""), F.concat_ws("\x1f", "n_brand", "category", words[0], words[1])),
    })


def duplicate_candidates(registry: DataFrame, rules: Sequence[str], names: str, name: str, ratio: float = AUDIT_RATIO, block_rows: int = AUDIT_BLOCK, name_rows: int = AUDIT_NAMES) -> DataFrame:
    """(left, right, methods): products that may be one, by equal keys (a column a rule) or by like names of a block.

    registry: key and these columns. Names of a ratio of at least `ratio` say HIGH_NAME_SIMILARITY with the ratio.
    Blocks of more than block_rows (name_rows) products say nothing and are passed over, as the rule
    has it; so the pairs of a block are bounded.
    """

    def paired(keyed: DataFrame, most: int) -> DataFrame:
        sized = keyed.groupBy("_r", "_k").agg(F.count("*").alias("_n")).filter(F.col("_n").between(2, most)).select("_r", "_k")
        some = keyed.join(sized, ["_r", "_k"])
        other = some.select("_r", "_k", F.col("key").alias("right"), F.col("_name").alias("right_name"))
        return some.withColumnRenamed("key", "left").join(other, ["_r", "_k"]).filter(F.col("left") < F.col("right"))

    keys = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("r"), F.col(c).alias("k"))) for c in rules])))
    equal = paired(registry.select("key", keys.alias("_x"), F.lit("").alias("_name")).select("key", F.col("_x.r").alias("_r"), F.col("_x.k").alias("_k"), "_name"), block_rows)
    alike = paired(registry.filter(F.col(names).isNotNull()).select("key", F.lit("").alias("_r"), F.col(names).alias("_k"), F.col(name).alias("_name")), name_rows)
    alike = alike.withColumn("_ratio", similarity(F.col("_name"), F.col("right_name"))).filter(F.col("_ratio") >= ratio)
    alike = alike.select("left", "right", F.concat(F.lit("HIGH_NAME_SIMILARITY:"), F.format_string("%.4f", "_ratio")).alias("method"))
    found = equal.select("left", "right", F.col("_r").alias("method")).unionByName(alike)
    return found.groupBy("left", "right").agg(F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods"))
