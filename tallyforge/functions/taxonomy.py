"""Product kinds, compatibility wording, model roles and canonical property names, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.models import QUALIFIERS, extract_model, model_tokens
from tallyforge.functions.text import compact, first_match, fold, let, normalize_text

#: Kinds in order of precedence, with their word patterns and families.
KINDS = (
    ("jaw", (r"\bгубк\w*\b", r"\bjaws?\b"), "accessory"),
    ("handle", (r"\bручк\w*\b", r"\bрукоят\w*\b", r"\bhandles?\b"), "accessory"),
    ("controller", (r"\bконтроллер\w*\b", r"\bпульт\w*\b", r"\bблок\s+управлен\w*\b"), "accessory"),
    ("collet", (r"\bцанг\w*\b", r"\bcollets?\b"), "tooling"),
    ("chuck", (r"\bпатрон\w*\b", r"\bchucks?\b"), "tooling"),
    ("disk", (r"\bдиск\w*\b", r"\bкруг\w*\b", r"\bcbn\b", r"\bsdc\b"), "consumable"),
    ("table", (r"\bстол\w*\b", r"\btables?\b"), "accessory"),
    ("stand", (r"\bподставк\w*\b", r"\bстойк\w*\b", r"\bосновани\w*\b", r"\bstands?\b"), "accessory"),
    ("fixture", (r"\bприспособлен\w*\b", r"\bоснастк\w*\b", r"\bоправк\w*\b", r"\bдержател\w*\b", r"\bfixtures?\b"), "tooling"),
    ("vise", (r"\bтиск\w*\b", r"\bvises?\b", r"\bvices?\b"), "equipment"),
    ("manipulator", (r"\bманипулятор\w*\b", r"\bманипуляцион\w*\b"), "equipment"),
    ("lathe", (r"\bтокарн\w*\b", r"\blathes?\b"), "machine"),
    ("milling_machine", (r"\bфрезерн\w*\s+стан\w*\b", r"\bстан\w*\s+фрезерн\w*\b", r"\bmilling\s+machines?\b"), "machine"),
    ("drill_press", (r"\bсверлил\w*\s+стан\w*\b", r"\bстан\w*\s+сверлил\w*\b", r"\bdrill\s+press\w*\b"), "machine"),
    ("grinder", (r"\bзаточн\w*\s+стан\w*\b", r"\bстан\w*.*\bзаточ\w*\b", r"\bшлифовальн\w*\s+стан\w*\b", r"\bстан\w*\s+шлифовальн\w*\b", r"\bнаждак\w*\b", r"\bgrinders?\b"), "machine"),
    ("beveling_machine", (r"\bфаскоснимател\w*\b", r"\bстан\w*.*сняти\w*\s+фаск\w*\b"), "machine"),
    ("machine", (r"\bстан(?:ок|ки|ка|ком|ке)\b", r"\bmachines?\b"), "machine"),
    ("accessory", (r"\bаксессуар\w*\b", r"\bкомплект\w*\b", r"\bпринадлежност\w*\b"), "accessory"),
    ("tool", (r"\bинструмент\w*\b", r"\bфрез\w*\b", r"\bсверл\w*\b", r"\bрезц\w*\b"), "tooling"),
    ("consumable", (r"\bрасходн\w*\b", r"\bабразив\w*\b"), "consumable"),
)
FAMILY = {kind: family for kind, _, family in KINDS}
ACCESSORY_FAMILIES = ("accessory", "tooling", "consumable")
#: Wordings that say a product fits another one.
MARKERS = (
    r"\bсовместим\w*\s+с\b", r"\bподходит\s+для\b", r"\bдля\s+модел\w*\b", r"\bдля\s+стан\w*\b", r"\bдля\s+тиск\w*\b", r"\bдля\s+манипулятор\w*\b",
    r"\bкомплект\s+для\b", r"\bоснастк\w*\s+для\b", r"\bгубк\w*\s+для\b", r"\bручк\w*\s+для\b", r"\bконтроллер\w*\s+для\b", r"\bдиск\w*\s+для\b",
    r"\bпатрон\w*\s+для\b", r"\bцанг\w*\s+для\b", r"\bдля\b", r"\bпод\b", r"\bк\b",
)
#: Canonical property names in order of precedence, with their patterns.
PROPERTY_NAMES = (
    ("max_turning_diameter", (r"макс\w*.*диаметр.*(?:обработ|точен|над стан)", r"diameter over")),
    ("distance_between_centers", (r"расстояни\w*.*между центр", r"distance between centers")),
    ("spindle_bore", (r"отверсти\w*.*шпиндел", r"spindle bore")),
    ("spindle_taper", (r"конус\w*.*шпиндел", r"spindle taper")),
    ("motor_power", (r"мощност\w*.*(?:двигател|электродвигател)", r"motor power")),
    ("voltage", (r"напряжени\w*", r"voltage")),
    ("machine_mode", (r"(?:тип|управлен).*чпу", r"cnc|manual")),
    ("table_size", (r"размер\w*.*стол", r"table size")),
    ("travel_x", (r"(?:ход|перемещени).*\bx\b",)),
    ("travel_y", (r"(?:ход|перемещени).*\by\b",)),
    ("travel_z", (r"(?:ход|перемещени).*\bz\b",)),
    ("spindle_speed", (r"частот\w*.*вращени", r"число оборот", r"spindle speed")),
    ("max_drilling_diameter", (r"макс\w*.*диаметр.*сверл", r"drilling diameter")),
    ("spindle_travel", (r"ход\w*.*шпиндел", r"spindle travel")),
    ("jaw_width", (r"ширин\w*.*губ", r"jaw width")),
    ("clamping_range", (r"(?:раствор|раскрыти|диапазон зажим)", r"clamping range")),
    ("vise_type", (r"тип\w*.*тиск", r"vise type")),
    ("thread_range", (r"диапазон\w*.*резьб", r"thread range")),
    ("drive_type", (r"электрическ|пневматическ", r"drive type")),
    ("working_radius", (r"рабоч\w*.*радиус", r"working radius")),
    ("tool_range", (r"диапазон\w*.*(?:заточ|обработ|инструмент)", r"tool range")),
    ("wheel_size", (r"размер\w*.*(?:круг|диск)", r"wheel size")),
    ("physical_size", (r"размер\w*", r"диаметр\w*", r"ширин\w*", r"длин\w*")),
)
#: The canonical properties that tell products of a kind apart.
PROFILES = {
    "lathe": ("max_turning_diameter", "distance_between_centers", "spindle_bore", "spindle_taper", "motor_power", "voltage", "machine_mode"),
    "milling_machine": ("table_size", "travel_x", "travel_y", "travel_z", "spindle_taper", "spindle_speed", "motor_power", "machine_mode"),
    "drill_press": ("max_drilling_diameter", "spindle_taper", "spindle_travel", "motor_power", "voltage"),
    "vise": ("jaw_width", "clamping_range", "vise_type"),
    "manipulator": ("thread_range", "drive_type", "voltage", "working_radius"),
    "grinder": ("tool_range", "wheel_size", "motor_power", "voltage"),
}
_MACHINE_WORD = r"\bстан(?:ок|ки|ка|ком|ке)\b"
_MACHINES = ("lathe", "milling_machine", "drill_press", "grinder", "beveling_machine", "machine")


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern occurs, with Unicode word characters and case folding."""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def _kind_in(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    return first_match([(matches(text, p), F.lit(k)) for k, p, _ in KINDS if kinds is None or k in kinds])


def _kind_in_any(text: Column) -> Column:
    return _kind_in(text)


def marker_start(text: Column) -> Column:
    """1-based start of the earliest compatibility wording in a folded text; null if there is none."""
    return F.array_min(F.array(*[F.nullif(F.regexp_instr(text, F.lit(f"(?iU){m}")), F.lit(0)) for m in MARKERS]))


def marker_text(text: Column) -> Column:
    """The earliest compatibility wording (the first pattern of those that start together)."""
    start = marker_start(text)
    at = first_match([(F.regexp_instr(text, F.lit(f"(?iU){m}")) == start, F.regexp_extract(text, f"(?iU)({m})", 1)) for m in MARKERS])
    return F.coalesce(at, F.lit(""))


def product_kind(name: Column, category: Column, unicode: bool = True) -> Column:
    """A struct of kind, and where it was found: the machine's name, head, name, category, none."""

    def levels(x: Column) -> Column:
        head = F.when(x["start"].isNull(), x["title"]).otherwise(F.substring(x["title"], F.lit(1), x["start"] - 1))
        machine = let(head, lambda h: F.when(matches(h, (_MACHINE_WORD,)), _kind_in(x["title"], _MACHINES)))
        kinds = F.transform(F.array(head, x["title"], x["rest"]), _kind_in_any)
        names = ("machine_name", "name_head", "name", "category")
        return let(F.concat(F.array(machine), kinds), lambda k: F.struct(
            F.coalesce(*[F.get(k, F.lit(n)) for n in range(4)], F.lit("unknown")).alias("kind"), first_match([(F.get(k, F.lit(n)).isNotNull(), F.lit(name)) for n, name in enumerate(names)], "none").alias("source"),
        ))

    whole = F.struct(normalize_text(name, unicode).alias("title"), normalize_text(category, unicode).alias("rest"))
    return let(whole, lambda x: let(F.struct(x["title"].alias("title"), x["rest"].alias("rest"), marker_start(x["title"]).alias("start")), levels))


def family_of(kind: Column) -> Column:
    return first_match([(kind == k, F.lit(f)) for k, f in FAMILY.items()], "unknown")


def _real(models: Column) -> Column:
    """Models without measures and thread ranges."""
    return F.filter(models, lambda m: ~m.rlike(r"^(m\d+m\d+|\d+(mm|cm|kw|w|v|rpm))$"))


def model_role(name: Column, category: Column, model: Column, unicode: bool = True, inferred: Column | None = None, named: Column | None = None, kind: Column | None = None) -> Column:
    """A struct: OWN_MODEL, REFERENCE_MODEL or UNKNOWN_MODEL_ROLE, with own and reference model and parent kind.

    inferred, named and kind are the name's model, models and product kind, where they are known already.
    """
    marked = let(normalize_text(name, unicode), lambda t: F.struct(t.alias("title"), marker_start(t).alias("start"), marker_text(t).alias("marker")))
    tail = let(marked, lambda m: F.when(m["start"].isNotNull(), F.substring(m["title"], m["start"] + F.length(m["marker"]), F.length(m["title"]))).otherwise(""))
    facts = F.struct(
        marked.alias("m"), (product_kind(name, category, unicode)["kind"] if kind is None else kind).alias("kind"), compact(normalize_text(model, unicode)).alias("explicit"),
        (extract_model(name) if inferred is None else inferred).alias("inferred"), (model_tokens(name) if named is None else named).alias("named"),
        _real(model_tokens(tail)).alias("tail_models"), product_kind(tail, F.lit(""), unicode=False)["kind"].alias("parent"),
    )

    def roles(x: Column) -> Column:
        fits = family_of(x["kind"]).isin(*ACCESSORY_FAMILIES) | (family_of(x["parent"]).isin("equipment", "machine") & (x["parent"] != x["kind"]))
        models = F.array_distinct(F.concat(_real(F.filter(F.array(x["explicit"], x["inferred"]), lambda m: m != "")), _real(x["named"])))
        return F.struct(x.alias("x"), (x["m"]["start"].isNotNull() & (F.size(x["tail_models"]) > 0) & fits).alias("refers"), models.alias("models"))

    def decided(y: Column) -> Column:
        x, refers = y["x"], y["refers"]
        reference = F.when(refers, F.element_at(x["tail_models"], -1)).otherwise("")
        other = F.get(F.filter(y["models"], lambda m: m != reference), F.lit(0))
        own = F.coalesce(F.when(refers, other).otherwise(F.coalesce(F.nullif(x["explicit"], F.lit("")), F.nullif(x["inferred"], F.lit("")), F.get(y["models"], F.lit(0)))), F.lit(""))
        role = F.when(refers, "REFERENCE_MODEL").when(own != "", "OWN_MODEL").otherwise("UNKNOWN_MODEL_ROLE")
        parent, marker = (F.when(refers, v).otherwise("") for v in (x["parent"], x["m"]["marker"]))
        return F.struct(role.alias("role"), own.alias("own"), reference.alias("reference"), parent.alias("parent_kind"), marker.alias("marker"), y["models"].alias("models"))

    return let(let(facts, roles), decided)


def execution_words(model: Column) -> Column:
    return F.array_sort(F.filter(F.array(*[F.lit(q) for q in QUALIFIERS]), lambda q: model.endswith(q)))


def canonical_property(name: Column, unicode: bool = True) -> Column:
    """The canonical name of a property; empty if no pattern knows it."""
    return let(normalize_text(name, unicode), lambda text: first_match([(matches(text, p), F.lit(n)) for n, p in PROPERTY_NAMES], ""))


def canonical_properties(properties: Column) -> Column:
    """A map of raw names and values to canonical names; the first filled value wins; units are added."""
    def render(entry: Column) -> Column:
        return let(F.struct(canonical_property(entry["key"], unicode=False).alias("name"), fold(entry["key"]).alias("raw"), F.coalesce(entry["value"], F.lit("")).alias("value"), fold(entry["value"]).alias("low")), with_unit)

    def with_unit(x: Column) -> Column:
        text = (
            F.when((x["name"] == "voltage") & ~x["low"].rlike(r"(?:^|\s)(?:v|в)(?:\s|$)"), F.concat(x["value"], F.lit(" V")))
            .when((x["name"] == "motor_power") & ~x["low"].rlike(r"(?:^|\s)(?:w|kw|вт|квт)(?:\s|$)"), F.concat(x["value"], F.when(x["raw"].contains("квт"), F.lit(" kW")).otherwise(F.lit(" W"))))
            .otherwise(x["value"])
        )
        return F.struct(x["name"].alias("key"), F.when(x["value"] != "", text).alias("value"))

    entries = F.filter(F.transform(F.map_entries(properties), render), lambda e: (e["key"] != "") & e["value"].isNotNull())
    def first_of_each(e: Column) -> Column:
        keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(e, lambda x: x["key"] == k), F.lit(0))["value"].alias("value")))

    return F.map_from_entries(let(entries, first_of_each))


def profile_of(kind: Column) -> Column:
    """The canonical properties that are critical for a kind."""
    rules = [(kind == k, F.array(*[F.lit(p) for p in ps])) for k, ps in PROFILES.items()]
    rules.append((family_of(kind).isin(*ACCESSORY_FAMILIES), F.array(F.lit("physical_size"))))
    rest = F.array().cast("array<string>")
    return reduce(lambda other, rule: F.when(rule[0], rule[1]).otherwise(other), reversed(rules), rest)
