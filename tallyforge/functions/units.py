"""Property values with units: normalization, comparison and mapping scores, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import decimal_of, first_match, fold, let

#: Unit spellings, and for each kind of value its units with factors and canonical unit.
SPELLINGS = {
    "в": "v", "v": "v", "вт": "w", "w": "w", "квт": "kw", "kw": "kw", "мм": "mm", "mm": "mm", "см": "cm", "cm": "cm", "м": "m", "m": "m",
    "г": "g", "g": "g", "кг": "kg", "kg": "kg", "т": "t", "t": "t", "мл": "ml", "ml": "ml", "л": "l", "l": "l", "м3": "m3", "m3": "m3",
    "об/мин": "rpm", "обмин": "rpm", "rpm": "rpm", "min-1": "rpm",
}
_LENGTHS = ({"mm": "1", "cm": "10", "m": "1000"}, "mm")
KINDS = {
    "voltage": ({"v": "1"}, "V"), "power": ({"w": "1", "kw": "1000"}, "W"), "length": _LENGTHS, "width": _LENGTHS, "height": _LENGTHS, "diameter": _LENGTHS,
    "weight": ({"g": "0.001", "kg": "1", "t": "1000"}, "kg"), "capacity": ({"ml": "0.001", "l": "1", "m3": "1000"}, "L"), "rpm": ({"rpm": "1"}, "rpm"),
}
#: Fixed values of the second normalizer: spellings, dimensions and factors to the base unit.
UNIT_NAMES = {
    "мм": "mm", "mm": "mm", "см": "cm", "cm": "cm", "м": "m", "m": "m", "г": "g", "g": "g", "кг": "kg", "kg": "kg", "вт": "W", "w": "W", "квт": "kW", "kw": "kW",
    "в": "V", "v": "V", "об/мин": "rpm", "rpm": "rpm", "м/мин": "m/min", "m/min": "m/min", "мм/мин": "mm/min", "mm/min": "mm/min", "°": "degrees", "град": "degrees", "degrees": "degrees",
}
DIMENSIONS = {"mm": "length", "cm": "length", "m": "length", "g": "mass", "kg": "mass", "W": "power", "kW": "power", "V": "voltage", "rpm": "rotation", "m/min": "speed", "mm/min": "speed", "degrees": "angle"}
FACTORS = {"mm": "1", "cm": "10", "m": "1000", "g": "1", "kg": "1000", "W": "1", "kW": "1000", "V": "1", "rpm": "1", "m/min": "1000", "mm/min": "1", "degrees": "1"}

NUMBER = "decimal(38,9)"


@dataclass(frozen=True)
class PropertyPolicy:
    """How a property compares: its kind, whether a difference tells products apart, and tolerances."""

    kind: str = "string"
    importance: str = "NON_IDENTITY"
    absolute: str = "0"
    relative: str = "0"


#: The default policies.
POLICIES = {
    **{k: PropertyPolicy(k, "IDENTITY_CRITICAL") for k in ("voltage", "power", "length", "width", "height", "diameter", "capacity", "execution")},
    "weight": PropertyPolicy("weight", "SUPPORTING", absolute="1"),
}


def _pick(values: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def normalize_property(value: Column, kind: str) -> Column:
    """A struct of number, unit (canonical), text (if there is no number), and the unit as written."""
    return let(fold(value.cast("string")), lambda low: _normalized(low, kind))


def _normalized(low: Column, kind: str) -> Column:
    nothing, no_text = F.lit(None).cast(NUMBER), F.lit(None).cast("string")

    def made(number: Column, unit: Column, text: Column, written: Column) -> Column:
        return F.struct(number.alias("number"), unit.alias("unit"), text.alias("text"), written.alias("written"))

    if kind == "thread_range":
        tight = F.regexp_replace(low, " ", "")
        found = F.regexp_replace(F.regexp_extract(tight, r"m(\d+(?:[.,]\d+)?)-m?(\d+(?:[.,]\d+)?)", 0), r"^m|-m?", " ")
        ends = F.split(F.trim(F.translate(found, ",", ".")), " ")
        text = F.when(F.size(ends) == 2, F.concat(F.lit("m"), F.get(ends, F.lit(0)), F.lit("-m"), F.get(ends, F.lit(1)))).otherwise(F.nullif(tight, F.lit("")))
        return made(nothing, no_text, text, no_text)
    if kind in ("dimension", "range"):
        plain = F.translate(low, "×х", "xx")
        numbers = F.regexp_extract_all(plain, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
        written = F.coalesce(_pick(SPELLINGS, F.regexp_extract(plain, r"(?:^|\s)(mm|cm|m|мм|см|м)(?:\s|$)", 1)), F.lit("mm"))
        factor = _pick(_LENGTHS[0], written).cast(NUMBER)
        parts = F.transform(numbers, lambda n: F.regexp_replace(F.regexp_replace((decimal_of(n) * factor).cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
        known = F.size(numbers) > 0
        return made(nothing, F.when(known, F.lit("mm")), F.when(known, F.array_join(parts, "x")).otherwise(F.nullif(plain, F.lit(""))), F.when(known, written))
    if kind in KINDS:
        factors, canonical = KINDS[kind]
        shape = r"^([+-]?\d+(?:[.,]\d+)?)\s*([a-zа-я0-9³]+)$"
        number, raw = decimal_of(F.regexp_extract(low, shape, 1)), F.translate(F.regexp_extract(low, shape, 2), "³", "3")
        factor = _pick(factors, _pick(SPELLINGS, raw)).cast(NUMBER)
        one = made(
            F.when(factor.isNotNull(), (number * factor).cast(NUMBER)), F.when(factor.isNotNull(), F.lit(canonical)),
            F.when(factor.isNull(), F.nullif(low, F.lit(""))), F.nullif(raw, F.lit("")),
        )
        if kind != "voltage":
            return one
        several = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.translate(n, ",", "."))))
        many = low.rlike(r"(?U)/|\bor\b|\bили\b") & (F.size(several) > 0)
        return F.when(many, made(nothing, F.lit("V"), F.array_join(several, "|"), F.lit("v"))).otherwise(one)
    return made(nothing, no_text, F.nullif(F.regexp_replace(low, "[^a-zа-я0-9]", ""), F.lit("")), no_text)


def _terms(policy: PropertyPolicy, name: str = "") -> Column:
    """A policy as a struct of literals."""
    return F.struct(
        F.lit(name).alias("name"), F.lit(policy.kind).alias("kind"), F.lit(policy.importance).alias("importance"),
        F.lit(policy.absolute).cast(NUMBER).alias("absolute"), F.lit(policy.relative).cast(NUMBER).alias("relative"),
    )


def _compared(left: Column, right: Column, terms: Column, kinds: Sequence[str]) -> Column:
    """The class of a comparison under a policy struct, whose kind is one of kinds."""

    def side(value: Column) -> Column:
        def made(low: Column) -> Column:
            rules = [(terms["kind"] == kind, _normalized(low, kind)) for kind in kinds[1:]]
            normalized = _normalized(low, kinds[0])
            for test, other in rules:
                normalized = F.when(test, other).otherwise(normalized)
            return F.struct(normalized.alias("n"), low.alias("folded"), value.alias("raw"))

        return let(fold(value), made)

    both = F.transform(F.array(left.cast("string"), right.cast("string")), side)
    return let(both, lambda x: _classified(F.get(x, F.lit(0)), F.get(x, F.lit(1)), terms))


def compare_property(left: Column, right: Column, name: str, policies: Mapping[str, PropertyPolicy] | None = None) -> Column:
    """The class of a comparison: equal in one of four ways, warning, or conflict of identity."""
    policy = {**POLICIES, **(policies or {})}.get(name.strip().lower(), PropertyPolicy())
    return _compared(left, right, _terms(policy), [policy.kind])


def compare_properties(left: Column, right: Column, policies: Mapping[str, PropertyPolicy], prefix: str = "") -> Column:
    """Array of (name, class) of the named properties that both maps fill, by name.

    One expression over an array of policies, so that the plan doesn't grow with them.
    """
    kinds = sorted({p.kind for p in policies.values()})
    entries = F.transform(
        F.array(*[_terms(policies[name], name) for name in sorted(policies)]),
        lambda p: F.struct(p.alias("p"), F.coalesce(F.try_element_at(left, p["name"]), F.lit("")).alias("a"), F.coalesce(F.try_element_at(right, p["name"]), F.lit("")).alias("b")),
    )
    filled = F.filter(entries, lambda e: (e["a"] != "") & (e["b"] != ""))
    return F.transform(filled, lambda e: F.struct(F.concat(F.lit(prefix), e["p"]["name"]).alias("name"), _compared(e["a"], e["b"], e["p"], kinds).alias("class")))


def _voltages(side: Column) -> Column:
    """The set of voltages a normalized value names."""
    number = F.regexp_replace(F.regexp_replace(side["number"].cast("string"), "0+$", ""), r"\.$", "")
    return F.filter(F.when(side["number"].isNotNull(), F.array(number)).otherwise(F.split(F.coalesce(side["text"], F.lit("")), r"\|")), lambda v: v != "")


def _classified(left: Column, right: Column, terms: Column) -> Column:
    a, b = left["n"], right["n"]
    gap = F.abs(a["number"] - b["number"])
    allowed = F.greatest(terms["absolute"], (F.greatest(F.abs(a["number"]), F.abs(b["number"])) * terms["relative"]).cast(NUMBER))
    clash = F.when(terms["importance"] == "IDENTITY_CRITICAL", "PROPERTY_IDENTITY_CONFLICT").otherwise("PROPERTY_DATA_QUALITY_WARNING")
    either = (terms["kind"] == "voltage") & (a["text"].isNotNull() | b["text"].isNotNull())
    same_set = F.when(F.array_sort(_voltages(a)) == F.array_sort(_voltages(b)), "PROPERTY_EQUAL").otherwise("PROPERTY_WITHIN_TOLERANCE")
    numbers = a["number"].isNotNull() & b["number"].isNotNull() & a["unit"].eqNullSafe(b["unit"])
    same = F.when(~a["written"].eqNullSafe(b["written"]), "PROPERTY_UNIT_VARIATION").when(left["folded"] != right["folded"], "PROPERTY_FORMAT_VARIATION").otherwise("PROPERTY_EQUAL")
    texts = a["text"].isNotNull() & b["text"].isNotNull()
    return first_match([
        (either & (F.size(F.array_intersect(_voltages(a), _voltages(b))) > 0), same_set),
        (numbers & (gap == 0), same), (numbers & (gap <= allowed), F.lit("PROPERTY_WITHIN_TOLERANCE")), (numbers, clash),
        (texts & (a["text"] == b["text"]), F.when(~left["raw"].eqNullSafe(right["raw"]), "PROPERTY_FORMAT_VARIATION").otherwise("PROPERTY_EQUAL")), (texts, clash),
    ], "PROPERTY_DATA_QUALITY_WARNING")


def compatible(comparison: Column) -> Column:
    return comparison != "PROPERTY_IDENTITY_CONFLICT"


def to_unit(value: Column, unit: Column, target: Column) -> Column:
    """A struct of the value in the target unit and a status; the value only where it is NORMALIZED."""
    source, goal = _pick(UNIT_NAMES, F.lower(F.trim(unit))), F.coalesce(_pick(UNIT_NAMES, F.lower(F.trim(target))), F.trim(target))
    number = F.translate(F.trim(value), ", ", ".").try_cast(NUMBER)
    from_kind, to_kind = _pick(DIMENSIONS, source), _pick(DIMENSIONS, goal)
    status = first_match(
        [(number.isNull(), F.lit("INVALID_NUMERIC")), (from_kind.isNull() | to_kind.isNull(), F.lit("UNKNOWN_UNIT")), (from_kind != to_kind, F.lit("INCOMPATIBLE_DIMENSION"))],
        "NORMALIZED",
    )
    made = F.try_divide((number * _pick(FACTORS, source).cast("decimal(10,0)")).cast("decimal(38,9)"), _pick(FACTORS, goal).cast("decimal(10,0)")).cast(NUMBER)
    return F.struct(F.when(status == "NORMALIZED", made).alias("value"), goal.alias("unit"), status.alias("status"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zа-я0-9]+)"), F.lit(1)))


def mapping_score(source: Column, candidate: Column, unit_ok: Column, category_ok: Column) -> Column:
    """Confidence that two property names mean the same: shared words, unit, category (.65, .25, .10)."""
    a, b = tokens(source), tokens(candidate)
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    return 0.65 * shared + 0.25 * unit_ok.cast("int") + 0.10 * category_ok.cast("int")


__all__ = ["DIMENSIONS", "FACTORS", "KINDS", "POLICIES", "PropertyPolicy", "compare_properties", "compare_property", "compatible", "mapping_score", "normalize_property", "to_unit", "tokens"]
