"""Normalization, models, taxonomy and units on titles that the test tables don't hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import taxonomy, units
from tallyforge.functions.models import Title, extract_model, model_evidence, model_tokens, similarity
from tallyforge.functions.text import availability_of, decimal_of, normalize_brand, normalize_model, normalize_text, normalized_name, plain_decimal, price_of, same_parts, short_suffix, unit_of_name


def one(spark, column, *values):
    """A column expression over rows of text columns a, b, c."""
    names = "abc"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


def test_normalize_text(spark):
    assert one(spark, normalize_text(F.col("a")), " ﬁЁ – Ⅳ  x ") == "fiе - iv x"
    assert one(spark, normalize_text(F.col("a")), None) == ""


def test_brand_and_model(spark):
    assert one(spark, normalize_brand(F.col("a")), " JET  Tools ") == "jet"
    assert one(spark, normalize_brand(F.col("a")), "СТАЛЕКС") == "stalex"
    got = one(spark, normalize_model(F.col("a"), F.col("b")), "Stalex ТВ-16X", "Stalex")
    assert got.model == "tb16x" and got.flags == ["CYRILLIC_LATIN_MODEL_VARIATION", "MODEL_CONTAINS_BRAND_PREFIX"]
    assert one(spark, normalized_name(F.col("a")), "Стол 10×20 х5") == "стол 10x20 x5"


@pytest.mark.parametrize(
    "title, model, models",
    [
        ("Станок DH 35V", "dh35v", ["35v"]), ("Станок TU 2304 V", "tu2304v", ["tu2304"]), ("Тиски PP-800F NEW", "pp800fnew", ["pp800fnew"]),
        ("Опора", "", []), (None, "", []), ("BF 20L и D240", "bf20l", ["20l", "d240"]),
    ],
)
def test_models(spark, title, model, models):
    assert one(spark, extract_model(F.col("a")), title) == model
    assert one(spark, model_tokens(F.col("a")), title) == models
    assert Title(title).model() == model


def test_model_evidence(spark):
    got = one(spark, model_evidence(F.col("a")), "Губки для тисков PP-800F new")
    assert (got.base, got.qualifier, got.ownership, got.accessory_head) == ("pp800f", "new", "REFERENCE_COMPATIBILITY", "губки")


def test_similarity(spark):
    assert one(spark, similarity(F.col("a"), F.col("b")), "abcd", "bcde") == pytest.approx(0.75)


@pytest.mark.parametrize(
    "name, category, kind",
    [
        ("Губки для тисков", "", "jaw"), ("Токарный станок по дереву", "", "lathe"), ("Станок для заточки дисков", "", "grinder"), ("Диск для станка", "", "disk"),
        ("Нечто", "Тиски", "vise"), ("Нечто", "", "unknown"), (None, None, "unknown"), ("Milling machine", "", "milling_machine"),
    ],
)
def test_kinds(spark, name, category, kind):
    assert one(spark, taxonomy.product_kind(F.col("a"), F.col("b")), name, category).kind == kind


def test_model_roles(spark):
    role = one(spark, taxonomy.model_role(F.col("a"), F.col("b"), F.col("c")), "Губки для тисков PP-800F", "", "")
    assert (role.role, role.reference, role.parent_kind) == ("REFERENCE_MODEL", "pp800f", "vise")
    role = one(spark, taxonomy.model_role(F.col("a"), F.col("b"), F.col("c")), "Токарный станок TU-2304", "", "")
    assert (role.role, role.own) == ("OWN_MODEL", "tu2304")
    assert one(spark, taxonomy.model_role(F.col("a"), F.col("b"), F.col("c")), "Тиски", "", "").role == "UNKNOWN_MODEL_ROLE"


def test_canonical_properties(spark):
    df = spark.createDataFrame([({"Мощность двигателя, кВт": "1.5", "Напряжение": "380", "Voltage": "220 V", "Цвет": "red"},)], "p map<string,string>")
    assert df.select(taxonomy.canonical_properties(F.col("p")).alias("x")).first().x == {"motor_power": "1.5 kW", "voltage": "380 V"}


@pytest.mark.parametrize(
    "name, left, right, expected",
    [
        ("voltage", "380 В", "380V", "PROPERTY_UNIT_VARIATION"), ("power", "7,5 кВт", "7.5 kW", "PROPERTY_UNIT_VARIATION"), ("power", "7.5 kW", "7500 W", "PROPERTY_UNIT_VARIATION"),
        ("length", "2500 mm", "2.5 m", "PROPERTY_UNIT_VARIATION"), ("length", "2500 mm", "3200 mm", "PROPERTY_IDENTITY_CONFLICT"), ("weight", "820 kg", "821 kg", "PROPERTY_WITHIN_TOLERANCE"),
        ("weight", "820 kg", "1200 kg", "PROPERTY_DATA_QUALITY_WARNING"), ("voltage", "220/380 V", "380 V", "PROPERTY_WITHIN_TOLERANCE"), ("voltage", "220/380", "380 или 220", "PROPERTY_EQUAL"),
        ("colour", "Red", "red!", "PROPERTY_FORMAT_VARIATION"), ("colour", "red", "blue", "PROPERTY_DATA_QUALITY_WARNING"), ("length", None, "5 mm", "PROPERTY_DATA_QUALITY_WARNING"),
    ],
)
def test_property_goldens(spark, name, left, right, expected):
    assert one(spark, units.compare_property(F.col("a"), F.col("b"), name), left, right) == expected


@pytest.mark.parametrize("value, kind, text", [("10×20 см", "dimension", "100x200"), ("M6 - M16", "thread_range", "m6-m16"), ("1,5-3 мм", "range", "1.5x3"), ("", "dimension", None)])
def test_normalize_property(spark, value, kind, text):
    assert one(spark, units.normalize_property(F.col("a"), kind), value).text == text


@pytest.mark.parametrize("row, value, status", [(("0.75", "kW", "W"), 750, "NORMALIZED"), (("3", "cm", "мм"), 30, "NORMALIZED"), (("1500", "об/мин", "rpm"), 1500, "NORMALIZED"), (("x", "kg", "g"), None, "INVALID_NUMERIC"), (("1", "kg", "mm"), None, "INCOMPATIBLE_DIMENSION"), (("1", "stone", "mm"), None, "UNKNOWN_UNIT")])
def test_to_unit(spark, row, value, status):
    got = one(spark, units.to_unit(F.col("a"), F.col("b"), F.col("c")), *row)
    assert got.status == status and (None if got.value is None else float(got.value)) == value


def test_small_functions(spark):
    assert str(one(spark, price_of(F.col("a")), "от 12 500,5 руб.")) == "12500.50"
    assert one(spark, price_of(F.col("a")), "0 ₽") is None
    assert tuple(one(spark, availability_of(F.col("a")), "В наличии 7 шт")) == ("in_stock", 7)
    assert tuple(one(spark, availability_of(F.col("a")), "?")) == (None, None)
    assert one(spark, unit_of_name(F.col("a")), "Длина, мм") == "мм" and one(spark, unit_of_name(F.col("a")), "Длина") is None
    assert float(one(spark, decimal_of(F.col("a")), "1 234,5")) == 1234.5 and one(spark, decimal_of(F.col("a")), "n/a") is None
    assert one(spark, plain_decimal(F.col("a").cast("decimal(18,4)")), "1500.5000") == "1500.5" and one(spark, plain_decimal(F.col("a").cast("decimal(18,4)")), "100") == "100"
    assert one(spark, same_parts(F.col("a"), F.col("b")), "ab12cd", "cd12ab") and one(spark, short_suffix(F.col("a"), F.col("b")), "tu2304", "tu2304v")
    assert not one(spark, short_suffix(F.col("a"), F.col("b")), "tu2304", "tu2304new")
