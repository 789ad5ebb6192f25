"""Matching, identity, merges, quality, feed, checks, sources, sinks and streams on small inputs."""

from __future__ import annotations

import itertools
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.functions.text import normalize_text
from tallyforge.operators import checks, feed, identity, matching, merge, quality, relational
from tallyforge.sources import readers, writers

PRODUCT = "key bigint, name string, brand string, model string, supplier_article string, manufacturer_article string, category string, properties map<string,string>, supplier_code string, identifiers map<string,array<string>>, kind string"


def product(key, name, brand="Stalex", model="", **more):
    row = dict(key=key, name=name, brand=brand, model=model, supplier_article="", manufacturer_article="", category="", properties={}, supplier_code="", identifiers={}, kind="")
    row.update(more)
    return tuple(row.values())


def matched(spark, source, *registry):
    got = matching.match(spark.createDataFrame([source], PRODUCT), spark.createDataFrame(list(registry), PRODUCT)).collect()
    assert len(got) == 1
    return got[0]


def test_match_by_article_despite_stale_model(spark):
    source = product(297, "Тиски Jet PP-800F", "Jet", "PP-800F", supplier_article="508002", supplier_code="sup_a")
    target = product(88585, "Тиски Jet PP-800F поворотные", "Jet", "PP-600F", identifiers={"sup_a": ["508002"]})
    got = matched(spark, source, target)
    assert (got.status, got.method, got.candidate_key, got.auto_accepted) == ("CONFLICT", "SUPPLIER_ARTICLE_IDENTITY_CONFLICT", 88585, False) or (got.status, got.method) == ("EXACT_MATCH", "SUPPLIER_ARTICLE_EXACT")
    assert got.status == "EXACT_MATCH"


def test_match_rules(spark):
    name = "Токарный станок TU-2304"
    assert matched(spark, product(1, name, model="TU-2304"), product(2, name + " Stalex", model="TU2304"))[1:3] == ("HIGH_CONFIDENCE_MATCH", "BRAND_MODEL")
    assert matched(spark, product(1, name, model="TU-2304"), product(2, name, brand="Jet", model="TU2304")).status == "CONFLICT"
    got = matched(spark, product(1, name, model="TU-2304"), product(2, name, model="TU2304"), product(3, name, model="TU2304"))
    assert (got.status, got.method) == ("REVIEW", "NON_UNIQUE_STRONG_CANDIDATES")
    assert matched(spark, product(1, "Стойка", brand="Other"), product(2, name)).method == "NO_CANDIDATES"
    twice = {"sup": ["A1"]}
    got = matched(spark, product(1, name, supplier_article="a-1", supplier_code="sup"), product(2, name, identifiers=twice), product(3, name, identifiers=twice))
    assert got.method == "DUPLICATE_SUPPLIER_ARTICLE"
    got = matched(spark, product(1, name, model="X1", manufacturer_article="M5"), product(2, name, model="X1", manufacturer_article="m-5"))
    assert (got.status, got.method, got.confidence) == ("EXACT_MATCH", "MANUFACTURER_IDENTIFIER", 1.0)
    got = matched(spark, product(1, name, model="TU2304", properties={"length": "1 m"}), product(2, name, model="TU2304", properties={"length": "900 mm"}))
    assert got.status == "CONFLICT" and got.conflicts == ["property:length"]


def test_match_suffix_is_reviewed(spark):
    got = matched(spark, product(1, "Станок токарный универсальный TU2304", model="TU2304"), product(2, "Станок токарный универсальный TU2304V", model="TU2304V"))
    assert (got.status, got.method) == ("REVIEW", "BRAND_MODEL_IDENTITY_REVIEW")


def test_identity_classes(spark):
    sources = spark.createDataFrame([product(1, "Токарный станок TU-2304", model="TU2304"), product(2, "Губки для тисков PP-800F"), product(3, "Нечто"), product(4, "Тиски QM-16")], PRODUCT)
    registry = spark.createDataFrame([product(9, "Токарный станок TU-2304 Stalex", model="TU2304")], PRODUCT)
    matches, sources, registry = matching.resolve(sources, registry)
    got = {r.source_key: r.decision for r in identity.classify(matches, sources, registry).collect()}
    assert got == {1: "HIGH_CONFIDENCE_EXISTING", 2: "ACCESSORY_OR_COMPATIBILITY_ITEM", 3: "INSUFFICIENT_IDENTITY", 4: "SAFE_NEW_PRODUCT_CANDIDATE"}


def test_revalidated_links(spark):
    left = matching.prepare(spark.createDataFrame([product(1, "Станок TU2304", model="TU2304"), product(2, "Станок TU2304", model="TU2304")], PRODUCT))
    right = matching.prepare(spark.createDataFrame([product(8, "Станок TU2304", model="TU2304"), product(9, "Станок TU2304", model="TU9999")], PRODUCT))
    links = spark.createDataFrame([(1, 8, False, ""), (2, 9, False, ""), (2, 9, True, "")], "source_key bigint, candidate_key bigint, manual boolean, origin string")
    got = matching.revalidate(matching.assess(matching.pairs(left, right, links))).select("source_key", "manual", "method").collect()
    assert sorted(tuple(r) for r in got) == [(1, False, "EXISTING_LINK"), (2, False, "EXISTING_LINK_CONFLICT"), (2, True, "EXISTING_LINK_MANUAL")]


def test_second_merge_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, last_changed_at int")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    first = merge.merge_snapshot(old, new, ["k"], ["v"], F.lit(2))
    assert sorted(map(tuple, first.collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]
    again = merge.merge_snapshot(first, new, ["k"], ["v"], F.lit(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    states = merge.compare(first.select("k", "v"), new, ["k"], {"all": ["v"]}).select("k", "status").collect()
    assert sorted(map(tuple, states)) == [(1, "MISSING"), (2, "UNCHANGED"), (3, "UNCHANGED")]


def test_merge_helpers(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y")], "p int, v string")
    assert sorted(map(tuple, merge.replace_children(old, new, "p").collect())) == [(1, "x"), (2, "c"), (3, "y")]
    assert sorted(map(tuple, merge.insert_absent(old, new, ["p"]).collect())) == [(1, "a"), (1, "b"), (2, "c"), (3, "y")]
    hashes = spark.createDataFrame([("1", None), ("1", None), (None, "1")], "b string, a string").select(merge.group_hash(["b", "a"]).alias("h")).collect()
    assert hashes[0].h == hashes[1].h != hashes[2].h


def test_history_and_roles(spark):
    old, new = (spark.createDataFrame([(1, v, "s"), (k, "z", "s")], "k int, v string, s string") for k, v in ((2, "a"), (3, "b")))
    groups = {"value": ["v"], "state": ["s"]}
    rows = merge.history(merge.compare(old, new, ["k"], groups), ["k"], groups, F.lit(9)).collect()
    assert [(r.k, r.field_group, json.loads(r.old_value), json.loads(r.new_value)) for r in rows] == [(1, "value", {"v": "a"}, {"v": "b"})]
    urls = spark.createDataFrame([("u", "alias"), ("u", "source"), ("w", "odd")], "url string, role string")
    assert sorted(map(tuple, merge.latest_role(urls, ["url"], {"source": 0, "alias": 1}).collect())) == [("u", "source"), ("w", "odd")]


def folded_states(rows):
    """The fold in plain Python that missing_states() must equal."""
    misses = 0
    for evidence, guarded in rows:
        misses = 0 if evidence == "SEEN" else misses + (evidence in quality.CONFIRMED_MISSING and not guarded)
        yield misses, "MISSING_CANDIDATE" if misses >= 3 else "WARNING" if misses >= 2 else "WATCH" if misses else "ACTIVE"


def test_missing_states_equal_a_fold(spark):
    kinds = ["SEEN", "HTTP_404", "NOT_IN_SITEMAP", "TIMEOUT"]
    rows = [(k, n, e, g) for k, seq in enumerate(itertools.product(kinds, repeat=4)) for n, (e, g) in enumerate(zip(seq, (False, k % 3 == 0, False, False), strict=True))]
    df = spark.createDataFrame(rows, "k int, n int, evidence string, guarded boolean")
    got = {(r.k, r.n): (r.misses, r.state) for r in quality.missing_states(df, "k", ["n"]).collect()}
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        for n, state in enumerate(folded_states([(e, g) for _, _, e, g in group])):
            assert got[(k, n)] == state


def test_stream_equals_batch(spark, sf_dir):
    from tallyforge.plans.upkeep import missing_state, missing_state_stream

    batch = {(r.event_id, r.misses, r.state) for r in missing_state(spark, sf_dir).collect()}
    assert batch == {(r.event_id, r.misses, r.state) for r in missing_state_stream(spark, sf_dir).collect()}


def test_versioned_merge(spark):
    from tallyforge.streaming.missing import versioned_merge

    kept = {}
    run = versioned_merge(lambda n: kept.get(("current", n - 1)), lambda df, n, name: kept.__setitem__((name, n), df.cache()), ["k"], ["v"], F.lit(5))
    run(spark.createDataFrame([(1, "a")], "k int, v string"), 0)
    run(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, kept[("changes", 1)].collect())) == [(1, "CHANGED"), (2, "NEW")]
    assert sorted((r.k, r.v) for r in kept[("current", 1)].collect()) == [(1, "b"), (2, "c")]


def test_anomalies_and_health(spark):
    fill = "struct<products:bigint,price:double>"
    df = spark.createDataFrame([((74, 0.98), (1351, 0.98)), ((1300, 0.1), (1351, 0.98)), ((1300, 0.0), (1351, 0.6)), ((5, 0.0), None)], f"now {fill}, before {fill}")
    got = [r.x for r in df.select(quality.anomalies("now", "before", ["price"]).alias("x")).collect()]
    assert got == [["CRAWL_COUNT_COLLAPSE"], ["FIELD_COVERAGE_COLLAPSE:price"], ["FIELD_COVERAGE_COLLAPSE:price", "SCHEMA_SIGNAL:price"], []]
    health = spark.createDataFrame([(79, 100), (80, 100), (0, None), (5, 0)], "n int, b int").select(quality.discovery_health(F.col("n"), F.col("b")).alias("x")).collect()
    assert [r.x.anomalous for r in health] == [True, False, True, False]
    missed = spark.createDataFrame([(2, True, True, None), (2, True, False, None), (2, True, False, 404)], "m int, a boolean, h boolean, s int")
    assert [tuple(r.x) for r in missed.select(quality.next_missed(F.col("m"), F.col("a"), F.col("h"), F.col("s")).alias("x")).collect()] == [(3, False), (2, True), (3, False)]
    with pytest.raises(ValueError):
        quality.AnomalyLimits(count_ratio=0)


def test_feed_violations_and_values(spark):
    good = dict(
        catalog_product_id=1, selection_status="selected", selected_offer_id=5, offer_id=5, source_product_id=7, source_catalog_product_id=1, offer_supplier_id=2, source_supplier_id=2, match_status="EXACT_MATCH",
        match_catalog_product_id=1, supplier_enabled=True, source_active=True, offer_active=True, target_active=True, target_id="88", target_name="N", target_url="https://x.ru/1", category_id="3901", category_name="C",
        price=Decimal("339940.0000"), old_price=Decimal("400000.0000"), currency="RUB", availability="in_stock", quantity=Decimal("3.0000"), rule_version="v1", supplier_sku="S", supplier_external_id="E", target_article="A", target_brand="B",
    )
    bad = {**good, "catalog_product_id": 2, "price": Decimal(0), "currency": None, "target_url": "ftp://x", "availability": "discontinued", "target_active": None, "source_catalog_product_id": None, "match_catalog_product_id": 2}
    df = spark.createDataFrame([Row(**good), Row(**bad)])
    rows = {r.catalog_product_id: r.v for r in df.select("catalog_product_id", feed.row_violations(df).alias("v")).collect()}
    assert rows == {1: [], 2: ["SOURCE_CATALOG_PRODUCT_MISMATCH", "INACTIVE_OR_MISSING_TARGET_PRODUCT", "INVALID_TARGET_URL", "NON_POSITIVE_SELECTED_PRICE", "UNSUPPORTED_CURRENCY", "UNMAPPED_AVAILABILITY", "DISCONTINUED_SELECTED_OFFER"]}
    assert {r.code for r in feed.set_violations(df, 3).collect()} == {"DUPLICATE_FEED_OFFER_ID", "SELECTED_JOIN_CARDINALITY"}
    value = feed.feed_values(df.filter("catalog_product_id = 1")).first()
    assert (value.price, value.old_price, value.quantity, value.vendor_code, value.article, value.available) == ("339940", "400000", "3", "S", "A", "true")
    values = feed.feed_values(df.filter("catalog_product_id = 1"))
    once, twice = ("".join(feed.document(values, {"name": "Shop & Co"}, "2026-09-08 09:23")) for _ in range(2))
    assert once == twice and '<offer id="88" available="true">' in once and "Shop &amp; Co" in once
    assert feed.validate_document(values, values).count() == 0
    assert feed.validate_document(values.withColumn("price", F.lit("1")), values).first().problem == "DIFFERENT"


def test_plan_updates(spark):
    ddl = "id int, price decimal(18,4), availability string, current_price decimal(18,4), current_availability string, targets int, error string"
    one = Decimal(1)
    rows = [(1, one, "a", one, "a", 1, ""), (2, one, "a", Decimal(2), "a", 1, ""), (3, one, "a", one, "b", 1, None), (4, one, "a", None, "b", 1, ""), (5, one, "a", one, None, 1, ""), (6, one, "a", one, "a", 0, ""), (7, one, "a", one, "a", 2, ""), (8, one, "a", one, "a", 1, "HTTP")]
    df = spark.createDataFrame(rows, ddl)
    got = {r.id: (r.action, r.blocking_reason) for r in feed.plan_updates(df).collect()}
    assert got == {
        1: ("NO_CHANGE", ""), 2: ("WOULD_UPDATE_PRICE", ""), 3: ("WOULD_UPDATE_AVAILABILITY", ""), 4: ("WOULD_UPDATE_PRICE_AND_AVAILABILITY", ""), 5: ("BLOCKED_UNSUPPORTED_STATE", "CURRENT_AVAILABILITY_NOT_MAPPABLE"),
        6: ("BLOCKED_IDENTITY", "MISSING_TARGET"), 7: ("BLOCKED_IDENTITY", "AMBIGUOUS_TARGET"), 8: ("BLOCKED_IDENTITY", "HTTP"),
    }
    assert {r.action for r in feed.plan_updates(df.filter("id < 4"), ("unproven",)).collect()} == {"BLOCKED_IMPORT_CONTRACT"}


def test_relational_helpers(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("x",), ("1a",)], "i string")
    assert [r.i for r in ids.orderBy(*relational.numeric_first("i")).collect()] == ["9", "10", "1a", "x"]
    cyclic = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c"), (4, 99, "d")], "k int, p int, l string")
    assert relational.ancestors(cyclic, "k", "p", "l").groupBy("node").count().orderBy("node").collect() == [Row(node=1, count=2), Row(node=2, count=2), Row(node=3, count=1), Row(node=4, count=1)]
    chain = spark.createDataFrame([(i, i - 1) for i in range(40)], "k int, p int")
    assert {(r.node, r.origin, r.depth) for r in relational.origins(chain, "k", "p").collect()} == {(i, 0, i) for i in range(40)}
    with pytest.raises(ValueError):
        relational.origins(cyclic, "k", "p", rounds=5)
    with pytest.raises(ValueError):
        relational.page(ids, [F.col("i")], 0, 25)
    empty = ids.filter("false")
    assert [(r.present, r.missing, r.percent) for r in relational.coverage(empty, {"i": F.col("i").isNotNull()}).collect()] == [(0, 0, 0.0)]
    wild = spark.createDataFrame([("50%",), ("505",), (None,)], "s string")
    assert wild.filter(relational.contains_text(["s"], "50%")).count() == 1


def test_checks(spark):
    a, b = spark.createDataFrame([(1, 1), (1, None), (2, 5)], "k int, r int"), spark.createDataFrame([(1,)], "r int")
    got = {r.check_name: r.violations for r in checks.suite({"unique": checks.unique(a, ["k"]), "refs": checks.references(a, ["r"], b, ["r"]), "range": checks.must_hold(a, F.col("r") < 5), "one": checks.exactly_one(a, ["k", "r"])}).collect()}
    assert got == {"unique": 1, "refs": 1, "range": 1, "one": 2}


def test_review_candidates(spark):
    def pairs(*rows):
        return spark.createDataFrame(list(rows), "case_id int, candidate_id int")

    got = quality.review_candidates(pairs((1, 5)), pairs((1, 5), (1, 6)), pairs((1, 7), (1, 8)), pairs((1, 7))).collect()
    assert sorted((r.candidate_id, r.origin, r.rank) for r in got) == [(5, "explicit", 1), (6, "model", 2), (8, "brand", 3)]


PAGE = """<html><head><title> Тиски </title><script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"7","brand":{"name":"Jet"},"offers":{"price":"5","priceCurrency":"RUB","availability":"https://schema.org/InStock"}}]}</script></head>
<body><h1>Тиски <b>QM</b></h1><img src="/a.jpg"><a href="/x">x</a><span itemprop="sku">8</span></body></html>"""


def test_pages_and_urls(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("<h1>x</h1>" + '<a href="/y">y</a>' * 12,)], "html string")
    rows = [r.p for r in df.select(readers.parse_page("html").alias("p")).collect()]
    assert (rows[0].sku, rows[0].brand, rows[0].price, rows[0].availability, rows[0].heading, rows[0].page_type) == ("7", "Jet", "5", "InStock", "Тиски QM", "product")
    assert [r.page_type for r in rows[1:]] == ["other", "category"]
    urls = spark.createDataFrame([("HTTP://www.Shop.su//a//b?utm_source=x&q=1#f",), ("mailto:x",)], "u string")
    assert [r.x for r in urls.select(readers.normalize_url(F.col("u")).alias("x")).collect()] == ["https://shop.su/a/b?q=1", "mailto:x"]
    space = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    maps = spark.createDataFrame([(1, f"<urlset {space}><url><loc> https://a/2 </loc></url><url><loc>https://a/1</loc></url></urlset>"), (2, f"<urlset {space}><url><loc>https://a/0</loc></url><url><loc>https://a/2</loc></url></urlset>"), (3, f"<sitemapindex {space}><sitemap><loc>https://a/m.xml</loc></sitemap></sitemapindex>")], "n int, xml string")
    assert [(r.url, r.kind) for r in readers.sitemap_urls(maps, "n").orderBy("first").collect()] == [("https://a/2", "url"), ("https://a/1", "url"), ("https://a/0", "url"), ("https://a/m.xml", "sitemap")]
    left, right = (spark.createDataFrame([(u, [c])], "url string, collections array<string>") for u, c in (("a", "x"), ("a", "w")))
    assert readers.merge_discoveries(left, right).first().collections == ["w", "x"]


def test_registry_files(spark, tmp_path):
    row = {"id": 1, "name": "N", "brand": "B", "active": None, "properties": [{"property_code": "ARTIKUL_X", "property_name": "Art", "value_flat": "77"}, {"property_code": "L", "property_name": "Length", "value_flat": "5", "unit": "mm"}]}
    (tmp_path / "r.jsonl").write_text(json.dumps(row) + "\n" + json.dumps({**row, "id": 2, "active": False}) + "\n")
    registry = readers.read_registry(spark, str(tmp_path / "r.jsonl"))
    got = readers.matching_context(registry, {"ARTIKUL_X": "sup"}).collect()
    assert [(r.key, r.properties, r.identifiers) for r in got] == [(1, {"Art": "77", "Length": "5 mm"}, {"sup": ["77"]})]
    assert tuple(readers.article_coverage(registry).first()) == ("ARTIKUL_X", 2, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", [1, 2], None)], "k int, v string, l array<int>, session_token string")
    path = tmp_path / "out.csv"
    writers.write_csv(writers.without_secrets(df), path)
    assert path.read_bytes().startswith(b"\xef\xbb\xbfk,v,l\n") and readers.read_csv(spark, str(path)).first()["v"] == 'a,"b"'
    with pytest.raises(ValueError):
        writers.replace_file(path, ["broken"], lambda p: ["no"])
    assert path.read_bytes().startswith(b"\xef\xbb\xbfk") and len(list(tmp_path.iterdir())) == 1
    writers.write_json_report({"b": 1, "a": datetime(2026, 1, 1)}, tmp_path / "r.json")
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]
    assert "<l>1</l>" in writers.xml_rows(df.select("k", "l")).first().xml
    assert set(writers.product_sheets(df, {"media": df}, "k")) == {"products", "media"}


def test_guard(spark):
    rows, forbidden = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), spark.createDataFrame([(2, "y")], "a int, b string")
    assert feed.guard_leaks(rows, forbidden, ["a", "b"]).count() == 1


def test_duplicate_candidates(spark):
    rows = spark.createDataFrame([(1, "токарный станок tu", "x", "9"), (2, "токарный станок tu", "x", "9"), (3, "другое", "x", None)], "key int, name string, brand string, art string").withColumn("name", normalize_text(F.col("name")))
    got = matching.duplicate_candidates(rows, ["art"], "brand", "name").collect()
    assert [tuple(r) for r in got] == [(1, 2, "HIGH_NAME_SIMILARITY:1.0000;art")]
