"""Listings, links, trees, schedules, strict pages, snapshots of sources: what the test tables don't hold."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.operators import integrity, links, listing, matching, merge, relational, reports, review, tree
from tallyforge.session import shared_folder
from tallyforge.sources import pages, readers, writers


@pytest.mark.parametrize("wrong", [{"page": 0}, {"page_size": 30}, {"decision": "X"}, {"issue": "without_soul"}])
def test_filters_are_checked(spark, wrong):
    with pytest.raises(ValueError, match="invalid"):
        listing.ProductFilters(**wrong)


def test_unknown_kinds_and_periods(spark):
    df = spark.createDataFrame([(1,)], "product_id int")
    with pytest.raises(ValueError):
        listing.details(df, df, "secrets")
    with pytest.raises(ValueError):
        listing.changes_in(df, "1y")


def test_lineage_and_faults(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 7)], "k int, p int")
    got = relational.lineage(spark.createDataFrame([(3,), (9,)], "h int"), nodes, "h", "k", "p").collect()
    assert sorted(map(tuple, got)) == [(3, 1, 2), (3, 2, 1), (3, 3, 0), (9, 9, 0)]
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 8), (5, None)], "k int, p int")
    with pytest.raises(ValueError, match="cycle"):
        relational.lineage(ring.select(F.col("k").alias("h")).limit(1), ring, "h", "k", "p").collect()
    assert sorted(map(tuple, relational.tree_faults(ring, "k", "p").collect())) == [(1, "CYCLE"), (2, "CYCLE"), (3, "CYCLE"), (4, "DANGLING")]


def test_walks_in_logarithmic_rounds(spark, monkeypatch):
    """A chain of 10,000 in about 14 joins; a cycle of two among as many nodes is told from it as soon."""
    rounds = []
    kept = relational.checkpointed
    monkeypatch.setattr(relational, "checkpointed", lambda df: rounds.append(1) or kept(df))
    chain = spark.range(10_000).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    assert relational.walk(chain, "k", "p", F.when(F.col("k") % 1000 == 7, F.col("k"))).filter("k % 997 = 5".replace("k", "node")).agg(F.sum("depth"), F.min("value"), F.bool_and("ended")).first()[1:] == (7, True)
    assert len(rounds) <= 16
    rounds.clear()
    ring = chain.unionByName(spark.createDataFrame([(-1, -2), (-2, -1), (-3, -2)], "k bigint, p bigint"))
    assert sorted(r.key for r in relational.tree_faults(ring, "k", "p").collect()) == [-3, -2, -1]
    assert len(rounds) <= 16


def test_walks_by_brute_force(spark):
    rng = __import__("random").Random(2)
    for n in (1, 7, 40):
        up = {k: rng.choice([None, *range(n), n + 5]) for k in range(n)}
        nodes = spark.createDataFrame([(k, p, f"l{k}") for k, p in up.items()], "k bigint, p bigint, l string")
        expected, ended = set(), {}
        for k in up:
            path = [k]
            while up[path[-1]] in up and up[path[-1]] not in path:
                path.append(up[path[-1]])
            expected |= {(k, x, f"l{x}", depth) for depth, x in enumerate(path)}
            ended[k] = up[path[-1]] not in up
        assert {tuple(r) for r in relational.ancestors(nodes, "k", "p", "l").collect()} == expected
        assert {r.node: r.ended for r in relational.walk(nodes, "k", "p").collect()} == ended


def test_tree_raises_on_cycles(spark):
    votes = spark.createDataFrame([("a", "A", "b", 1), ("b", "B", "a", 2)], "url string, name string, parent string, seen bigint")
    with pytest.raises(ValueError, match="CYCLE"):
        tree.build_tree(votes, "/", "All")
    got = {r.url: (r.name, r.parent, r.depth) for r in tree.build_tree(votes.limit(0), "/", "All").collect()}
    assert got == {"/": ("All", None, 0)}


def test_json_patches(spark):
    rows = spark.createDataFrame([('{"b":1,"a":{"x":[1,2]}}', '{"b":"q","c":null}'), (None, '{"z":1.5}'), ('{"z":1}', None)], "a string, b string")
    assert [r.x for r in rows.select(merge.merge_json(F.col("a"), F.col("b")).alias("x")).collect()] == ['{"a":{"x":[1,2]},"b":"q","c":null}', '{"z":1.5}', '{"z":1}']
    lists = spark.createDataFrame([("[]",), (None,), ('[{"a":1}]',)], "h string")
    assert [r.x for r in lists.select(merge.append_event(F.col("h"), F.lit('{"n":2}')).alias("x")).collect()] == ['[{"n":2}]', '[{"n":2}]', '[{"a":1},{"n":2}]']


@settings(max_examples=200, deadline=None)
@given(st.text("абв xyz01", max_size=12), st.text("абв xyz01", max_size=12))
def test_bound_on_similarity(a, b):
    """The shared letters bound the ratio from above."""
    shared = sum(min(a.count(c), b.count(c)) for c in set(a))
    assert SequenceMatcher(None, a, b).ratio() <= (2 * shared / (len(a) + len(b)) if a or b else 1) + 1e-12


def test_audit_of_accepted_links(spark):
    role = "struct<role:string>"
    rows = spark.createDataFrame([
        (1, 10, Row(n_kind="vise", n_role=Row(role="OWN_MODEL")), Row(n_kind="vise", n_role=Row(role="OWN_MODEL")), [], "EXACT_MATCH", True),
        (2, 20, Row(n_kind="vise", n_role=Row(role="REFERENCE_MODEL")), Row(n_kind="vise", n_role=Row(role="OWN_MODEL")), ["property:length"], "EXACT_MATCH", True),
        (3, 30, Row(n_kind="unknown", n_role=Row(role="OWN_MODEL")), Row(n_kind="unknown", n_role=Row(role="OWN_MODEL")), ["model"], "CONFLICT", True),
    ], f"source_key int, candidate_key int, s struct<n_kind:string,n_role:{role}>, c struct<n_kind:string,n_role:{role}>, conflicts array<string>, result_status string, result_accepted boolean")
    got = {r.source_key: (r.same_kind, r.no_reference_mismatch, r.no_execution_mismatch, r.no_property_conflict, r.result) for r in links.audit_accepted(rows).collect()}
    assert got == {1: (True, True, True, True, "PASS"), 2: (True, False, True, False, "DEMOTED_TO_REVIEW"), 3: (False, True, False, True, "DEMOTED_TO_REVIEW")}


def test_match_report(spark):
    sources = spark.createDataFrame([(1, "n", "b", "m", "a")], "key int, name string, brand string, model string, supplier_article string")
    decided = spark.createDataFrame([(1, "REVIEW", "X", 0.5, None, ["a", "b"], [], False)], "source_key int, status string, method string, confidence double, candidate_key int, conflicts array<string>, warnings array<string>, auto_accepted boolean")
    row = links.match_report(decided, sources).first()
    assert (row.conflicts, row.warnings, row.auto_accepted, row.name) == ("a|b", "", "FALSE", "n")


def test_violations_stop_a_publication(spark):
    rows = spark.createDataFrame([(1, ["x"])], "product_id int, errors array<string>")
    integrity.require_none(rows.limit(0), "selection")
    with pytest.raises(ValueError, match="selection: Row"):
        integrity.require_none(rows, "selection")


def test_cron():
    at = datetime(2024, 3, 30, 22, 30, tzinfo=UTC)
    assert review.occurrences("30 2 * * *", "Europe/Berlin", at, 2) == [datetime(2024, 4, 1, 0, 30, tzinfo=UTC), datetime(2024, 4, 2, 0, 30, tzinfo=UTC)]  # 31 March has no 02:30
    assert review.occurrences("*/20 9-10 * * 1,3", "UTC", at, 3) == [datetime(2024, 4, 1, 9, m, tzinfo=UTC) for m in (0, 20, 40)]
    assert review.occurrences("0 0 13 * 5", "UTC", at, 2) == [datetime(2024, 4, 5, tzinfo=UTC), datetime(2024, 4, 12, tzinfo=UTC)]
    assert review.occurrences("0 12 29 2 *", "UTC", at, 1) == [datetime(2028, 2, 29, 12, tzinfo=UTC)]
    assert review.occurrences("15 * * * *", "UTC", at, 1, back=True) == [datetime(2024, 3, 30, 22, 15, tzinfo=UTC)]
    for wrong in ("* * * *", "61 * * * *", "* * * * 8"):
        with pytest.raises(ValueError):
            review.occurrences(wrong, "UTC", at)
    now = datetime(2024, 1, 1, 12, 0, 30, tzinfo=UTC)
    plans = [("a", "0 12 * * *", "UTC", None), ("b", "0 12 * * *", "UTC", datetime(2024, 1, 1, 12, tzinfo=UTC)), ("c", "0 11 * * *", "UTC", None)]
    assert review.due(plans, now) == [("a", datetime(2024, 1, 1, 12, tzinfo=UTC))]


def test_relation_evidence(spark):
    rows = spark.createDataFrame([(1, [("accessory", "a"), ("odd", "b"), (None, None)]), (2, None)], "k int, relations array<struct<kind:string,target:string>>")
    got = {r.k: json.loads(r.relation_evidence) for r in reports.relation_buckets(rows, "k").collect()}
    assert got[1] == {"ACCESSORY": ["a"], "COMPATIBLE_WITH": [], "PARENT_REFERENCE": [], "RELATED": ["b", ""], "REPLACEMENT": []} and got[2]["RELATED"] == []


PAGE = """<html><head><link rel="canonical" href="http://www.shop.ru/catalog/p1/"></head><body>
<div class="breadcrumb-wrapper"><a class="breadcrumb-link" href="/catalog/">Каталог</a><a href="/catalog/x/">Тиски</a></div>
<div class="c-catalog-element wide" data-data='{"id": 77}'><h1> Тиски  PP-800 </h1><span class="catalog-element-article-value">A-1</span>
<div class="catalog-element-gallery-pictures"><a href="/upload/1.jpg"><img src="/upload/1.jpg"></a><img data-src="/upload/2.jpg"><img src="/upload/no_photo.png"></div>
<div class="catalog-element-price-current">12 500,50 руб.</div><div class="catalog-element-price-base">13 000 руб.</div>
<div class="catalog-element-quantity">В наличии 7 шт</div><div data-role="section.content.item" data-id="description"><div itemprop="description">Хорошие <b>тиски</b></div></div>
<div data-id="properties"><div class="catalog-element-properties-detail-item"><span class="catalog-element-properties-detail-item-name">Бренд</span><span class="catalog-element-properties-detail-item-value">Stalex</span></div>
<div class="catalog-element-properties-detail-item"><span class="catalog-element-properties-detail-item-name">Длина, мм</span><span class="catalog-element-properties-detail-item-value">200</span></div></div>
<div data-role="section.content.item" data-id="complect"><ul><li>Ключ</li><li>Ключ</li><li> </li></ul></div>
<div data-role="section.content.item" data-id="accessories"><a href="/catalog/g1/" title="Губки"><span class="catalog-products-viewed-price">900 руб.</span></a></div>
<a href="/files/p.pdf">Паспорт изделия</a><iframe src="https://rutube.ru/v/1"></iframe></div></body></html>"""


def test_strict_page_record(spark):
    rows = spark.createDataFrame([("http://shop.ru/catalog/p1/?utm_source=x", PAGE), ("http://shop.ru/c/", "<h1>Все</h1><div class='c-catalog-section'></div>"), ("u", None), ("http://shop.ru/o/", "<div class=c-catalog-element>")], "url string, html string")
    read = pages.with_nodes(rows)
    kinds = {r.url: r.e for r in read.select("url", pages.page_evidence(read).alias("e")).collect()}
    assert [kinds[u].page_type for u in (rows.first().url, "http://shop.ru/c/", "u", "http://shop.ru/o/")] == ["product", "category", "other", "other"]
    assert kinds[rows.first().url].support == 7 and not kinds[rows.first().url].has_controls
    got = {r.url: r for r in read.select("url", *pages.product_record()).collect()}[rows.first().url]
    assert (got.external_id, got.external_id_type, got.sku, got.name, got.brand, got.manufacturer) == ("77", "internal_product_id", "A-1", "Тиски PP-800", "Stalex", None)
    assert (str(got.price), str(got.old_price), got.currency, got.availability, got.quantity, got.description) == ("12500.50", "13000.00", "RUB", "in_stock", 7, "Хорошие тиски")
    assert [(p.position, p.name, p.value, p.unit) for p in got.properties] == [(1, "Бренд", "Stalex", None), (2, "Длина, мм", "200", "мм")]
    assert [c.name for c in got.categories] == ["Каталог", "Тиски"] and got.canonical_url == "https://shop.ru/catalog/p1/"
    assert (got.images, got.package, got.videos) == (["/upload/1.jpg", "/upload/2.jpg"], ["Ключ"], ["https://rutube.ru/v/1"])
    assert [(d.url, d.kind) for d in got.documents] == [("/files/p.pdf", "passport")] and [(r.kind, r.name, r.url, str(r.price)) for r in got.relations] == [("accessory", "Губки", "/catalog/g1/", "900.00")]


def test_replay_of_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page":1,"total":3,"items":[{"id":1,"n":"a"},{"id":2,"n":"b"}]}\n{"page":2,"total":3,"items":[{"id":2,"n":"b"}]}\n')
    items, problems = readers.read_replay(spark, str(tmp_path), "id:bigint,n:string")
    assert items.count() == 3 and [r.problem for r in problems.collect()] == ["REPEATED_ID:2"]
    (tmp_path / "b.json").write_text('{"page":3,"total":9,"items":[]}\n')
    assert {r.problem for r in readers.read_replay(spark, str(tmp_path), "id:bigint,n:string")[1].collect()} == {"TOTALS_DIFFER:3-9", "ITEMS_NOT_TOTAL:3", "REPEATED_ID:2"}


def test_cards_from_tables(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b")], "product_id int, name string")
    media = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "product_id int, position int, url string")
    got = {r.product_id: [m.url for m in r.media] for r in readers.rebuild_cards(products, {"media": media}).collect()}
    assert got == {1: ["x", "y"], 2: []}


def test_supplement_and_bootstrap(spark):
    registry = spark.createDataFrame([(1, "", "h"), (2, "B", "h"), (3, None, "h")], "id bigint, brand string, snapshot_hash string")
    extra = spark.createDataFrame([(1, "New"), (2, "Other")], "id bigint, brand string")
    got = {r.id: r for r in readers.supplement(registry, extra, ("brand",)).collect()}
    assert (got[1].brand, got[2].brand, got[3].brand) == ("New", "B", None) and len({r.snapshot_hash for r in got.values()}) == 3
    catalog = spark.createDataFrame([(5, "2")], "catalog_id bigint, origin string")
    products = spark.createDataFrame([(i, None) for i in (1, 2, 3, 10)], "id bigint, catalog_id bigint")
    after, linked = merge.bootstrap_catalog(catalog, products)
    assert {r.origin: r.catalog_id for r in after.collect()} == {"2": 5, "1": 6, "10": 7, "3": 8}
    assert {r.id: r.catalog_id for r in linked.collect()} == {1: 6, 2: 5, 3: 8, 10: 7}


def test_urls_that_may_be_fetched(spark):
    urls = ["https://a.shop.ru/x", "http://shop.ru", "https://shop.ru.evil.com", "ftp://shop.ru", "http://10.0.0.1/", "http://user@shop.ru/", None, "http://[::1]/"]
    got = [r.x for r in spark.createDataFrame([(u,) for u in urls], "u string").select(readers.allowed_url(F.col("u"), ("shop.ru", "10.0.0.1")).alias("x")).collect()]
    assert got == [True, True, False, False, False, True, False, False]


def test_payload_is_gated(spark):
    rows = spark.createDataFrame([("10", "5", None), ("9", "<1>", "x")], "id string, price string, stock string")
    text = "".join(writers.import_payload(rows, {"price": "price", "stock": "quantity"}, []))
    assert text.index("<id>9</id><price>&lt;1&gt;</price><quantity>x</quantity>") < text.index("<id>10</id><price>5</price></update>")
    with pytest.raises(ValueError, match="NOT_PROVEN"):
        list(writers.import_payload(rows, {}, ["NOT_PROVEN"]))


def test_packaged_views(spark, tmp_path):
    (tmp_path / "cards.csv").write_text("﻿id,name\n1,a\n", encoding="utf-8")
    readers.packaged_views(spark, str(tmp_path), ("cards",))
    assert spark.sql("select name from cards where id = '1'").first().name == "a"


def test_contract_double(spark):
    """New, changed and unchanged counts equal those of a dictionary that takes the same runs."""
    runs = [{1: "a", 2: "b"}, {1: "a", 2: "c", 3: "d"}, {3: "d"}, {}]
    known: dict[int, str] = {}
    current = spark.createDataFrame([], "id int, v string")
    for run in runs:
        incoming = spark.createDataFrame(sorted(run.items()), "id int, v string")
        got = {r.status: r["count"] for r in merge.compare(current, incoming, ["id"], {"v": ["v"]}).filter("status <> 'MISSING'").groupBy("status").count().collect()}
        want = {"NEW": sum(k not in known for k in run), "CHANGED": sum(k in known and known[k] != v for k, v in run.items()), "UNCHANGED": sum(known.get(k) == v for k, v in run.items())}
        assert got == {k: n for k, n in want.items() if n}
        known |= run
        current = spark.createDataFrame(sorted(known.items()), "id int, v string")


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        shared_folder(Session)
    assert shared_folder(spark).startswith("file://")


def test_duplicate_candidates_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", F.col("p_partkey") % 3).alias("name"), "p_brand", "p_type", "p_size")
    keyed = rows.withColumns({"TYPE_SIZE": F.concat_ws("/", "p_type", "p_size"), "NAME_BRAND": F.concat_ws("/", "name", "p_brand"), "names": F.concat_ws("/", "p_brand", F.substring("name", 1, 12))})
    got = {(r.left, r.right): r.methods for r in matching.duplicate_candidates(keyed, ["TYPE_SIZE", "NAME_BRAND"], "names", "name", block_rows=4, name_rows=6).collect()}
    data, want = rows.collect(), {}

    def similar(a, b):
        ratio = SequenceMatcher(None, a.name, b.name).ratio()
        return f"HIGH_NAME_SIMILARITY:{ratio:.4f}" if ratio >= 0.95 else None

    def pairs(method, key, most):
        groups = {}
        for r in data:
            groups.setdefault(key(r), []).append(r)
        for members in groups.values():
            for a in members if 2 <= len(members) <= most else []:
                for b in members:
                    if a.key < b.key and (said := method(a, b)):
                        want.setdefault((a.key, b.key), set()).add(said)

    pairs(lambda a, b: "TYPE_SIZE", lambda r: (r.p_type, r.p_size), 4)
    pairs(lambda a, b: "NAME_BRAND", lambda r: (r.name, r.p_brand), 4)
    pairs(similar, lambda r: (r.p_brand, r.name[:12]), 6)
    assert got == {k: ";".join(sorted(v)) for k, v in want.items()} and {m for v in want.values() for m in v} >= {"TYPE_SIZE", "HIGH_NAME_SIMILARITY:1.0000"}
