"""Postings, keyset pages, stored versions, snapshots and incremental reconciliation: by brute force, and by their plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import matching, merge, paging, postings, reconcile, snapshots


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_by_scan(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abAB é", k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "aaaaaa", "ababab", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    folder = f"file://{tmp_path}/index"
    postings.write_postings(df, "k", F.col("t"), folder)
    index = postings.read_postings(spark, folder)
    needles = ["", "a", "é", "ab", "B ", "aba", "aaaa", "abab", " ab", "éab", "zzz", "ababa", "a" * 40] + ["".join(rng.choices("ab ", k=rng.randint(1, 5))) for _ in range(12)]
    for needle in needles:
        assert sorted(r.key for r in postings.containing(index, needle).collect()) == [k for k, t in enumerate(texts) if t is not None and needle.lower() in t.lower()], needle
    plan = plan_of(postings.containing(index, "abab"))
    assert plan.count("FileScan") == 1 and "In(gram, [aba,bab])" in plan


def test_keyset_pages_lose_and_double_nothing(spark):
    rng = random.Random(2)
    rows = {k: rng.randint(0, 9) for k in range(400)}
    made = lambda: spark.createDataFrame(sorted(rows.items()), "k int, v int")
    directory = paging.page_directory(made(), "v", "k", 25)
    assert sorted(map(tuple, directory.collect())) == [(p + 1, 25, v, k) for p in range(16) for v, k in [sorted((v, k) for k, v in rows.items())[25 * p + 24]]]
    seen, cursor, stayed = [], None, dict(rows)
    while page := [(r.v, r.k) for r in paging.page_after(made(), directory, "v", "k", 25, cursor).collect()]:
        expected = sorted((v, k) for k, v in rows.items() if cursor is None or (v, k) > cursor)[:25]
        assert page == expected
        seen += page
        cursor = page[-1]
        for k in rng.sample(sorted(rows), 20):  # some rows go between two pages
            gone = rows.pop(k)
            if (gone, k) > cursor:
                stayed.pop(k)
    assert len(seen) == len(set(seen)) and {(v, k) for k, v in stayed.items()} <= set(seen)


def test_a_page_reads_one_range(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 500).alias("v"))
    df.repartitionByRange(16, "v", "k").sortWithinPartitions("v", "k").write.parquet(f"file://{tmp_path}/t")
    stored = spark.read.parquet(f"file://{tmp_path}/t")
    directory = paging.page_directory(stored, "v", "k", 10)
    page = paging.nth_page(stored, directory, "v", "k", 10, 1000)
    assert [(r.v, r.k) for r in page.collect()] == sorted((k % 500, k) for k in range(20_000))[9990:10_000]
    plan = plan_of(page)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(v,249\).*LessThanOrEqual\(v,2\d\d\)", plan) or re.search(r"PushedFilters: \[.*v,24\d", plan)


def test_upserts_move_the_batch_alone(spark):
    keys, by = ["k"], F.floor(F.col("k") / 100).cast("int")
    old = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("last_changed_at"))
    snapshots.create_version(old, "upsert_test", keys, by, buckets=4)
    files = lambda: {f.rpartition("/")[2]: f for f in spark.table("upsert_test").inputFiles()}
    before, version = files(), old
    for at, batch in enumerate((spark.createDataFrame([(5, "b"), (6, "a")], "k int, v string"), spark.createDataFrame([(5, "b"), (205, "c"), (9999, "n")], "k int, v string")), 2):
        plan = plan_of(snapshots.upsert_plan(spark, "upsert_test", batch, keys, ["v"], by, F.lit(at)))
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        snapshots.upsert(spark, "upsert_test", batch, keys, ["v"], by, F.lit(at))
        version = merge.merge_snapshot(version, batch, keys, ["v"], F.lit(at))
        assert sorted(map(tuple, spark.table("upsert_test").drop("slice").collect())) == sorted(map(tuple, version.collect()))
    kept = set(before.values()) & set(files().values())
    assert len(kept) / len(before) > 0.9  # two of thirty slices were written anew
    spark.sql("drop table upsert_test")


def test_snapshots_skip_equal_buckets(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice("abc"), rng.choice([None, 1, 2])) for k in range(3000)]
    changed = [(k, "z" if k in (7, 8) else v, n) for k, v, n in rows if k != 100] + [(5000, "new", None)]
    folders = [f"file://{tmp_path}/{i}" for i in range(3)]
    for folder, some in zip(folders, (rows, list(reversed(rows)), changed), strict=True):
        snapshots.write_snapshot(spark.createDataFrame(some, "k int, v string, n int"), ["k"], folder)
    groups = {"v": ["v"], "n": ["n"]}
    assert snapshots.differing_buckets(spark, folders[0], folders[1]) == [] and snapshots.compare_snapshots(spark, folders[0], folders[1], ["k"], groups).count() == 0
    assert 1 <= len(snapshots.differing_buckets(spark, folders[0], folders[2])) <= 4
    whole = merge.compare(*(spark.createDataFrame(x, "k int, v string, n int") for x in (rows, changed)), ["k"], groups).filter("status <> 'UNCHANGED'")
    assert sorted(map(str, snapshots.compare_snapshots(spark, folders[0], folders[2], ["k"], groups).collect())) == sorted(map(str, whole.collect()))


PRODUCT = "key bigint, name string, brand string, model string, supplier_article string, manufacturer_article string, category string, properties map<string,string>, supplier_code string, identifiers map<string,array<string>>, kind string"


@pytest.mark.parametrize("seed", [1])
def test_incremental_reconciliation_is_a_full_one(spark, seed):
    """After random changes of products, sources and links, and with few sources matched again."""
    rng = random.Random(seed)
    words = "станок токарный фрезерный vise press тиски универсальный disk ring saw".split()

    def some(key, source):
        article = rng.choice(["", f"a{rng.randint(0, 40)}"])
        ids = {} if source else {"sup": [f"A-{rng.randint(0, 40)}"]} if rng.random() < 0.5 else {}
        model = rng.choice(["", f"PX{rng.randint(0, 60)}", f"TU{rng.randint(0, 60)}"])
        name = " ".join(rng.sample(words, 3)) + (f" {model}" if rng.random() < 0.5 else "") + (f" {rng.randint(10_000, 10_020)}" if rng.random() < 0.2 else "")
        return (key, name, f"brand{key % 12}", model, article if source else "", "", "", {"length": f"{rng.randint(1, 2)} m"}, "sup", ids, "")

    before = [some(k, True) for k in range(60)], [some(1000 + k, False) for k in range(60)]
    after = [[some(r[0], not j) if rng.random() < 0.04 else r for r in rows if rng.random() > 0.03] for j, rows in enumerate(before)]
    after[1].append(some(1500, False))
    after[0].append(some(500, True))
    prepared = [matching.checkpointed(matching.prepare(spark.createDataFrame(rows, PRODUCT))) for rows in (*before, *after)]
    ddl = "source_key bigint, candidate_key bigint, origin string, manual boolean"
    link = [(k, 1000 + k, "BRAND_MODEL" if k % 2 else "SUPPLIER_ARTICLE_EXACT", k % 3 == 0) for k in range(0, 60, 6)]
    links = [spark.createDataFrame(x, ddl) for x in (link, [*link[1:], (59, 1003, "", True)])]
    decided, identified = reconcile.reconcile(prepared[0], prepared[1], links[0])
    got, identities, touched = reconcile.reconcile_changes(prepared[0], prepared[2], prepared[1], prepared[3], decided, identified, *links)
    full, full_identities = reconcile.reconcile(prepared[2], prepared[3], links[1])
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))
    assert sorted(map(str, identities.collect())) == sorted(map(str, full_identities.collect()))
    assert 0 < touched.count() < 45 and {r.method for r in full.collect()} & {"EXISTING_LINK", "EXISTING_LINK_MANUAL"}
