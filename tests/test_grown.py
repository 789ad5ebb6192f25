"""Queries equal their SQL on tables whose keys are larger, shared or spread otherwise than the test tables' are."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from test_oracles import compare

from tallyforge.plans import decisions, listings
from tallyforge.plans.registry import ORACLES, QUERIES


@pytest.fixture
def changed(spark, tmp_path, sf_dir):
    """check(name, table=SELECT over the table of that name, ...): the query and its SQL read the changed tables."""

    def check(name: str, **tables: str) -> None:
        con = duckdb.connect()
        for path in Path(sf_dir).iterdir():
            made = tmp_path / path.name
            if path.stem in tables:
                duckdb.sql(f"copy ({tables[path.stem].format(path=path)}) to '{made}' (format parquet)")
            else:
                made.symlink_to(path)
            con.sql(f"create view {path.stem} as select * from '{made}'")
        compare(spark, con, str(tmp_path), QUERIES[name], ORACLES[name])

    return check


def test_evidence_of_offers_that_share_an_id(changed):
    changed("selection_evidence", lineitem="select * replace (l_orderkey % 5 as l_orderkey) from '{path}'")


def test_new_paths_with_ids_of_old_ones(changed):
    changed("category_paths", part="select * from '{path}' union all by name select * replace (p_partkey + 1000000 as p_partkey) from '{path}'")


@pytest.mark.parametrize("shift", [200_000, 200_001])
def test_candidates_of_long_models(changed, shift):
    """Models of six digits are no articles, and a source without its neighbour meets no names."""
    changed("match_candidates", part=f"select * from '{{path}}' union all by name select * replace (p_partkey + {shift} as p_partkey) from '{{path}}'")


def test_offers_move_once(spark, sf_dir, monkeypatch):
    """A selection's plan deals the lines once, and what reads a selection repeatedly reads it stored."""
    plans, checkpointed = [], listings.checkpointed

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(listings, "checkpointed", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans.append(decisions.offer_selection(spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
        made = [QUERIES[name](spark, sf_dir) for name in ("selection_changes", "export_counters")]
        assert len(plans) == 3 and all(p.count("FileScan parquet [l_orderkey") == 1 for p in plans)
        stored = [df._jdf.queryExecution().executedPlan().toString() for df in made]
        assert not any("l_orderkey" in p or "BroadcastHashJoin" in p for p in stored)  # a catalog's rows outgrow what the size of their file says
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
