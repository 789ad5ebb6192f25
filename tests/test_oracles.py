"""Every query with an oracle gives the same rows as DuckDB."""

from __future__ import annotations

import pytest

from tallyforge.plans.registry import ORACLES, QUERIES


def plain(value):
    return round(value, 9) if isinstance(value, float) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def compare(spark, duck, sf_dir, query, sql):
    made = query(spark, sf_dir)
    found = duck.sql(sql)
    columns = sorted(made.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    ours = sorted(repr([plain(row[c]) for c in columns]) for row in made.collect())
    theirs = sorted(repr([plain(row[i]) for i in at]) for row in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
