from __future__ import annotations

import pytest

from tallyforge.llm.oracles import ORACLES
from tallyforge.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    found = duck.sql(ORACLES[name])
    made = QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(repr([str(r[c]) for c in columns]) for r in made.collect()) == sorted(repr([str(r[i]) for i in at]) for r in found.fetchall())
