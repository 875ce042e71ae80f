"""The operators' SQL over the smallest tables, and that the queries are registered."""

import re

import pytest

import __spark_entry__ as entry
from compare import differences, duck
from tripweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), duck(sf).sql(ORACLES[name])) is None


def test_registered():
    names = entry.queries()
    assert {re.match(r"op\d+", n)[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(entry.oracle_sql())
