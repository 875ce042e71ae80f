"""Helpers shared by the operators."""

import pytest

from tripweave.llm import common
from tripweave.session import write_through


@pytest.mark.parametrize("limit", [1, common.BROADCAST_BYTES])
def test_meeting_on_either_path(spark, monkeypatch, limit):
    """The bit table drops no row that meets a key."""
    monkeypatch.setattr(common.sized, "__defaults__", (limit,))
    rows = spark.range(50_000).selectExpr("xxhash64(id) AS key", "id")
    keys = write_through(spark.range(0, 60_000, 7).selectExpr("xxhash64(id) AS key", "id AS own"))
    got = sorted((r.id, r.own) for r in common.meeting(rows, keys, "key").collect())
    assert got == [(i, i) for i in range(0, 50_000, 7)]
    assert common.meeting(rows, write_through(keys.limit(0)), "key").count() == 0
