"""Requests that change keys are replayed for many users at once."""

import collections

from foliant.operators import shelves, validation
from foliant.plans import shelf_queries
from foliant.schemas import TABLES
from tests.test_oracle import SF
from tests.test_upsert import listed, plain


def test_users_share_a_replay(spark):
    """Users whose keys change are replayed many in a call; one with more rows than a call takes is replayed by components, with the same entries."""
    valid, _ = validation.validate_entries(shelf_queries.changing_requests(spark, SF))
    asked = [r.asDict() for r in shelves.prepared(valid).collect()]
    empty = spark.createDataFrame([], TABLES["book_entries"])
    most = max(collections.Counter(r["user_id"] for r in asked).values())
    assert 10 < most < len(asked) // 10
    for replayed in (most // 2, 10_000):
        out = shelves.upsert_entries(empty, valid, replayed)
        assert listed(out.collect()) == listed(plain([], asked))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "__bucket" in plan
