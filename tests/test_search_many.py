"""Many searches in one plan."""

import re

from foliant.plans import catalog_queries
from tests.test_oracle import SF


def test_books_are_never_a_broadcast(spark):
    """Files of books are small beside their rows, so a broadcast that is planned by file sizes takes the driver's memory."""
    df = catalog_queries.search_many(spark, SF)
    assert df.count() > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[__row#", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
