from __future__ import annotations

import os

import pytest

from docgraph import queries as core
from tests.oracle import compare

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_oracle(spark, name: str) -> None:  # noqa: ANN001
    compare(spark, core.queries()[name], core.oracle_sql()[name], SF)


def test_queries_without_sql_run(spark) -> None:  # noqa: ANN001
    for name in set(core.queries()) - set(core.oracle_sql()):
        assert core.queries()[name](spark, SF).count() > 0
