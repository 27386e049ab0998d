"""Every query of the package that SQL can say, against its SQL on whole tables."""

import pytest
from compare import connect, difference

from voxtally.llm import catalog

RUNS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, name):
    assert difference(RUNS[name](spark, folder), connect(folder), SQL[name]) is None
