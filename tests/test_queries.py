"""Every registered query, next to its oracle SQL where there is one."""

import pytest

import __spark_entry__ as entry
from compare import difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


# tests/llm holds the corpus operators without SQL against brute force
NAMES = sorted(n for n in QUERIES if n in ORACLES or not n.startswith(("op", "pipeline")))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, ORACLES[name], SF) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
