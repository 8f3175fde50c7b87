"""Every registered query of the catalog engine against its SQL."""

import pytest
from oracle import difference, rows_of_frame

from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_do_not_depend_on_partitions(spark, name):
    """Queries without SQL: rows there are, and the same ones however the shuffles are dealt; their operators have plain versions in test_rules and test_rounds."""
    found = []
    for n in (3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            found.append(rows_of_frame(registry.QUERIES[name](spark, SF)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and found[0][1]
