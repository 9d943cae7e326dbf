import pytest

from quirelake import catalogue
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = spark_rows(catalogue.QUERIES[name](spark, SF))
    if name in catalogue.ORACLE_SQL:
        assert got == duck_rows(catalogue.ORACLE_SQL[name], SF)
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
