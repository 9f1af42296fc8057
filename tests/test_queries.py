import pytest

from meridian.plans import ORACLE_SQL, QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(df, ORACLE_SQL[name], SF) == (0, 0)
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
