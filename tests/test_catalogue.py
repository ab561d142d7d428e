import pytest

from corpusloom.plans import catalogue

from .compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    out = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert out.count() >= 0
    else:
        same(out, connect(SF).execute(sql))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
