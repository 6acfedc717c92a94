"""Every registered query against its SQL on the smallest tables."""

import pytest

from wavequarry import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLE_SQL:
        same_as_sql(df, plans.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports_and_lists_queries(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["asset", "n_blocks", "n_gated", "integrated_lufs"]
