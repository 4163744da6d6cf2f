import pytest
from oracle import difference

from cordage.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert difference(df, SF, SQL[name]) is None
    else:
        assert df.count() > 0
