import pytest
from compare import differences, views

from castweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        assert differences(df, queries.SQL[name], views(sf_dir)) == []
    else:
        rows = df.collect()
        assert rows
        if name.endswith("_found"):
            assert len(rows) == len(set(rows))
