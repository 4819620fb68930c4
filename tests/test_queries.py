"""Every registered archive query against its SQL on the smallest tables."""

import pandas as pd
import pytest

from tidewire.plans import queries


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if pd.isna(x) is True:
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
