"""Each query beside its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from folio.plans import all_queries, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(str(tuple(map(one, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    ours = registry.QUERIES[name](spark, small).toPandas()
    assert list(ours.columns)
    if name in registry.ORACLES:
        theirs = duck.sql(registry.ORACLES[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)


def test_names_are_in_the_registry_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
