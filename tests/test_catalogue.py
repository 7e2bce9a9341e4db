"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return None
        return int(v) if hasattr(v, "is_integer") and float(v).is_integer() else v

    return sorted(repr(tuple(map(plain, r))) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    have = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have, sorted(have.columns)) == rows(want, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_parser_queries(spark, sf_dir):
    assert catalogue.queries()["script_blocks"](spark, sf_dir).where("status = 'ok'").count() == 50
