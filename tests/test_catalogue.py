"""Every query of the engine against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rankspark.plans.catalogue import ORACLES, QUERIES

HERE = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    return connection


def as_text(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "NULL" if x is None or x is pd.NA or x != x else f"{x:.6f}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not HERE.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(HERE)).toPandas(), duck.execute(ORACLES[name]).df()
    pd.testing.assert_frame_equal(as_text(got), as_text(want))
    assert len(got) or name in ("bm25_metrics", "image_path_norm")


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"hash_encode"}  # an encoder in Python
