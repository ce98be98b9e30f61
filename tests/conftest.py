"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def same_rows(spark_df, con, sql: str) -> None:
    """The frame's rows are the SQL's, in any order."""
    import pyarrow as pa

    got = spark_df.toArrow()
    con.register("got", got)
    cols = ", ".join(f'"{c}"' for c in sorted(got.schema.names))
    try:
        want = con.execute(f"SELECT {cols} FROM ({sql})").to_arrow_table()
        con.register("want", want)
        assert sorted(want.schema.names) == sorted(got.schema.names)
        for a, b in (("got", "want"), ("want", "got")):
            left = con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall()
            assert not left, (a, left)
        assert isinstance(want, pa.Table) and got.num_rows == want.num_rows
    finally:
        con.unregister("got")
