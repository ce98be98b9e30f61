"""Every registered query of the repository engine against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from conftest import DATA, same_rows

from quillspark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(name, spark, duck):
    same_rows(catalogue.QUERIES[name](spark, DATA), duck, catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_long_prompts_are_made_by_all_tasks(spark):
    assert catalogue.QUERIES["page_prompts"](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
