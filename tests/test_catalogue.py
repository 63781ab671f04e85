"""Every query against its SQL oracle."""

from __future__ import annotations

import pytest
from compare import same

from sparkloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(name, spark, sf_dir, duck):
    same(catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.ORACLES[name]).df())


def test_queries_without_oracle_run(spark, sf_dir):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"orders_sample_seeded", "parallelism"}
    query = catalogue.QUERIES["orders_sample_seeded"]
    assert sorted(query(spark, sf_dir).collect()) == sorted(query(spark, sf_dir).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
