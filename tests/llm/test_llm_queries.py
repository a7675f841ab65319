"""Every query runs, and agrees with its SQL where it has one."""

import pytest
from compare import connect, difference

from trustfold.llm.queries import ORACLES, QUERIES


def test_all_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    source = "pages" if name.startswith("op8") else "documents"
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    assert found.count() >= rows if not name.startswith("op2") else found.count() > 0
