"""Every registered query against its DuckDB text, over whole tables."""

import os

import oracle_check
import pytest

from dialoscope.plans.catalog import load
from dialoscope.plans.inputs import enriched

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
GOLDEN_DIR = "/root/testdata/sf0.01"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query_matches_oracle(spark, con, name):
    df = CATALOG.queries[name](spark, SF_DIR)
    assert name in CATALOG.oracles
    assert oracle_check.compare(con, df, CATALOG.oracles[name]) is None


def test_golden_quality_counts(spark):
    counted = {(r.run_version, r.response_quality): r["count"] for r in
               enriched(spark, GOLDEN_DIR).groupBy("run_version", "response_quality").count().collect()}
    assert counted == {(1, "success"): 323, (1, "marginal"): 327, (1, "no_data"): 245, (1, "fail"): 105,
                       (2, "success"): 326, (2, "marginal"): 325, (2, "no_data"): 244, (2, "fail"): 105}
