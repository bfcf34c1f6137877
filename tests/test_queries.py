"""Every named query against its SQL on the smallest directory."""

import importlib

import pytest
from oracle_check import compare, connect

from landq.plans.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries that SQL cannot express or is too slow for, with the test that compares them with brute force.
BRUTE_FORCED = {
    "j9_engine_agreement": "test_settings_and_streams.test_engine_agreement_by_brute_force",
    "p13_title_links": "test_name_pairs.test_title_links_by_brute_force",
}


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, con, name):
    if CATALOGUE[name].sql is None:
        module, test = BRUTE_FORCED[name].split(".")
        assert hasattr(importlib.import_module(module), test)
        return
    ok, message, _, _ = compare(spark, con, SF, name)
    assert ok, message
