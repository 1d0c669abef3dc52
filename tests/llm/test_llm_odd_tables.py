import os

import pytest

from compare import ROOT
from odd_tables import make, rows
from orrery.llm import queries as q

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("odd"), "odd")


@pytest.mark.parametrize("name", q.QUERIES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert q.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p2_consistent", "p4_found", "p7_found", "p9_found"])
def test_nulls_and_clashing_names_change_nothing(spark, odd, name):
    assert rows(q.QUERIES[name](spark, odd)) == rows(q.QUERIES[name](spark, ROOT))


@pytest.mark.parametrize("name", ["p6_found", "p8_mix", "p8_shares"])
def test_nulls_and_clashing_names_do_no_harm(spark, odd, name):
    """Rows of nulls are mentions without a name here, and records without an id."""
    assert q.QUERIES[name](spark, odd).count() >= q.QUERIES[name](spark, ROOT).count()
