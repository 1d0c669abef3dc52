import os

import pytest

from compare import ROOT
from odd_tables import make, rows
from orrery.plans import training

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("odd"), "odd")


@pytest.mark.parametrize("name", training.QUERIES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert training.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_counts", "p5_found", "p5_rolling"])
def test_nulls_and_clashing_names_change_nothing(spark, odd, name):
    assert rows(training.QUERIES[name](spark, odd)) == rows(training.QUERIES[name](spark, ROOT))
