import os

import pytest

from compare import ROOT, same
from orrery.llm import queries as q

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", q.ORACLE)
def test_query_equals_its_sql(spark, name):
    same(spark, q.QUERIES[name], q.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLE])
def test_query_without_sql_runs(spark, name):
    df = q.QUERIES[name](spark, ROOT)
    assert df.columns and df.count() >= 0
