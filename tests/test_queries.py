import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import ROOT, same

CORE = [m for m in entry._CORE]
SQL = [(n, m) for m in CORE for n in m.ORACLE]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name, module", SQL, ids=[n for n, _ in SQL])
def test_query_equals_its_sql(spark, name, module):
    same(spark, module.QUERIES[name], module.ORACLE[name])


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", [n for m in CORE for n in m.QUERIES if n not in m.ORACLE])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, ROOT).collect() is not None


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) == sum(len(m.QUERIES) for m in entry._modules())


def test_the_rest_works_without_the_llm_folder(tmp_path):
    root = Path(entry.__file__).parent
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules['orrery.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
