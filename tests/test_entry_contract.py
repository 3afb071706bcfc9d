"""Driver contract: keys, column naming and output types of the registered queries."""
import os
import re
import shutil
import subprocess
import sys

from pyspark.sql import types as T

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


# Queries of the optional folders have tests of their own, in tests/llm.
OWN = {k: f for k, f in E.queries().items() if k in E._registry.QUERIES}


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(E.oracle_sql())
    assert len(OWN) >= 40


def test_output_columns_are_named_and_comparable(spark):
    for name, fn in OWN.items():
        schema = fn(spark, SF).schema
        cols = [f.name for f in schema.fields]
        assert len(cols) == len(set(cols)), name
        for f in schema.fields:
            assert not re.search(r"[()]", f.name), (name, f.name)           # every computed column aliased
            assert not isinstance(f.dataType, T.DecimalType), (name, f.name)  # compared as DOUBLE


def test_entry_works_without_the_optional_folders(tmp_path):
    here = os.path.dirname(os.path.abspath(E.__file__))
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy_{keep_pipeline}"
        skip = ["llm", ".git", "__pycache__"] + ([] if keep_pipeline else ["corpus_pipeline.py"])
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns(*skip))
        code = (f"import sys; sys.path.insert(0, {str(copy)!r}); import __spark_entry__ as E, tests.check_oracle; "
                "assert E.__file__.startswith(sys.path[0]); from regiopanel.session import get_session; "
                f"s = get_session('local[2]', 2); print(sorted(E.queries()) == sorted(E.oracle_sql()), "
                f"E.queries()['kpis'](s, {SF!r}).count())")
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.stdout.strip().endswith("True 1"), done.stderr[-2000:]
