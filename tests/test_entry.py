import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyweave.plans import queries as core

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", core.QUERIES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = core.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(core.ORACLE_SQL[name])
    places = sorted(range(len(columns)), key=lambda k: want.description[k][0])
    assert sorted(d[0] for d in want.description) == columns
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(tuple(r[k] for k in places) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["draw", "idx"]


def test_core_does_not_import_the_optional_package():
    code = "import sys; import tallyweave, tallyweave.plans.queries; sys.exit(any(m.startswith('tallyweave.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_optional_parts(tmp_path, pipeline):
    """The whole repository less the two folders, with and without the pipeline's file."""
    import shutil

    without = shutil.ignore_patterns("llm", "__pycache__", ".git", *(() if pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=without)
    assert (tmp_path / "repo/corpus_pipeline.py").exists() == pipeline or not (ROOT / "corpus_pipeline.py").exists()
    code = f"import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) == {set(core.QUERIES)}"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env).returncode == 0


def test_selftest():
    assert subprocess.run([sys.executable, "-m", "tallyweave", "--selftest"], cwd=ROOT).returncode == 0
