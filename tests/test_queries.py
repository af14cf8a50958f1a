"""Every tensor query against its SQL, and the entry points without the corpus operators."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tensorweft.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="session")
def duck(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return db


def tidy(rows):
    number = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(([number(x) for x in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert tidy(rows) == tidy(want.select(", ".join(f'"{n}"' for n in names)).fetchall())


def test_without_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tensorweft", tmp_path / "tensorweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'contraction' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_plans_prune_and_broadcast_nothing_large(spark, sf_dir):
    """Scans read the columns that a contraction needs, and sums are partial before their shuffle."""
    plan = QUERIES["contraction"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan and "partial_sum" in plan
