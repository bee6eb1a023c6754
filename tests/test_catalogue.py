import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from matchloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_llm_subpackage(tmp_path):
    """The rest works when the folder is gone."""
    for name in ("__spark_entry__.py", "matchloom"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    package = tmp_path / "matchloom"
    package.mkdir()
    for p in (REPO / "matchloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_llm():
    found = [p for p in (REPO / "matchloom").rglob("*.py") if "llm" not in p.relative_to(REPO / "matchloom").parts and "matchloom.llm" in p.read_text()]
    assert found == []
