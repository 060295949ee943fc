"""Every query with SQL against DuckDB on the smallest tables."""
import duckdb
import pytest

from arbor import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(v):
    v = float(v) if type(v).__name__ == "Decimal" else v
    return (round(v, 9) or 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(same(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(same(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """With both folders and the pipeline gone, and with the folders alone gone, the rest
    imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for gone in ([], ["corpus_pipeline.py"]):
        copy = tmp_path / f"copy{len(gone)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q); import bench"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
