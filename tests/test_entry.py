"""The driver's contract, with and without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "audit_suspected_untranslated" in e.queries()


def test_without_training_data_operators():
    code = "import sys; sys.modules['quire.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k[0] == 'p' and k[1].isdigit() for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_llm():
    for p in (ROOT / "quire").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quire.llm" not in p.read_text(encoding="utf-8"), p


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "seq", "reasons"] and df.count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_all_core_queries_run_and_match(spark):
    import duckdb

    from quire.plans import all_oracle_sql, all_queries

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = all_oracle_sql()
    for name, f in all_queries().items():
        df = f(spark, str(DATA))
        n = df.count()
        if name in sql:
            rel = con.sql(sql[name])
            assert sorted(rel.columns) == sorted(df.columns), name
            assert len(rel) == n, name
