"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessella import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table[n].to_pylist() for n in names))))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF).toArrow()
    if name in registry.oracle_sql():
        want = db.sql(registry.oracle_sql()[name]).to_arrow_table()
        assert rows_of(got) == rows_of(want)
        assert {f.name: f.type for f in got.schema} == {f.name: f.type for f in want.schema}
    else:
        assert got.num_rows > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_are_unique():
    with pytest.raises(ValueError):
        registry.register("label_quality_summary")(lambda s, d: None)


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    from tests.conftest import ROOT

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[0]) >= len(registry.queries())
