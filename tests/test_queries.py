"""Every query with SQL gives the SQL's rows at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cipherlode import registry

#: Queries that run the lexer over generated files: one for each detector is enough here.
SLOW = {"summary_by_priority", "report_summary", "note_index", "agent_summary_places", "cbom_provides", "cbom_lines", "node_pbkdf2", "unwrap_two_findings", "library_unread_anti", "traps_report_nothing"}
NAMES = sorted(n for n in registry.oracle_sql() if n not in SLOW or os.environ.get("TEST_ALL"))


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, tables, name):
    df = entry.queries()[name](spark, sf_dir)
    found = tables.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(map(tuple, found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


def test_every_query_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


def test_entry_needs_no_session():
    """The driver reads the queries' names before it starts Spark."""
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=Path(__file__).parent.parent, check=True, timeout=120)
