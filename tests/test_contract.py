import sys

import duckdb
import pytest

import __spark_entry__ as contract
import contract as registered

SAMPLE = ["plan_summary", "lint_glossary", "audit_catalog", "gc_cache", "bulk_reference_rewrite", "apply_responses", "validate_renames",
          "task_sequence", "exact_duplicates", "merge_catalogs", "ingest_android", "stream_history", "stalled_runs", "render_catalog"]
FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = set(registered.QUERIES)
    assert own <= set(contract.queries())
    assert own <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    sys.path.insert(0, "tools")
    from tools.check_oracles import TABLES, normal

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == want
