"""The driver's contract: a sample of queries against DuckDB, and the entry module without the subpackage for language models."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
SAMPLE = ["normalize_union", "matches", "clusters_transitive", "golden_customer", "history_customer", "customer_360", "customer_xref", "golden_cdc", "upsert_latest", "report_metrics", "src_feed_files", "src_feed_appended", "cluster_lookup", "health", "audit_reads"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_duckdb(spark, name):
    import duckdb

    from goldweave.plans import queries

    con = duckdb.connect()
    for table in ("customer", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    rows = lambda d: sorted(map(str, d[sorted(d)].astype(object).where(d[sorted(d)].notna(), None).itertuples(index=False, name=None)))
    assert rows(want) == rows(got) and len(got)


def test_every_query_but_few_has_sql():
    import __spark_entry__ as entry

    own = [q for q in entry.queries() if q not in entry.oracle_sql() and not q.startswith("op") and q != "pipeline"]
    assert own == []


def test_entry_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['goldweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'matches' in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_entry_does_not_hide_a_fault_of_the_subpackage():
    code = "import sys; sys.modules['goldweave.llm.packing'] = None; import __spark_entry__"
    assert b"goldweave.llm.packing" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).stderr
