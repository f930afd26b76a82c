"""Registered queries against their SQL on the smallest tables, and the guard for the optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspan import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(found, cols):
    order = [cols.index(c) for c in sorted(cols)]
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(str([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in own.oracle_sql() if n != "cluster_table_checks"))  # a whole fit: see test_library
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = own.queries()[name](spark, SF)
    got = c.execute(own.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(got.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_imports_without_optional_parts(tmp_path):
    root = os.path.dirname(entry.__file__)
    code = "import sys; sys.modules['tallyspan.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", ["fit_clusters", "cluster_table_checks"])
def test_queries_fit_all_numbers_of_clusters(spark, monkeypatch, name):
    asked = []

    def fits(rows, purity, most=own.P.MOST_CLUSTERS):
        asked.append(most)
        raise InterruptedError

    monkeypatch.setattr(own.P, "fits", fits)
    with pytest.raises(InterruptedError):
        own.queries()[name](spark, SF)
    assert asked == [own.P.MOST_CLUSTERS] == [10]
