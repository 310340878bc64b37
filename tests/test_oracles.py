"""Each registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from loamline.plans import history, models, oracle, storage, trees

QUERIES = {**history.QUERIES, **trees.QUERIES, **models.QUERIES, **storage.QUERIES}
SQL = {**oracle.history(), **trees.ORACLE_SQL, **models.oracle_sql(), **storage.ORACLE_SQL}
SOME = ["hotspots", "knowledge_authors", "author_gini", "file_pain", "compare_hotspots", "effort_distribution", "commit_density", "py_functions", "java_classes", "anemic_files", "god_classes", "cluster_drift", "silhouette", "effort_files", "dx_report", "parse_numstat"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return tuple(map(plain, v.values())) if isinstance(v, dict) else v.isoformat() if hasattr(v, "isoformat") else v


def test_all_but_the_driver_fits_have_sql():
    assert set(QUERIES) - set(SQL) == {"clusters", "kmeans_drift"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame, rel = QUERIES[name](spark, sf_dir), db.sql(SQL[name])
    names = sorted(frame.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    order = lambda rows: sorted(rows, key=str)
    assert order([tuple(plain(r[n]) for n in names) for r in frame.collect()]) == order([tuple(plain(r[i]) for i in at) for r in rel.fetchall()])
