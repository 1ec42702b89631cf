"""Plans and results that differ only on larger tables."""

import duckdb
import pytest

from statuslake.plans import catalogue

SQL, QUERIES = catalogue.oracle_sql(), catalogue.queries()


@pytest.fixture(scope="module")
def wide(spark, sf_dir, tmp_path_factory):
    """The star tables with keys of customers and parts far apart, so that ids outweigh confidences."""
    out = str(tmp_path_factory.mktemp("wide"))
    for t, keys in {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_custkey"], "nation": [], "region": []}.items():
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.withColumns({k: df[k] * 100003 for k in keys}).write.parquet(f"{out}/{t}.parquet")
    return out


def agrees(spark, folder, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    columns = ", ".join(sorted(df.columns))
    theirs = con.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall()
    ours = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs)) and ours


def test_best_per_region_with_large_ids(spark, wide):
    agrees(spark, wide, "w2_best_per_region")


def test_rate_of_largest_has_no_nested_loop_of_tables(spark, sf_dir):
    plan = QUERIES["a22_rate_of_largest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # the one that is left takes the one-row count of the parts
    assert plan.count("NestedLoopJoin") <= 1 and "LeftSemi" not in plan
