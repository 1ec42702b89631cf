"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from statuslake.plans import catalogue
from statuslake.plans.views import TABLES

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(x) for x in value)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = db.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    ours = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, map(normal, ours))) == sorted(map(repr, map(normal, theirs)))


#: 300 rounds of trees each: their parts are tested with few rounds below.
LONG = {"c11_c16_c17_trees", "c12_c13_importances"}


def test_trees_with_few_rounds(spark, sf_dir):
    from statuslake.operators import classify
    from statuslake.plans.model_queries import _matrix
    from statuslake.plans.views import Source

    train, held = _matrix(Source(spark, sf_dir))
    model = classify.gbt(train, rounds=3, columns="0.8")
    got = classify.decide(classify.p_closed(model.transform(held)), "balanced").collect()
    assert got and all(r["predicted_closed"] == (r["p_closed"] >= 0.30) for r in got)
    weights = classify.importances(spark, model, ["n_chars", "toxic", "count_feature", "age"]).collect()
    assert len(weights) == 4 and abs(sum(r["importance"] for r in weights) - 1) < 1e-6


def test_training_tables_have_few_parts(spark, sf_dir):
    """However many tasks made it: each round of the trees is some tasks for each part."""
    from statuslake.operators import classify
    from statuslake.plans.model_queries import _matrix
    from statuslake.plans.views import Source

    most = min(spark.sparkContext.defaultParallelism, classify.PARTS)
    many = {"spark.sql.shuffle.partitions": "71", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        train, held = _matrix(Source(spark, sf_dir))
        assert train.rdd.getNumPartitions() <= most
        ids = [r["id"] for r in train.select("id").unionByName(held.select("id")).collect()]
        assert sorted(ids) == sorted(r["id"] for r in Source(spark, sf_dir)("labeled").select("id").collect())
        assert train.rdd.map(lambda r: r["id"]).collect() == _matrix(Source(spark, sf_dir))[0].rdd.map(lambda r: r["id"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_training_table_of_one_part_is_dealt_to_all_cores(spark):
    from statuslake.operators import classify

    train = classify.dealt(spark.range(4000).coalesce(1), "id")
    sizes = train.rdd.glom().map(len).collect()
    assert len(sizes) == min(spark.sparkContext.defaultParallelism, classify.PARTS) and max(sizes) < 2 * 4000 / len(sizes)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "region" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
