import pytest

from plumbline import queries
from tests.conftest import SMALL
from tests.oracle import same


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL)


def test_bootstrap_is_repeatable_and_brackets_the_estimate(spark):
    a = queries.bootstrap_ci_exact(spark, SMALL).orderBy("metric").collect()
    assert a == queries.bootstrap_ci_exact(spark, SMALL).orderBy("metric").collect()
    point = queries.point_metrics(spark, SMALL).where("model_name = 'orders'").first()
    for r in a:
        assert r["lower"] <= point[r["metric"]] <= r["upper"], r


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reports_and_missing_models_cover_whole_tables(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = queries.prediction_reports(spark, SMALL).collect()
    assert len(rows) == events.count() > 100 and {r["label"] for r in rows} == {"malignant", "benign"}
    assert {r["model"] for r in rows} == {r[0] for r in events.select("event_type").distinct().collect()}
    nations, suppliers = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("nation", "supplier"))
    want = nations.join(suppliers, nations.n_nationkey == suppliers.s_nationkey, "left_anti")
    assert queries.missing_models(spark, SMALL).count() == want.count() > 0
