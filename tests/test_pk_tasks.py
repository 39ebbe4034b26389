"""CHK1 over more keys than one task counts."""

from pyspark.sql import functions as F

from possum.operators import checks


def test_keys_are_counted_by_as_many_tasks_as_they_fill(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 1990).alias("a"), F.when(F.col("id") != 5, F.lit("x")).alias("b"))
    whole = checks.pk_violations(df, ["a", "b"], "t")
    monkeypatch.setattr(checks, "TASK_KEYS", 100)
    cut = checks.pk_violations(df, ["a", "b"], "t")
    assert "RepartitionByExpression [a" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert cut.where("kind = 'duplicate'").count() == 9 and cut.where("kind = 'null key'").first()["n"] == 1
