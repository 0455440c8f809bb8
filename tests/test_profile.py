from pyspark.sql import functions as F

from spendlens.operators import quality as q


def test_distinct_estimates_within_error(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    got = {r.column_name: r for r in q.column_profile(df).collect()}
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    for c, n in exact.items():
        assert abs(got[c].approx_distinct - n) <= max(2, 0.05 * n), c  # three standard errors
        assert got[c].non_null == df.where(F.col(c).isNotNull()).count()
    assert {r.rows for r in got.values()} == {df.count()}


def test_one_aggregation_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 1.5, [1]), (1, None, float("nan"), None), (None, "a", -0.0, [])],
                               "x long, y string, z double, w array<int>")
    df = df.withColumn("y_", F.col("y"))  # names that clash with nothing special
    prof = q.column_profile(df)
    plan = prof._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 1
    got = {r.column_name: (r.non_null, r.approx_distinct) for r in prof.collect()}
    assert got == {"x": (2, 1), "y": (2, 1), "z": (3, 3), "w": (2, None), "y_": (2, 1)}
    empty = {r.column_name: (r.rows, r.non_null, r.approx_distinct) for r in q.column_profile(df.limit(0)).collect()}
    assert empty["x"] == (0, 0, 0) and empty["w"] == (0, 0, None)


def test_frequent_values_hold_every_heavy_value(spark):
    rows = [("hot", i % 3) for i in range(400)] + [(f"v{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, n long")
    got = {(r.column_name, r.value) for r in q.frequent_values(df, ["k", "n"], 0.1).collect()}
    assert {("k", "hot"), ("n", "0"), ("n", "1"), ("n", "2")} <= got  # 40 % and about 13.4 % each


def test_alert_subtotals_one_shuffle(spark):
    rows = [("info", "view", True), ("info", "click", True), ("warning", "view", True), ("info", "view", False),
            (None, "view", True)]
    df = spark.createDataFrame(rows, "level string, alert_type string, active boolean")
    got = q.alert_subtotals(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    want = {("info", "view", 0, 1), ("info", "click", 0, 1), ("warning", "view", 0, 1), (None, "view", 0, 1),
            ("info", None, 1, 2), ("warning", None, 1, 1), (None, None, 1, 1),
            (None, "view", 2, 3), (None, "click", 2, 1), (None, None, 3, 4)}
    assert {tuple(r) for r in got.collect()} == want
    assert q.alert_subtotals(df.limit(0)).collect() == []
