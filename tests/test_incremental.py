import datetime as dt

from pyspark.sql import functions as F

from spendlens.operators import incremental as inc
from spendlens.operators import performance as ops
from spendlens.plans.performance_queries import performance
from spendlens.plans.registry import rounded


def _rows(df):
    return sorted(tuple(r) for r in rounded(df, 4).collect())


def _days(df):
    return sorted(r[0] for r in df.select("snapshot_date").distinct().collect())


def test_refresh_of_one_day_equals_full_result(spark, small, folder):
    perf = performance(spark, small)
    days = _days(perf)
    inc.refresh_dashboard(perf, days[:-1], folder)
    got = inc.refresh_dashboard(perf.where(F.col("snapshot_date") == days[-1]), days[-1:], folder)
    assert _rows(got) == _rows(ops.executive_dashboard(perf))


def test_changed_and_removed_days(spark, small, folder):
    perf = performance(spark, small)
    days = _days(perf)
    inc.refresh_dashboard(perf, days, folder)
    changed, gone = days[0], days[len(days) // 2]
    new_rows = perf.where(F.col("snapshot_date") == changed).where(F.col("campaign_id") % 2 == 0).withColumn(
        "actual_spend", F.col("actual_spend") * 2)
    got = inc.refresh_dashboard(new_rows, [changed, gone], folder)
    whole = perf.where(~F.col("snapshot_date").isin(changed, gone)).unionByName(new_rows)
    assert _rows(got) == _rows(ops.executive_dashboard(whole))


def test_null_names_count_in_sums_only_and_empty_month_goes(spark, folder):
    schema = ("campaign_name string, actual_spend double, leads long, clicks long, actual_cpl double, "
              "actual_cpc double, cpl_performance_tier string, snapshot_date date, extracted_at timestamp")
    d1, d2 = dt.date(2001, 1, 5), dt.date(2001, 2, 5)
    t = dt.datetime(2001, 1, 1)
    rows = spark.createDataFrame([
        ("a", 1.0, 1, 2, 1.0, None, "good", d1, t), (None, 2.0, None, 1, None, 0.5, None, d1, t),
        ("a", 3.0, 0, 0, 3.0, 1.0, "excellent", d2, t), ("b", None, 2, 4, None, None, "excellent", d2, t),
    ], schema)
    got = inc.refresh_dashboard(rows, [d1, d2], folder)
    assert _rows(got) == _rows(ops.executive_dashboard(rows))
    assert {r.month: r.total_campaigns for r in got.collect()} == {dt.date(2001, 1, 1): 1, dt.date(2001, 2, 1): 2}
    got = inc.refresh_dashboard(rows.limit(0), [d2], folder)  # February loses its only day
    assert [r.month for r in got.collect()] == [dt.date(2001, 1, 1)]


def test_empty_first_build(spark, folder):
    rows = performance(spark, "/root/testdata/sf0.001").limit(0)
    assert inc.refresh_dashboard(rows, [], folder).count() == 0


def test_new_names_get_dense_unique_ids(spark, small, folder):
    perf = performance(spark, small)
    days = _days(perf)
    inc.refresh_dashboard(perf, days[: len(days) // 2], folder)
    inc.refresh_dashboard(perf, days[len(days) // 2 :], folder)
    names = spark.read.parquet(f"{folder}/names")
    n, lo, hi, distinct = names.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert (lo, hi, distinct) == (1, n, n)
    assert names.select("campaign_name").distinct().count() == n
