"""Trajectories: one pass over the history, months of a campaign over several names, array expressions bound once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spendlens.operators import trajectory

HISTORY = ("campaign_id bigint, report_month date, business_name string, campaign_name string, cost_per_lead double, "
           "leads bigint, spend double")
CAMPAIGNS = ("campaign_id string, partner_name string, campaign_name string, days_elapsed int, running_cid_cpl double, "
             "cpl_goal double")


def campaigns(spark, *rows):
    return spark.createDataFrame([(*r, 10, 100.0, 90.0) for r in rows], CAMPAIGNS)


def test_history_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(i % 7, dt.date(2025, 1 + i % 12, 1), "P", f"Zeta {i % 3}", 1.0 + i, 1, 1.0) for i in range(60)]
    hist = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), HISTORY)
    camps = campaigns(spark, ("1", "P", "Zeta one"), ("99", "P", "Zeta one"), ("98", "P", "of in"))
    got = {r["campaign_id"]: len(r["points"]) for r in trajectory.history_points(camps, hist).collect()}
    assert got == {"1": 9, "99": 12, "98": 12}
    assert read.value == len(rows)


def test_own_months_over_several_names(spark):
    months = [dt.date(2024 + m // 12, 1 + m % 12, 1) for m in range(20)]
    rows = [(70, month, ("P", "Q")[i % 2], f"name {i % 3}", float(i + 1), i, 1.0) for i, month in enumerate(months)]
    rows += [(70, None, "P", "name 9", 99.0, 5, 1.0), (None, months[-1], "P", "name 0", 7.0, 1, 1.0), (71, months[0], None, None, 3.0, 1, 1.0)]
    hist = spark.createDataFrame(rows, HISTORY)
    camps = campaigns(spark, ("70", "P", "x"), ("71", "P", "y"), ("71", None, None), ("not a number", "P", "name 0"),
                      (None, "P", "name 0"), (None, "", "name 0"))
    out = trajectory.history_points(camps, hist).select("campaign_id", "partner_name", "points").collect()
    points = {(r[0], r[1]): r[2] and [(p["_pos"], p["month"], p["cpl"]) for p in r[2]] for r in out}
    assert len(out) == 6
    newest = [(None, 99.0)] + [(m, float(i + 1)) for i, m in reversed(list(enumerate(months)))][:11]
    assert points["70", "P"] == [(i + 1, *p) for i, p in enumerate(newest)]
    assert points["71", "P"] == points["71", None] == [(1, months[0], 3.0)]
    # Names 'name 0' and 'name 9' of P hold the keyword 'name', as does 'name 1' and 'name 2'.
    borrowed = points["not a number", "P"]
    assert borrowed == points[None, "P"] and points[None, ""] is None
    assert borrowed[:3] == [(1, None, 99.0), (2, months[-1], 7.0), (3, months[18], 19.0)] and len(borrowed) == 12


def test_sparkline_bounds_are_computed_once_per_series(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],)], "v array<double>")
    plan = df.select(trajectory.sparkline_of(F.col("v")).alias("s"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_min(") == 1 and text.count("slice(") == 1
    assert plan.first().s == [0, 100, 50]
