"""Restored: drop-and-create of a catalog table, and one file per name."""

from __future__ import annotations

import datetime as dt

from spendlens.operators.tables import create_table
from spendlens.sources.files import distinct_files


def test_create_table_replaces_schema_and_rows(spark, folder):
    first = spark.createDataFrame([(1, "a")], "id long, name string")
    create_table(first, "restored_t", f"{folder}/t")
    second = spark.createDataFrame([(2.5,), (3.5,)], "amount double")
    got = create_table(second, "restored_t", f"{folder}/t")
    assert got.columns == ["amount"] and sorted(r.amount for r in got.collect()) == [2.5, 3.5]
    spark.sql("DROP TABLE restored_t")


def test_distinct_files_keeps_the_newest_per_name(spark):
    t = dt.datetime
    rows = [("/a/x.csv", "x.csv", t(2024, 1, 1)), ("/b/x.csv", "x.csv", t(2024, 3, 1)), ("/c/x.csv", "x.csv", t(2024, 3, 1)),
            ("/a/y.csv", "y.csv", None), ("/a/z", None, t(2024, 1, 1)), ("/b/z", None, t(2024, 1, 1))]
    files = spark.createDataFrame(rows, "path string, file_name string, modificationTime timestamp")
    got = sorted((r.path, r.file_name) for r in distinct_files(files).collect())
    assert got == [("/a/y.csv", "y.csv"), ("/a/z", None), ("/b/x.csv", "x.csv"), ("/b/z", None)]


def test_directory_pages_equal_offset_pages(spark):
    from spendlens.operators import book

    rows = [(str(i), float(i % 7) if i % 5 else None, float(i % 3), 0.1 * (i % 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "campaign_id string, priority_index double, revenue_at_risk double, churn_prob_90d double")
    directory = book.page_directory(df.repartition(5))
    for page in (1, 7, 20, 21):
        want = [r.campaign_id for r in book.account_page(df, page, 50).collect()]
        got = book.directory_page(directory, page, 50)
        assert [r.campaign_id for r in got.collect()] == want
    assert book.directory_page(directory, 99, 50).count() == 0
