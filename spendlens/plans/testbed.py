"""Campaign tables derived from the star-schema test tables.

Each derived column is one arithmetic expression valid in Spark SQL and in DuckDB. The same text feeds the
DataFrame built here and the ``WITH`` prefix of the check SQL, so both engines start from equal inputs; the
operators on top are written independently on each side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 8, 1)

CAMPAIGN_COLUMNS = {
    "k": "o_orderkey",
    "campaign_id": "cast(o_orderkey as string)",
    "maid": "'M' || cast(o_custkey % 1000 as string)",
    "advertiser_name": "c_name",
    "partner_name": "n_name",
    "gm": "r_name",
    "am": "'AM ' || cast(o_custkey % 7 as string)",
    "optimizer": "'OPT ' || cast(o_custkey % 11 as string)",
    "bid_name": "'BID ' || cast(o_custkey % 31 as string)",
    "channel": "o_orderpriority",
    "product": "'Brand#' || cast(1 + o_orderkey % 27 as string)",
    "business_category": "c_mktsegment",
    "campaign_name": (
        "case o_orderkey % 4"
        " when 0 then 'SEM | ' || c_mktsegment || ' - ' || cast(o_orderkey % 97 as string)"
        " when 1 then 'The ' || c_mktsegment || ' Campaign ' || cast(o_orderkey % 89 as string)"
        " when 2 then 'Search-' || cast(1000 + o_orderkey % 50 as string) || '-' || c_mktsegment"
        " else 'in of on' end"
    ),
    "campaign_budget": "floor(o_totalprice * 2) / 1e2",
    "amount_spent": "floor(floor(o_totalprice * 2) * (o_orderkey % 13) / 10) / 1e2",
    "running_cid_leads": "o_orderkey % 12",
    "clicks": "(o_orderkey % 12) * (5 + o_orderkey % 9) + (o_orderkey % 4) * 35",
    "io_cycle": "o_orderkey % 9",
    "avg_cycle_length": "cast(28 + o_orderkey % 5 as double)",
    "days_elapsed": "o_orderkey % 46",
    "cpl_goal": (
        "case o_orderkey % 10 when 0 then null when 1 then 0e0"
        " else cast(60 + (o_orderkey % 17) * 15 as double) end"
    ),
    "bsc_cpl_avg": (
        "case when o_orderkey % 53 = 52 then null"
        " else cast(120 + (length(c_mktsegment) % 5) * 15 as double) end"
    ),
    "bsc_cpc_average": "case when o_orderkey % 59 = 58 then null else 2 + (o_orderkey % 5) * 5e-1 end",
    "advertiser_product_count": "1 + o_orderkey % 3",
    "true_product_count": "case when o_orderkey % 7 = 6 then null else 1 + o_orderkey % 3 end",
    "true_months_running": "cast(o_orderkey % 14 as double)",
    "utilization": "(o_orderkey % 30) / 1e1",
    "snapshot_date": "cast(o_orderdate as date)",
    "extracted_at": "o_orderdate",
}

# Built on the columns above.
CAMPAIGN_RATES = {
    "running_cid_cpl": "case when running_cid_leads > 0 then amount_spent / running_cid_leads end",
    "avg_cpc": "case when clicks > 0 then amount_spent / clicks end",
}

HISTORY_KEYS = {
    "campaign_id": "l_orderkey + case when l_orderkey % 10 = 7 then 1000000000000 else 0 end",
    "report_month": "cast(date_trunc('month', l_shipdate) as date)",
    "maid": "'M' || cast(o_custkey % 1000 as string)",
    "business_name": "n_name",
    "campaign_name": CAMPAIGN_COLUMNS["campaign_name"],
    "business_category": "c_mktsegment",
    "channel": "o_orderpriority",
}

OPPORTUNITY_COLUMNS = {
    "opportunity_name": "'OPP ' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string)",
    "partner_name": "s_name",
    "stage": (
        "case when l_returnflag = 'A' then 'Closed Won' when l_returnflag = 'R' then 'Closed Lost'"
        " when l_linestatus = 'O' then 'Proposal' end"
    ),
    "amount": "case when l_linenumber = 5 then null else l_extendedprice end",
    "close_date": "case when l_linenumber = 6 then null else cast(l_shipdate as date) end",
    "probability": "l_discount * 100",
    "created_date": "cast(o_orderdate as date)",
    "last_modified_date": "l_shipdate",
}

CATEGORY_METRICS = {
    "cpl_median": "6e1 + sum_size % 90",
    "cpc_median": "2e0 + (sum_size % 30) / 1e1",
    "ctr_median": "(1 + sum_size % 7) / 1e2",
    "budget_median": "1e3 + sum_size % 4000",
    "sample_size": "n_parts",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(columns: dict[str, str]):
    return [F.expr(e).alias(n) for n, e in columns.items()]


def _orders_with_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with account, partner and region. No hints: Spark broadcasts what it measures as small."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per campaign."""
    return _orders_with_accounts(spark, sf_dir).select(*_exprs(CAMPAIGN_COLUMNS)).select("*", *_exprs(CAMPAIGN_RATES))


def monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend and leads per campaign and month."""
    month = HISTORY_KEYS["report_month"]
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.expr(month).alias("report_month"),
        F.expr("cast(floor(l_extendedprice * l_discount * 100) as bigint)").alias("cents"),
        F.expr("cast(l_quantity as bigint)").alias("units"),
    )
    # The other keys depend on the order alone, so lines are added up before the accounts are joined. An order and month
    # has about one line, so lines go to the task of their order at once, where both the sums and the join find them.
    totals = lines.repartition("l_orderkey").groupBy("l_orderkey", "report_month").agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))
    keys = {n: e for n, e in HISTORY_KEYS.items() if n != "report_month"}
    return totals.join(_orders_with_accounts(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_exprs(keys),
        "report_month",
        (F.col("cents") / 1e2).alias("spend"),
        F.expr("units % 11").alias("leads"),
        F.expr("case when units % 11 > 0 then (cents / 1e2) / (units % 11) end").alias("cost_per_lead"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sales opportunity per order line, owned by the supplying partner."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(*_exprs(OPPORTUNITY_COLUMNS))
    )


def partner_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget movement per partner and day."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.expr("cast(l_shipdate as date)").alias("snapshot_date"),
        F.expr("cast(floor(l_extendedprice * 100) as bigint)").alias("cents"),
        F.expr("cast(l_quantity as bigint)").alias("units"),
        F.expr("case when l_returnflag = 'N' then 1 else 0 end").alias("is_new"),
        F.expr("case when l_returnflag = 'R' then 1 else 0 end").alias("is_lost"),
    )
    daily = lines.groupBy("l_suppkey", "snapshot_date").agg(
        F.sum("cents").alias("cents"),
        F.sum("units").alias("starting_clients"),
        F.sum("is_new").alias("new_clients"),
        F.sum("is_lost").alias("churned_clients"),
    )
    return daily.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("advertiser_name"),
        "snapshot_date",
        (F.col("cents") / 1e2).alias("budgets"),
        "starting_clients",
        (F.col("starting_clients") + F.col("new_clients") - F.col("churned_clients")).alias("ending_clients"),
        "new_clients",
        "churned_clients",
    )


def brand_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per product brand, two snapshots (0 and 1)."""
    stats = (
        table(spark, sf_dir, "part")
        .groupBy(F.lower("p_brand").alias("key"), F.expr("p_size % 2").alias("snapshot_id"))
        .agg(F.sum("p_size").alias("s"), F.count("*").alias("sample_size"))
    )
    return stats.select(
        "key",
        "snapshot_id",
        F.expr("case when snapshot_id = 0 then date '2001-01-31' else date '2001-07-31' end").alias("snapshot_date"),
        F.expr("(48 + s % 80) * 1e0").alias("cpl_top25"),
        F.expr("case when s % 9 = 0 then null else (90 + s % 80) * 1e0 end").alias("cpl_median"),
        F.expr("(190 + s % 80) * 1e0").alias("cpl_bot25"),
        F.expr("2 + (s % 30) / 1e1").alias("cpc_median"),
        "sample_size",
    )


def category_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians per (category, subcategory), two snapshots."""
    stats = (
        table(spark, sf_dir, "part")
        .groupBy(
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            F.expr("p_size % 2").alias("snapshot_id"),
        )
        .agg(F.sum("p_size").alias("sum_size"), F.count("*").alias("n_parts"))
    )
    return stats.select("category", "subcategory", "snapshot_id", *_exprs(CATEGORY_METRICS))


def diagnosis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagnosis request per order; its category is that of the order's first part."""
    first_part = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return (
        table(spark, sf_dir, "orders")
        .join(first_part, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts, F.col("partkey") == F.col("p_partkey"))
        .select(*_exprs(REQUEST_COLUMNS))
    )


REQUEST_COLUMNS = {
    "request_id": "o_orderkey",
    "category": "p_type",
    "subcategory": "p_brand",
    "budget": "floor(o_totalprice * 2) / 1e2",
    "clicks": "case when o_orderkey % 23 = 0 then 0 else (o_orderkey % 12) * 31 + o_orderkey % 300 end",
    "leads": "case when o_orderkey % 23 = 0 then 0 else o_orderkey % 41 end",
    "goal_cpl": "case when o_orderkey % 10 = 3 then null else cast(40 + (o_orderkey % 29) * 10 as double) end",
    "impressions": "case when o_orderkey % 8 = 5 then null else (o_orderkey % 500) * 100 end",
}


# ---------------------------------------------------------------------------------------------------------
# The same tables as WITH clauses for the check SQL.

def _sql_list(columns: dict[str, str]) -> str:
    return ",\n    ".join(f"{e} AS {n}" for n, e in columns.items())


_ACCOUNTS_SQL = """orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTE = {
    "camp": f"""camp AS (SELECT *, {_sql_list(CAMPAIGN_RATES)} FROM (
  SELECT {_sql_list(CAMPAIGN_COLUMNS)}
  FROM {_ACCOUNTS_SQL}))""",
    "hist": f"""hist AS (SELECT {", ".join(HISTORY_KEYS)}, cents / 1e2 AS spend, units % 11 AS leads,
    CASE WHEN units % 11 > 0 THEN (cents / 1e2) / (units % 11) END AS cost_per_lead
  FROM (SELECT {", ".join(HISTORY_KEYS)}, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(units) AS BIGINT) AS units FROM (
    SELECT {_sql_list(HISTORY_KEYS)},
      CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS units
    FROM lineitem JOIN ({"SELECT * FROM " + _ACCOUNTS_SQL}) oc ON l_orderkey = o_orderkey) GROUP BY ALL))""",
    "opps": f"""opps AS (SELECT {_sql_list(OPPORTUNITY_COLUMNS)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "waterfall": """waterfall AS (SELECT s_name AS advertiser_name, d AS snapshot_date, cents / 1e2 AS budgets,
    starting_clients, starting_clients + new_clients - churned_clients AS ending_clients, new_clients, churned_clients
  FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS starting_clients,
      count(*) FILTER (l_returnflag = 'N') AS new_clients, count(*) FILTER (l_returnflag = 'R') AS churned_clients
    FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey)""",
    "brand": """brand AS (SELECT key, snapshot_id,
    CASE WHEN snapshot_id = 0 THEN DATE '2001-01-31' ELSE DATE '2001-07-31' END AS snapshot_date,
    (48 + s % 80) * 1e0 AS cpl_top25, CASE WHEN s % 9 = 0 THEN NULL ELSE (90 + s % 80) * 1e0 END AS cpl_median,
    (190 + s % 80) * 1e0 AS cpl_bot25, 2 + (s % 30) / 1e1 AS cpc_median, sample_size
  FROM (SELECT lower(p_brand) AS key, p_size % 2 AS snapshot_id, CAST(sum(p_size) AS BIGINT) AS s, count(*) AS sample_size
    FROM part GROUP BY 1, 2))""",
    "catbench": f"""catbench AS (SELECT category, subcategory, snapshot_id, {_sql_list(CATEGORY_METRICS)}
  FROM (SELECT p_type AS category, p_brand AS subcategory, p_size % 2 AS snapshot_id,
      CAST(sum(p_size) AS BIGINT) AS sum_size, count(*) AS n_parts FROM part GROUP BY 1, 2, 3))""",
    "req": f"""req AS (SELECT {_sql_list(REQUEST_COLUMNS)}
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  JOIN part ON partkey = p_partkey)""",
}


def with_tables(*names: str) -> str:
    """``WITH`` prefix holding the named derived tables; callers append further clauses after a comma."""
    return "WITH " + ",\n".join(CTE[n] for n in names)
