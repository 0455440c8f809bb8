"""Cleaning, table maintenance, quality and document queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import cleaning as cl
from ..functions.columns import wall_time
from ..operators import quality as q
from ..operators import tables
from ..sources import files, reports
from . import ingest
from . import testbed as tb
from .registry import query, rounded

WHOLE = "cast(cast(floor(o_totalprice) as bigint) as string)"
YEAR, MONTH, DAY = (f"cast({p}(o_orderdate) as string)" for p in ("year", "month", "day"))
ISO = f"{YEAR} || '-' || lpad({MONTH}, 2, '0') || '-' || lpad({DAY}, 2, '0')"

# Report cells as they arrive, spelled from order values.
RAW = {
    "k": "o_orderkey",
    "amount_text": (
        f"case o_orderkey % 9 when 0 then '$' || {WHOLE} when 1 then ' ' || {WHOLE} || '.50 ' when 2 then '-' when 3 then 'N/A'"
        f" when 4 then 'USD ' || {WHOLE} when 5 then '' when 6 then '1.2.3' when 7 then '\"' || {WHOLE} || '\"' else {WHOLE} || ',000' end"
    ),
    "count_text": (
        f"case o_orderkey % 7 when 0 then {WHOLE} when 1 then '3.0' when 2 then 'x' when 3 then '1,234' when 4 then ' 7 '"
        " when 5 then '-12' else 'None' end"
    ),
    "due_date": (
        f"case o_orderkey % 5 when 0 then {ISO} when 1 then {MONTH} || '/' || {DAY} || '/' || {YEAR} when 2 then 'soon' when 3 then '' else 'NULL' end"
    ),
    "note": "case o_orderkey % 4 when 0 then '  \"' || o_orderpriority || '\" ' when 1 then 'None' when 2 then 'Not Entered' else o_orderpriority end",
    "contact": "case o_orderkey % 3 when 0 then 'user' || cast(o_custkey as string) || '@mail.example.com' when 1 then 'nobody' else 'a@b' end",
}
RAW_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + " FROM orders)"


def raw(spark, sf):
    return tb.table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in RAW.items()])


def _num_sql(text):
    return f"TRY_CAST({text} AS DOUBLE)"


@query("clean_amounts", f"""WITH {RAW_SQL} SELECT k,
{_num_sql("replace(replace(trim(amount_text), '$', ''), ',', '')")} AS pipeline,
{_num_sql("replace(replace(replace(trim(amount_text), '$', ''), ',', ''), chr(34), '')")} AS agreed,
{_num_sql("replace(replace(replace(replace(trim(amount_text), 'USD', ''), '$', ''), ',', ''), chr(34), '')")} AS grader,
{_num_sql("trim(trim(amount_text), chr(34))")} AS alert,
{_num_sql("regexp_replace(amount_text, '[^0-9.-]', '', 'g')")} AS by_name FROM raw""")
def _(spark, sf):
    c = F.col("amount_text")
    return raw(spark, sf).select(
        "k", cl.clean_number(c, cl.PIPELINE_CELLS).alias("pipeline"), cl.clean_number(c, cl.AGREED_CPL_CELLS).alias("agreed"),
        cl.clean_number(c, cl.GRADER_CELLS).alias("grader"), cl.clean_number(c, cl.ALERT_CELLS).alias("alert"),
        cl.numeric_cell(c).alias("by_name"))


@query("clean_counts", f"""WITH {RAW_SQL} SELECT k, CAST(trunc({_num_sql("trim(count_text)")}) AS BIGINT) AS pipeline,
CAST(trunc({_num_sql("replace(trim(count_text), ',', '')")}) AS BIGINT) AS agreed,
CASE WHEN regexp_matches(trim(count_text), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(count_text) AS BIGINT) END AS alert FROM raw""")
def _(spark, sf):
    c = F.col("count_text")
    return raw(spark, sf).select(
        "k", cl.clean_integer(c, cl.PIPELINE_CELLS).alias("pipeline"), cl.clean_integer(c, cl.AGREED_CPL_CELLS).alias("agreed"),
        cl.clean_integer(c, cl.ALERT_CELLS).alias("alert"))


@query("clean_dates_and_texts", f"""WITH {RAW_SQL} SELECT k, CAST(CASE WHEN k % 5 < 2 THEN o_orderdate END AS DATE) AS due_date,
CASE WHEN k % 4 IN (0, 3) THEN o_orderpriority END AS note, k % 3 = 0 AS valid_email,
coalesce({_num_sql("amount_text")} > 0, false) AS valid_amount, k % 5 = 0 AS valid_date FROM raw JOIN orders ON k = o_orderkey""")
def _(spark, sf):
    return raw(spark, sf).select(
        "k", cl.clean_date("due_date").alias("due_date"), cl.clean_text("note", cl.AGREED_CPL_CELLS).alias("note"),
        cl.valid_email("contact").alias("valid_email"), cl.valid_positive("amount_text").alias("valid_amount"),
        cl.valid_date("due_date").alias("valid_date"))


@query("clean_table_by_name", f"""WITH {RAW_SQL} SELECT k, CASE WHEN note NOT IN ('', 'NULL') THEN note END AS note,
{_num_sql("regexp_replace(amount_text, '[^0-9.-]', '', 'g')")} AS amount_text, CAST(CASE WHEN k % 5 < 2 THEN o_orderdate END AS DATE) AS due_date,
o_orderdate::DATE AS snapshot_date FROM raw JOIN orders ON k = o_orderkey""")
def _(spark, sf):
    named = raw(spark, sf).join(
        tb.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), F.col("k") == F.col("o_orderkey"))
    rows = named.select(F.col("k").cast("string").alias("k"), "note", "amount_text", "due_date",
                        F.concat(F.lit("sf_partner_pipeline_"), "d", F.lit(".csv")).alias("source_file"))
    out = ingest.add_metadata(ingest.clean_table(rows), dt.datetime(2001, 8, 1, 6), tb.AS_OF)
    return out.select(F.col("k").cast("bigint").alias("k"), "note", "amount_text", "due_date", "snapshot_date")


# RE2 spells Unicode word characters and blanks as classes.
WORD, BLANK = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"[\s\x0b\x85\p{Z}]"


@query("unicode_text_compat", f"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
translate(coalesce(text, ''), chr(65279), ''), '({WORD}){BLANK}+({WORD})', '\\1\\2', 'g'), '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""")
def _(spark, sf):
    text = cl.unicode_text("text")
    return tb.table(spark, sf, "documents").select("doc_id", F.char_length(text).cast("bigint").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


@query("unicode_text_collapse", f"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(
translate(coalesce(text, ''), chr(65279), ''), '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""")
def _(spark, sf):
    text = cl.unicode_text("text", "collapse")
    return tb.table(spark, sf, "documents").select("doc_id", F.char_length(text).cast("bigint").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


@query("utilization_fractions", f"""{tb.with_tables("camp")} SELECT campaign_id, CASE
  WHEN pct > 300 AND campaign_budget <> 0 THEN amount_spent / (campaign_budget / avg_cycle_length * least(greatest(amount_spent / (campaign_budget / avg_cycle_length), 0.5e0), avg_cycle_length)) * 100 / 100
  WHEN pct <> 0 THEN pct / 100 END AS fraction FROM (SELECT *, (k % 45) * 10e0 AS pct FROM camp)""")
def _(spark, sf):
    rows = tb.campaigns(spark, sf).withColumn("pct", (F.col("k") % 45) * 10.0)
    return rows.select("campaign_id", cl.percent_to_fraction("pct", "amount_spent", "campaign_budget", "avg_cycle_length").alias("fraction"))


@query("upsert", """WITH ch AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS k, l_extendedprice AS amount, l_returnflag AS status, l_shipdate, l_linenumber, l_partkey FROM lineitem),
last AS (SELECT k, amount, status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM ch WHERE k IS NOT NULL) WHERE rn = 1)
SELECT k, amount, status FROM last UNION ALL SELECT k, amount, status FROM ch WHERE k IS NULL
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT k FROM last)""")
def _(spark, sf):
    current = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    changes = tb.table(spark, sf, "lineitem").select(
        F.expr("case when l_linenumber = 7 then null else l_orderkey end").alias("k"), F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("status"), "l_shipdate", "l_linenumber", "l_partkey")
    return tables.upsert(current, changes, ["k"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("k", "amount", "status")


@query("unseen_rows", "SELECT o_orderkey AS k, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    staged = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"))
    stored = tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return tables.unseen_rows(staged, stored, ["k"])


@query("new_categories", """SELECT DISTINCT p_type AS category, p_brand AS subcategory, p_type || ' - ' || p_brand AS display_name, true AS active FROM part
WHERE (p_type, p_brand) NOT IN (SELECT (p_type, p_brand) FROM part WHERE p_size = 7)""")
def _(spark, sf):
    part = tb.table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"), "p_size")
    return tables.add_categories(part.where("p_size = 7"), part)


# ---- logs --------------------------------------------------------------------------------------------------

def run_log(spark, sf):
    return tb.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"),
        F.col("event_type").alias("group"), (F.col("value") < 50).alias("success"),
        F.when(F.col("event_type").isin("view", "click"), "extract").otherwise("load").alias("phase"), "value")


def alert_log(spark, sf):
    return tb.table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("alert_type"),
        F.when(F.col("value") > 100, "critical").when(F.col("value") > 20, "warning").otherwise("info").alias("level"),
        (F.col("event_id") % 3 != 0).alias("active"))


ALERT_SQL = """WITH al AS (SELECT event_id AS alert_id, ts AS created_at, event_type AS alert_type, CASE WHEN value > 100 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS level,
event_id % 3 <> 0 AS active FROM events)"""


@query("alert_counts", f"""{ALERT_SQL} SELECT 'level' AS dimension, level AS value, count(*) AS alerts FROM al WHERE active GROUP BY 1, 2
UNION ALL SELECT 'type', alert_type, count(*) FROM al WHERE active GROUP BY 1, 2""")
def _(spark, sf):
    return q.alert_counts(alert_log(spark, sf))


@query("alert_subtotals", f"""{ALERT_SQL} SELECT level, alert_type, GROUPING(level, alert_type) AS "grouping", count(*) AS alerts
FROM al WHERE active GROUP BY CUBE (level, alert_type)""")
def _(spark, sf):
    return q.alert_subtotals(alert_log(spark, sf))


@query("recent_alerts", f"{ALERT_SQL} SELECT * FROM al ORDER BY created_at DESC, alert_id DESC LIMIT 10")
def _(spark, sf):
    return q.recent_alerts(alert_log(spark, sf))


@query("alerts_last_24h", f"{ALERT_SQL} SELECT alert_id, level FROM al WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00'")
def _(spark, sf):
    return q.within_hours(alert_log(spark, sf), dt.datetime(2024, 1, 30, 12), 24).select("alert_id", "level")


@query("last_executions", """SELECT run_id, job_id, started_at, CAST(rn AS INTEGER) AS recency FROM (SELECT event_id AS run_id, user_id AS job_id, ts AS started_at,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def _(spark, sf):
    return q.last_executions(run_log(spark, sf)).select("run_id", "job_id", "started_at", "recency")


@query("run_summary", "SELECT event_type AS \"group\", count(*) FILTER (value < 50) AS succeeded, count(*) AS total FROM events GROUP BY 1")
def _(spark, sf):
    return q.run_summary(run_log(spark, sf))


@query("run_status", """SELECT *, CASE WHEN succeeded = total THEN 'all' WHEN succeeded > 0 THEN 'some' ELSE 'none' END AS outcome,
CASE WHEN succeeded = total THEN 0 WHEN succeeded > 0 THEN 1 ELSE 2 END AS exit_code, CASE WHEN succeeded = total THEN 'INFO' WHEN succeeded > 0 THEN 'WARN' ELSE 'CRIT' END AS level
FROM (SELECT count(*) FILTER (value < 50) AS succeeded, count(*) AS total FROM events)""")
def _(spark, sf):
    return q.run_status(run_log(spark, sf))


@query("pipeline_status", """SELECT *, CASE WHEN (extractions = 0 OR extracted > 0) AND failed_loads = 0 THEN 'completed' ELSE 'partial' END AS status FROM (
SELECT count(*) FILTER (event_type IN ('view', 'click')) AS extractions, count(*) FILTER (event_type IN ('view', 'click') AND value < 50) AS extracted,
count(*) FILTER (event_type NOT IN ('view', 'click') AND value >= 50) AS failed_loads FROM events)""")
def _(spark, sf):
    return q.pipeline_status(run_log(spark, sf))


@query("health_alerts", """WITH m AS (SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2024-01-31 06:00:00') / 3600e0 AS h, count(*) FILTER (value >= 50) AS f FROM events GROUP BY 1)
SELECT user_id, 'data_quality' AS alert_type, CASE WHEN h < 48 THEN 'warning' ELSE 'error' END AS level FROM m WHERE h > 26
UNION ALL SELECT user_id, 'job_failed', 'warning' FROM m WHERE f > 3""")
def _(spark, sf):
    as_of = wall_time(dt.datetime(2024, 1, 31, 6))
    metrics = tb.table(spark, sf, "events").groupBy("user_id").agg(
        (F.timestamp_diff("SECOND", F.max("ts"), as_of) / F.lit(3600.0)).alias("freshness_hours"),
        F.count_if(F.col("value") >= 50).alias("failed_jobs_24h"))
    return q.health_alerts(metrics).select("user_id", "alert_type", "level")


@query("load_checks", """SELECT count(*) AS total_rows, count(*) FILTER (amount IS NULL) AS amount_nulls, count(*) FILTER (stage IS NULL) AS stage_nulls,
min(last_modified_date) AS min_date, max(last_modified_date) AS max_date FROM opps""".join([f"{tb.with_tables('opps')} ", ""]))
def _(spark, sf):
    return q.load_checks(tb.opportunities(spark, sf), ["amount", "stage"], "last_modified_date")


@query("load_status", f"""{tb.with_tables("camp")} SELECT 'campaigns' AS table_name, count(*) AS total_rows, max(extracted_at) AS last_load,
count(DISTINCT snapshot_date) AS unique_extract_dates, 'healthy' AS status FROM camp""")
def _(spark, sf):
    return q.load_status(tb.campaigns(spark, sf), "campaigns")


COVERED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"} | dict.fromkeys((
    "customer", "supplier", "part", "region", "nation", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))
COVERAGE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {f'CAST(max({d}) AS DATE)' if d else 'NULL::DATE'} AS latest_date FROM {t}" for t, d in COVERED.items())


def _coverage(spark, sf):
    return q.table_coverage({t: (tb.table(spark, sf, t), d) for t, d in COVERED.items()})


@query("table_coverage", COVERAGE_SQL)
def _(spark, sf):
    return _coverage(spark, sf)


@query("coverage_totals", f"""SELECT count(*) AS tables, count(*) FILTER (row_count > 0) AS tables_with_data, CAST(sum(row_count) AS BIGINT) AS total_rows,
arg_max(table_name, row_count) AS largest_table FROM ({COVERAGE_SQL})""")
def _(spark, sf):
    return q.coverage_totals(_coverage(spark, sf))


@query("data_freshness", """SELECT max(t) AS latest, round(date_diff('microsecond', max(t), TIMESTAMP '2024-01-31 06:00:00') / 3600e6, 6) AS freshness_hours
FROM (SELECT max(o_orderdate) AS t FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem UNION ALL SELECT max(ts) FROM events)""")
def _(spark, sf):
    pairs = [(tb.table(spark, sf, t), c) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return rounded(q.freshness_hours(pairs, dt.datetime(2024, 1, 31, 6)))


@query("reconcile_counts", """SELECT k, coalesce(a, 0) AS source_rows, coalesce(b, 0) AS target_rows, coalesce(a, 0) = coalesce(b, 0) OR coalesce(a, 0) = 0 AS matches
FROM (SELECT o_orderkey AS k, count(*) AS a FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS k, count(*) AS b FROM lineitem GROUP BY 1) USING (k)""")
def _(spark, sf):
    return q.reconcile_counts(tb.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k"),
                              tb.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")


@query("unknown_ids", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, sf):
    return q.unknown_ids(tb.table(spark, sf, "events"), tb.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "user_id"), "user_id")


LTV_NAMES = {"AUTOMOBILE": "Automotive -- For Sale", "MACHINERY": "Industrial & Commercial", "HOUSEHOLD": "Home & Home Improvement"}


@query("lifetime_value", """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automotive -- For Sale' WHEN 'MACHINERY' THEN 'Industrial & Commercial'
WHEN 'HOUSEHOLD' THEN 'Home & Home Improvement' ELSE c_mktsegment END AS business_category,
round(avg(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 98000 WHEN 'MACHINERY' THEN 92000 WHEN 'HOUSEHOLD' THEN 88000 ELSE 1297000 / 27e0 END), 4) AS average_ltv,
count(*) AS campaigns FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    rows = tb.campaigns(spark, sf).replace(LTV_NAMES, subset=["business_category"])
    return rounded(q.average_lifetime_value(rows), 4)


@query("table_profile", """SELECT (SELECT count(*) FROM supplier) AS rows, column_name, data_type, non_null, min_value, max_value FROM (
SELECT 's_suppkey' AS column_name, 'bigint' AS data_type, count(s_suppkey) AS non_null, CAST(min(s_suppkey) AS VARCHAR) AS min_value, CAST(max(s_suppkey) AS VARCHAR) AS max_value FROM supplier
UNION ALL SELECT 's_name', 'string', count(s_name), min(s_name), max(s_name) FROM supplier
UNION ALL SELECT 's_nationkey', 'int', count(s_nationkey), CAST(min(s_nationkey) AS VARCHAR), CAST(max(s_nationkey) AS VARCHAR) FROM supplier
UNION ALL SELECT 's_acctbal', 'double', count(s_acctbal), CAST(min(s_acctbal) AS VARCHAR), CAST(max(s_acctbal) AS VARCHAR) FROM supplier)""")
def _(spark, sf):
    return q.table_profile(tb.table(spark, sf, "supplier"))


@query("quoted_csv_lines", """SELECT o_orderkey AS k, 'said "' || o_orderpriority || '", ok' AS note, o_orderstatus AS status,
'x,' || o_custkey AS pair FROM orders""")
def _(spark, sf):
    line = F.expr("""concat(o_orderkey, ',"said ""', o_orderpriority, '"", ok",', o_orderstatus, ',"x,', o_custkey, '"')""")
    cells = F.from_csv(line, "k bigint, note string, status string, pair string", {k: str(v) for k, v in files.csv_options().items()})
    return tb.table(spark, sf, "orders").select(cells.alias("c")).select("c.*")


DATE_SPELLINGS = (
    "yyyy-MM-dd", "yyyy-MM-dd'T11:18:34'", "yyyy-MM-dd'T11:18:34.000+0000'", "yyyy-MM-dd' 11:18:34.123456'", "M/d/yyyy' 11:18 AM'", "d-MMM-yyyy",
    "M-d-yyyy", "MMM d yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "M/d/yyyy",
)


@query("date_spellings", f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % {len(DATE_SPELLINGS) + 1} < {len(DATE_SPELLINGS)} THEN o_orderdate::DATE END AS day FROM orders""")
def _(spark, sf):
    which = F.col("o_orderkey") % (len(DATE_SPELLINGS) + 1)
    text = F.lit("some day")
    for i, pattern in enumerate(DATE_SPELLINGS):
        text = F.when(which == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    return tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), cl.parse_date(text).alias("day"))


# ---- documents -----------------------------------------------------------------------------------------------

CRM_TEXT = """'{"reportMetadata":{"detailColumns":["NAME","AMOUNT","STAGE","OWNER"]},"reportExtendedMetadata":{"detailColumnInfo":{"NAME":{"label":"Opportunity Name"},"AMOUNT":{"label":"Amount"}}},"factMap":{"T!T":{"rows":['
|| case when l_linenumber % 2 = 0 then '' else '{"dataCells":[{"label":"N' || cast(l_partkey as string) || '","value":"n' || cast(l_partkey as string) || '"},{"label":"$' || cast(l_suppkey as string) || '","value":{"amount":' || cast(l_suppkey as string) || ',"currency":"USD"}},{"value":"' || l_returnflag || '"}]}' end
|| ']},"0!T":{"rows":[{"dataCells":[{"label":"G","value":"g"},{"value":' || cast(l_linenumber as string) || '},{"label":null,"value":null},{"label":"O","value":"o"},{"label":"more","value":"m"}]}]}}}'"""


def crm_reports(spark, sf):
    rows = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(CRM_TEXT).alias("text"))
    return reports.parse_crm_reports(rows)


CRM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("crm_report_all_blocks", """SELECT l_orderkey, l_linenumber, l_partkey, 'T!T' AS block, 'n' || l_partkey AS name, CAST(l_suppkey AS VARCHAR) AS amount, l_returnflag AS stage, NULL::VARCHAR AS owner
FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '0!T', 'g', CAST(l_linenumber AS VARCHAR), NULL, 'o' FROM lineitem""")
def _(spark, sf):
    rows = reports.flatten_all_blocks(crm_reports(spark, sf), CRM_KEYS)
    wide = reports.cells_to_columns(rows, ["Opportunity Name", "Amount", "STAGE", "OWNER"])
    return wide.select(*CRM_KEYS, "block", F.col("Opportunity Name").alias("name"), F.col("Amount").alias("amount"),
                       F.col("STAGE").alias("stage"), F.col("OWNER").alias("owner"))


@query("crm_repeated_labels", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS amount, CAST(l_suppkey AS VARCHAR) AS amount_2,
l_returnflag AS stage FROM lineitem""")
def _(spark, sf):
    text = F.expr("""'{"reportMetadata":{"detailColumns":["A","B","STAGE"]},"reportExtendedMetadata":{"detailColumnInfo":{"A":{"label":"Amount"},"B":{"label":"Amount"}}},"factMap":{"T!T":{"rows":[{"dataCells":[{"value":'
|| cast(l_partkey as string) || '},{"value":' || cast(l_suppkey as string) || '},{"value":"' || l_returnflag || '"}]}]}}}'""")
    rows = reports.parse_crm_reports(tb.table(spark, sf, "lineitem").select(*CRM_KEYS, text.alias("text")))
    wide = reports.cells_to_columns(reports.flatten_all_blocks(rows, CRM_KEYS), ["Amount", "Amount_2", "STAGE"])
    return wide.select(*CRM_KEYS, F.col("Amount").alias("amount"), F.col("Amount_2").alias("amount_2"), F.col("STAGE").alias("stage"))


@query("crm_report_first_block", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'T!T' ELSE '0!T' END AS block,
CASE WHEN l_linenumber % 2 = 1 THEN 'N' || l_partkey ELSE 'G' END AS name, CASE WHEN l_linenumber % 2 = 1 THEN '$' || l_suppkey ELSE CAST(l_linenumber AS VARCHAR) END AS amount,
CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag ELSE '' END AS stage, CASE WHEN l_linenumber % 2 = 0 THEN 'more' END AS extra FROM lineitem""")
def _(spark, sf):
    rows = reports.flatten_first_block(crm_reports(spark, sf), CRM_KEYS)
    wide = reports.cells_to_columns(rows, ["NAME", "AMOUNT", "STAGE", "Column_4"])
    return wide.select(*CRM_KEYS, "block", F.col("NAME").alias("name"), F.col("AMOUNT").alias("amount"), F.col("STAGE").alias("stage"), F.col("Column_4").alias("extra"))


BENCH_TEXT = """'{"version":"v' || cast(p_size as string) || '","records":{"_version":{},"' || p_type || '|' || p_brand || '":{"meta":{"category":"' || p_type || '"},"cpl":{"median":' || cast(p_partkey as string)
|| ',"dms":{"top10":"' || cast(p_size as string) || '","avg":"n/a"}},"ctr":{"median":0.25},"sample_size":' || cast(p_size as string) || '}}}'"""


# Columns of a benchmark row, and what the test files fill of them; the others are NULL.
BENCH_COLUMNS = [f"{m}_{p}" for m, parts in (("cpl", reports.SPREAD), ("cpc", reports.SPREAD), ("ctr", reports.SPREAD), ("budget", reports.BUDGET_SPREAD))
                 for p in ("median", *parts)]
BENCH_FILLED = {"cpl_median": "CAST(p_partkey AS DOUBLE)", "cpl_top10": "CAST(p_size AS DOUBLE)", "ctr_median": "0.25e0"}


@query("benchmark_file_rows", f"""SELECT p_partkey, p_type || '|' || p_brand AS key, p_type AS category, 'unknown' AS subcategory,
{", ".join(f"{BENCH_FILLED.get(c, 'NULL::DOUBLE')} AS {c}" for c in BENCH_COLUMNS)}, p_size AS sample_size, NULL::VARCHAR AS confidence_level,
NULL::DOUBLE AS data_quality_score FROM part""")
def _(spark, sf):
    files = reports.parse_benchmark_files(tb.table(spark, sf, "part").select("p_partkey", F.expr(BENCH_TEXT).alias("text")))
    return reports.benchmark_rows(files, ["p_partkey"])


@query("benchmark_snapshots", """SELECT '2025-9-' || (1 + p_partkey % 28) || '-bench-' || p_partkey || '.json' AS source_file, 'v' || p_size AS version,
make_date(2025, 9, CAST(1 + p_partkey % 28 AS INTEGER)) AS snapshot_date, 1 AS records_count FROM part""")
def _(spark, sf):
    rows = tb.table(spark, sf, "part").select(
        F.expr("'2025-9-' || cast(1 + p_partkey % 28 as string) || '-bench-' || cast(p_partkey as string) || '.json'").alias("source_file"),
        F.expr(BENCH_TEXT).alias("text"))
    return reports.benchmark_snapshots(reports.parse_benchmark_files(rows)).select("source_file", "version", "snapshot_date", "records_count")


@query("event_property_fields", """SELECT event_id, k AS field, json_extract(props::JSON, '$.' || k)::VARCHAR AS value
FROM (SELECT event_id, props, unnest(json_keys(props::JSON)) AS k FROM events WHERE json_valid(props))""")
def _(spark, sf):
    docs = reports.as_variant(tb.table(spark, sf, "events"), "props")
    return reports.document_fields(docs, ["event_id"]).select("event_id", "field", "value")
