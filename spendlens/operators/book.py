"""The book of campaigns: summaries, partner and advertiser rollups, opportunities and account card metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import optional
from ..functions.numeric import filled, half_up, number, truthy
from ..shared import written
from .joins import newest_per_key

FACETS = {"partners": "partner_name", "ams": "am", "optimizers": "optimizer", "gms": "gm"}

# Tier labels counted as urgent, high and ready for an upsell by the consumers of a book.
URGENT_TIERS = ("P1 - CRITICAL", "P1 - URGENT")
HIGH_TIERS = ("P2 - HIGH",)
UPSELL_TIERS = ("P3 - MEDIUM", "P4 - LOW")


@dataclass(frozen=True)
class Playbook:
    """Products a partner's advertisers should own, and the least budget search needs."""

    name: str = "seo_dash"
    elements: tuple[str, ...] = ("Search", "SEO", "DASH")
    min_search_budget: float = 2500.0

    @property
    def label(self) -> str:
        return self.name.replace("_", " ").title()


def filter_book(book: DataFrame, **equal) -> DataFrame:
    """Equality filters over partner_name, advertiser_name, am, optimizer and gm; None means any."""
    for name, value in equal.items():
        if value is not None:
            book = book.where(F.col(name) == F.lit(value))
    return book


def book_summary(book: DataFrame, urgent: Sequence[str] = URGENT_TIERS, high: Sequence[str] = HIGH_TIERS) -> DataFrame:
    """Account and tier counts, and the budget at risk.

    When no money is at risk anywhere, the budgets of urgent and high campaigns stand in for it.
    """
    tier = F.col("priority_tier")
    pressing = tier.isin(*urgent, *high)
    at_risk = F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0))
    stand_in = F.coalesce(F.sum(F.when(pressing, F.col("campaign_budget"))), F.lit(0.0))
    return book.agg(
        F.count("*").alias("total_accounts"),
        F.count_if(tier.isin(*urgent)).alias("p1_critical"),
        F.count_if(tier.isin(*high)).alias("p2_high"),
        F.when(at_risk == 0, stand_in).otherwise(at_risk).alias("budget_at_risk"),
        F.coalesce(F.sum("campaign_budget"), F.lit(0.0)).alias("total_budget"),
    )


def book_facets(book: DataFrame) -> DataFrame:
    """Filter choices as (facet, value) rows. Long rows instead of one array keep any number of partners cheap."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in FACETS.items()]
    )
    return book.select(F.inline(pairs)).where((F.col("value").isNotNull()) & (F.col("value") != "")).distinct()


def by_priority(book: DataFrame) -> DataFrame:
    """Account list order: unknown priorities first, then index, money and churn down, id up."""
    return book.orderBy(
        F.desc_nulls_first("priority_index"),
        F.desc_nulls_first("revenue_at_risk"),
        F.desc_nulls_first("churn_prob_90d"),
        F.asc("campaign_id"),
    )


def account_page(book: DataFrame, page: int, size: int = 50) -> DataFrame:
    """One page of the account list. Spark keeps only the first ``page * size`` rows of every partition."""
    return by_priority(book).offset((page - 1) * size).limit(size)


def page_directory(book: DataFrame) -> DataFrame:
    """The account list in its order, written once to the shared folder, each row with its sort range (``_part``) and
    its place inside it (``_at``). A range is one file, so a later page reads only the files of its ranges (their
    statistics on ``_part`` prune the rest) whatever its depth; no task ever gathers the rows before the page."""
    ordered = by_priority(book)
    numbered = ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    return written(numbered, "account-order")


def directory_page(directory: DataFrame, page: int, size: int = 50) -> DataFrame:
    """Page ``page`` (from 1) of a page_directory: counts per range (one row each) locate the ranges that hold places
    (page - 1) * size to page * size - 1; only their rows are read and numbered. Columns of the book plus position."""
    first, end = (page - 1) * size, page * size
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = directory.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranges = ranges.where((F.col("_offset") < end) & (F.col("_offset") + F.col("_n") > first))
    wanted = [(r["_part"], r["_offset"]) for r in ranges.collect()]  # the few ranges that hold the page
    if not wanted:
        return directory.where(F.lit(False)).drop("_part", "_at").withColumn("position", F.lit(0).cast("long"))
    offsets = directory.sparkSession.createDataFrame(wanted, "_part int, _offset long")
    rows = directory.where(F.col("_part").isin([p for p, _ in wanted])).join(F.broadcast(offsets), "_part")
    position = F.col("_offset") + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    rows = rows.withColumn("position", position).where((F.col("position") >= first) & (F.col("position") < end))
    return rows.orderBy("position").drop("_part", "_at", "_offset")


def partner_rollup(book: DataFrame, upsell: Sequence[str] = UPSELL_TIERS) -> DataFrame:
    """Budget, product counts and readiness per partner; an unknown product count is one product."""
    products = F.coalesce(F.nullif(F.col("true_product_count").cast("int"), F.lit(0)), F.lit(1))
    return (
        book.where(F.col("partner_name").isNotNull())
        .groupBy("partner_name")
        .agg(
            F.coalesce(F.sum("campaign_budget"), F.lit(0.0)).alias("total_budget"),
            F.count_if(products == 1).alias("single_product_count"),
            F.count_if(products == 2).alias("two_product_count"),
            F.count_if(products > 2).alias("three_plus_product_count"),
            F.count_if(products == 1).alias("cross_sell_ready_count"),
            F.count_if(F.col("priority_tier").isin(*upsell)).alias("upsell_ready_count"),
        )
    )


def advertiser_rollup(book: DataFrame) -> DataFrame:
    """Campaigns, budget and categories per partner and advertiser.

    Categories are made distinct by a first aggregation, so the arrays hold no more than there are categories.
    """
    named = book.where(F.coalesce(F.col("advertiser_name"), F.lit("")) != "")
    per_category = named.groupBy("partner_name", "advertiser_name", "business_category").agg(
        F.count("*").alias("n"), F.sum("campaign_budget").alias("budget")
    )
    return per_category.groupBy("partner_name", "advertiser_name").agg(
        F.sum("n").alias("campaign_count"),
        F.coalesce(F.sum("budget"), F.lit(0.0)).alias("total_budget"),
        F.array_sort(F.collect_list("business_category")).alias("products"),
    )


def opportunity_rows(book: DataFrame, playbook: Playbook = Playbook(), upsell: Sequence[str] = UPSELL_TIERS) -> DataFrame:
    """Partner opportunities, one row per campaign and group it belongs to.

    Groups are rows, not arrays per partner, because one partner may own a large share of all campaigns.
    """
    count = F.coalesce(F.nullif(F.col("true_product_count").cast("int"), F.lit(0)), F.lit(1))
    budget = F.col("campaign_budget")
    too_low = filled(budget, 0.0) < playbook.min_search_budget
    groups = F.array_compact(
        F.array(
            F.when(count == 1, "single_ready").when(count == 2, "two_ready").otherwise("three_plus_ready"),
            F.when(F.col("priority_tier").isin(*upsell) & ~too_low, "scale_ready"),
            F.when(too_low, "too_low"),
        )
    )
    return book.select(
        "partner_name",
        F.explode(groups).alias("opportunity_group"),
        "campaign_id",
        "advertiser_name",
        budget.alias("budget"),
    ).withColumn(
        "recommended_budget",
        F.when(F.col("opportunity_group") == "scale_ready", half_up(filled("budget", 0.0) * 1.25))
        .when(F.col("opportunity_group") == "too_low", half_up(F.lit(playbook.min_search_budget)))
        .cast("bigint"),
    )


def opportunity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partner_name", "opportunity_group").agg(F.count("*").alias("campaigns"))


def with_missing_product(df: DataFrame, products: str, playbook: Playbook = Playbook()) -> DataFrame:
    """``missing_product``: the first playbook element an advertiser does not own."""
    elements = F.array(*[F.lit(e) for e in playbook.elements])
    gap = F.array_except(elements, F.coalesce(F.col(products), F.array().cast("array<string>")))
    return df.withColumn("missing_product", F.get(gap, 0))


def account_status(df: DataFrame) -> Column:
    p = F.col("churn_prob_90d")
    return (
        F.when(truthy("is_safe"), "safe").when(p >= 0.40, "critical").when(p >= 0.20, "warning").otherwise("monitoring")
    )


def lead_pacing(leads: Column, plan: Column) -> Column:
    """Leads against plan in percent, NULL without a plan."""
    return F.when(plan > 0, (F.try_divide(leads, plan) - 1) * 100)


def account_cards(book: DataFrame) -> DataFrame:
    """Metrics of an account card: status, pacing, CPL against goal, display names and team."""
    leads, plan = number("running_cid_leads"), number(optional(book, "expected_leads_to_date"))
    goal, cpl = number("cpl_goal"), number("running_cid_cpl")
    pacing = half_up(lead_pacing(leads, plan))
    shown = F.coalesce(pacing.cast("double"), number("utilization"))
    advertiser = _first_text(book, "advertiser_name", "business_name", "account_name")
    campaign = _first_text(book, "campaign_name", "bid_name")
    key = lambda c: F.lower(F.trim(c))
    partner = F.coalesce(F.col("partner_name"), F.lit(""))
    name = F.coalesce(advertiser, campaign, F.lit("Unknown Advertiser"))
    display = F.when((key(name) == key(partner)) & campaign.isNotNull(), campaign).otherwise(name)
    team = F.concat_ws(" / ", *[F.nullif(F.col(c), F.lit("")) for c in ("optimizer", "am", "gm")])
    return book.withColumns(
        {
            "status": account_status(book),
            "lead_pacing_pct": pacing,
            "cpl_delta_pct": F.when((goal > 0) & cpl.isNotNull(), half_up((F.try_divide(cpl, goal) - 1) * 100)),
            "pacing_text": F.when(shown.isNull(), "—")
            .when(shown < -25, "Behind")
            .when(shown > 25, "Ahead")
            .otherwise("On track"),
            "display_name": display,
            "show_partner": (partner != "") & (key(partner) != key(display)),
            "team": F.when(team == "", "—").otherwise(team),
        }
    )


def _first_text(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[F.nullif(optional(df, n, "string"), F.lit("")) for n in names])


def positive_pills(book: DataFrame) -> Column:
    """Pills of a safe account, at most four."""
    leads, plan = filled("running_cid_leads", 0.0), optional(book, "expected_leads_to_date")
    pacing = lead_pacing(leads, plan)
    on_pace = F.when(pacing.isNotNull(), pacing.between(-25, 25)).otherwise(F.col("utilization").between(0.9, 1.15))
    cpl, goal = F.col("running_cid_cpl"), F.coalesce(optional(book, "effective_cpl_goal"), F.col("cpl_goal"))
    pill = lambda test, text, kind: F.when(test, F.struct(F.lit(text).alias("text"), F.lit(kind).alias("type")))
    return F.slice(
        F.array_compact(
            F.array(
                pill(F.lit(True), "Performing", "success"),
                pill(on_pace, "Good Pacing", "info"),
                pill(cpl < goal, "CPL Below Goal", "info"),
                pill((leads > 0) & (leads >= plan), "Strong Lead Volume", "info"),
            )
        ),
        1,
        4,
    )


def cpl_badge(cpl, goal) -> tuple[Column, Column, Column]:
    """Performance class, ratio and percent of goal of a CPL."""
    ratio = F.try_divide(F.col(cpl), F.col(goal))
    good = F.when(ratio <= 1.0, "perf-good").when(ratio <= 1.2, "perf-ok").when(ratio.isNotNull(), "perf-bad")
    return good, ratio, half_up(ratio * 100)


def campaign_rollup(history: DataFrame) -> DataFrame:
    """Campaign-level model input from monthly rows, with the constants assumed where nothing is known."""
    months = F.count("*")
    rolled = history.where(F.col("campaign_id").isNotNull()).groupBy(F.col("campaign_id").cast("string").alias("campaign_id")).agg(
        F.min("maid").alias("maid"),
        F.min("business_name").alias("advertiser_name"),
        F.min("business_category").alias("business_category"),
        F.min("campaign_name").alias("campaign_name"),
        F.expr("listagg(DISTINCT channel, ', ') WITHIN GROUP (ORDER BY channel)").alias("channel"),
        F.sum("spend").alias("amount_spent"),
        F.sum("leads").alias("running_cid_leads"),
        F.avg("cost_per_lead").alias("running_cid_cpl"),
        months.alias("months_of_data"),
        (months * 30).alias("days_elapsed"),
    )
    return rolled.where((F.col("running_cid_leads") > 0) | (F.col("amount_spent") > 0)).withColumns(
        {"campaign_budget": F.col("amount_spent") * 1.2}
        | {
            n: F.lit(v)
            for n, v in {
                "utilization": 0.8,
                "partner_name": "Partner",
                "optimizer": "Optimizer TBD",
                "am": "AM TBD",
                "gm": "GM TBD",
                "io_cycle": 1,
                "avg_cycle_length": 30.0,
                "current_priority": "P3 - MEDIUM",
            }.items()
        }
    )


def roster(history: DataFrame) -> DataFrame:
    """Distinct campaigns with constant partner and product count."""
    return history.where(F.col("campaign_id").isNotNull()).select(
        F.col("campaign_id").cast("string").alias("campaign_id"),
        "maid",
        F.col("business_name").alias("advertiser_name"),
        F.lit("Partner").alias("partner_name"),
        F.lit(1).alias("true_product_count"),
        "business_category",
    ).distinct()


def best_row_per_campaign(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per campaign: the largest budget, then the most leads, unknown values first."""
    kept = newest_per_key(
        rows.where(F.col("campaign_id").isNotNull() & F.col("advertiser_name").isNotNull() & (F.col("campaign_budget") > 0)),
        ["campaign_id"],
        [F.desc_nulls_first("campaign_budget"), F.desc_nulls_first("total_leads"), F.desc_nulls_first("report_month")],
    )
    return kept if limit is None else kept.orderBy("campaign_id").limit(limit)


def with_partner_contacts(rows: DataFrame, partners: DataFrame) -> DataFrame:
    """Team of the partner a campaign was sold under; the campaign's own account manager is the fallback."""
    info = partners.select(
        F.col("partner_bid").alias("bid"), F.col("am").alias("_am"), F.col("optimizer").alias("_opt"), F.col("gm").alias("_gm")
    )
    return (
        rows.drop("optimizer", "gm")
        .join(info, "bid", "left")
        .withColumns({"am": F.coalesce("_am", "am"), "optimizer": F.col("_opt"), "gm": F.col("_gm")})
        .drop("_am", "_opt", "_gm")
    )


def book_overview(book: DataFrame) -> DataFrame:
    return book.agg(
        F.count("*").alias("total_campaigns"),
        F.count_distinct("partner_name").alias("unique_partners"),
        F.count_distinct("advertiser_name").alias("unique_advertisers"),
        F.avg("campaign_budget").alias("avg_budget"),
        F.sum("amount_spent").alias("total_spent"),
        F.sum("running_cid_leads").alias("total_leads"),
    )


def history_depth(history: DataFrame) -> DataFrame:
    return history.agg(
        F.min("report_month").alias("earliest"),
        F.max("report_month").alias("latest"),
        F.count_distinct("campaign_id").alias("unique_campaigns"),
        F.count("*").alias("total_records"),
        F.count_distinct("business_name").alias("unique_businesses"),
    )


def history_coverage(book: DataFrame, history: DataFrame) -> DataFrame:
    """How many campaigns have history, and their share. One semi-join flag, one aggregation."""
    ids = history.select(F.col("campaign_id").cast("string").alias("campaign_id")).distinct().withColumn("_seen", F.lit(True))
    flagged = book.select("campaign_id").join(ids, "campaign_id", "left")
    return flagged.agg(
        F.count_distinct(F.when(F.col("_seen"), F.col("campaign_id"))).alias("with_history"), F.count("*").alias("campaigns")
    ).withColumn("share_pct", F.try_divide("with_history", "campaigns") * 100)


def current_snapshot(snapshots: DataFrame) -> DataFrame:
    """The snapshot flagged current, else the newest one."""
    order = F.struct(F.coalesce("is_current", F.lit(False)), "snapshot_date", "file_name")
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), order).alias("s")).where("s is not null").select("s.*")


def current_or_default_snapshot(snapshots: DataFrame, now: Column) -> DataFrame:
    """The current snapshot, or for an empty registry one row that stands for the database itself."""
    default = {
        "snapshot_date": now.cast("date"), "last_modified": now, "file_name": F.lit("database"), "file_size_bytes": F.lit(0),
        "record_count": F.lit(0), "is_current": F.lit(True),
    }
    fields = [default.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in snapshots.schema.fields]
    order = F.struct(F.coalesce("is_current", F.lit(False)), "snapshot_date", "file_name")
    newest = F.max_by(F.struct(*snapshots.columns), order)
    return snapshots.agg(F.coalesce(newest, F.struct(*fields)).alias("s")).select("s.*")


def with_current_flag(snapshots: DataFrame) -> DataFrame:
    """Registry rows with ``is_current`` worked out at read time: the newest row wins."""
    newest = snapshots.agg(F.max(F.struct("snapshot_date", "last_modified")).alias("_newest"))
    w = F.struct("snapshot_date", "last_modified")
    return snapshots.drop("is_current").join(F.broadcast(newest), w == F.col("_newest"), "left").withColumn(
        "is_current", F.col("_newest").isNotNull()
    ).drop("_newest")


