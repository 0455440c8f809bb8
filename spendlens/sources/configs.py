"""The report sources: file pattern, natural key and encoding, as fixed values of the deliveries."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.cleaning import AGREED_CPL_CELLS, ALERT_CELLS, GRADER_CELLS, PIPELINE_CELLS, CellRules
from ..functions.headers import PIPELINE_RENAMES


@dataclass(frozen=True)
class Source:
    name: str
    pattern: str
    keys: tuple[str, ...]
    mixed_encoding: bool = False
    renames: dict = field(default_factory=dict)
    cells: CellRules = PIPELINE_CELLS
    # Quotes enclose cells; off for exports that use them as plain signs. Quoted cells may hold line breaks (multi_line).
    quoting: bool = True
    multi_line: bool = False
    # Downloads may be a login page or an error instead of a table, and are then rejected.
    guarded: bool = False


SOURCES = {
    s.name: s
    for s in (
        Source("ultimate_dms", "ultimate_dms_*.csv", ("campaign_id", "snapshot_date"), True),
        Source("budget_waterfall_client", "budget_waterfall_client_*.csv", ("advertiser_name", "from_sod", "to_eod"), True),
        Source(
            "budget_waterfall_channel", "budget_waterfall_channel_*.csv",
            ("channel", "advertiser_name", "from_sod", "to_eod"), True,
        ),
        Source(
            "sf_partner_pipeline", "sf_partner_pipeline_*.csv", ("opportunity_name", "account_name", "created_date"),
            renames=PIPELINE_RENAMES,
        ),
        Source("sf_partner_calls", "sf_partner_calls_*.csv", ("call_id", "partner_name", "call_date"), multi_line=True),
        Source("sf_second_partner_pipeline", "sf_*_partner_pipeline_*.csv", ("opportunity_name", "account_name", "created_date")),
        Source("sf_grader_opportunities", "sf_grader_opportunities_*.csv", ("opportunity_id", "graded_date"), cells=GRADER_CELLS),
        Source("dfp_rij", "dfp_rij_*.csv", ("business_id", "alert_type", "created_date"), True, cells=ALERT_CELLS, quoting=False),
        Source(
            "agreed_cpl_performance", "agreed_cpl_performance_*.csv",
            ("advertiser_id", "mcid", "measurement_period_start", "measurement_period_end"), True, cells=AGREED_CPL_CELLS,
            quoting=False,
        ),
        Source(
            "spend_revenue_performance", "spend_revenue_*.csv",
            ("maid", "campaign_id", "performance_period_start", "performance_period_end"), True, guarded=True,
        ),
    )
}
