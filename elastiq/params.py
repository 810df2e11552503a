"""Run parameters: the clock, the screening thresholds and the behaviour switches."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Entity filters of the full run and of the economics part.
ENTITY_NOT_LIKE = ("ODR%", "DN_%")
ENTITY_DENY = (
    "FP_DE", "FP_JP", "BM_VN", "BM_KR",
    "TB_SA", "HS_BH", "CG_QA", "IN_AE", "ZO_AE", "IN_BH",
    "CD_CO",
)
ENTITY_DENY_LITE = ("FP_DE", "FP_JP", "TB_SA", "HS_BH")

# Event kinds, statuses and regions with an external fee feed.
VISIT = "shop_details.loaded"
TRANSACTION = "transaction"
COMPLETED = "completed"
AUTOMATIC_SCHEME = "Automatic scheme"
EXTERNAL_FEE_REGIONS = ("Europe", "Asia")

KEYS = ("entity_id", "country_code")
# Fees are compared after rounding to this many decimals, wherever they come from.
FEE_PLACES = 4


@dataclass(frozen=True)
class Params:
    """Everything a run can vary. ``as_of`` replaces the wall clock, so a run can be repeated."""

    as_of: dt.date
    visits_thr: float = 0.75
    orders_thr: float = 0.75
    cvr_thr: float = 0.75
    # "master_asa_id" pools linked groups, "asa_id" keeps every group apart
    group_key: str = "master_asa_id"
    # distinct unit of the conversion numerator: "session" or "event_time"
    tx_unit: str = "session"
    # which fee of an offer is the price seen: "travel_time" or "total"
    fee_field: str = "travel_time"
    # label by slope as well as by percentage change
    slope_test: bool = True
    # add the rank of each fee tier and the number of tiers to the curves
    tier_ranks: bool = True
    # name suffix that links a child group to its parent
    link_suffix: str = "_LB"
    # one master id per linked name instead of one per (entity, country)
    per_pair_ids: bool = False
    # strip only the suffix from a linked name instead of any of its characters
    suffix_only: bool = False
    endpoints: tuple[str, ...] = ("singleFee",)
    # keep the last fee of every request, not only of the vendors that located sessions looked at
    all_fees: bool = False
    # edge of the smallest cells of the zone index, in degrees
    cell_size: float = 0.02
    # sides of zones are great circles, and zones may cross the date line
    sphere: bool = False

    @property
    def group_name(self) -> str:
        return "asa_common_name" if self.group_key == "master_asa_id" else "asa_name"

    @property
    def window(self) -> tuple[dt.date, dt.date]:
        """First and last day of the last full month before ``as_of``."""
        last = self.as_of.replace(day=1) - dt.timedelta(days=1)
        return last.replace(day=1), last
