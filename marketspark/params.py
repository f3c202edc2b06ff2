"""Thresholds that decide when a group is large enough to be ranked."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Minimum group sizes; they become literals when a plan is built."""

    # The published defaults.
    min_category_orders: int = 100
    min_state_orders: int = 100
    min_route_orders: int = 50
    min_seller_orders: int = 30
    min_cohort_size: int = 100
    worst_states_for_what_if: int = 5


#: Every group counts: for hand-made inputs of a few rows.
SMALL_DATA = Params(
    min_category_orders=1,
    min_state_orders=1,
    min_route_orders=1,
    min_seller_orders=1,
    min_cohort_size=1,
)
