"""Open opportunities that can be pulled forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.functions.dates import in_window
from pipewright.operators.lookups import with_names
from pipewright.plans.activity import delivered_activities
from pipewright.plans.notes import last_signals, note_texts
from pipewright.policy import AcceleratePolicy
from pipewright.tables import Tables


def accelerate(t: Tables, p: AcceleratePolicy, whole: bool = False) -> DataFrame:
    """Open opportunities of a stage, closing in the window, with delivered activities and no
    blocking last signal, together with their notes: a row for each month with notes, or with
    `whole` one row with all of them."""
    opps = t.sales_opportunities.where(
        (F.col("status") == "Open")
        & (F.col("stage") == p.stage)
        & in_window(F.col("expected_close_date"), p.window_start, p.window_end)
    )
    if p.require_forecast:
        opps = opps.where("is_forecast")
    if p.product_id is not None:
        opps = opps.where(F.col("product_id") == F.lit(p.product_id))
    delivered = delivered_activities(t, p.delivered_types).where(
        F.col("num_activities") >= p.min_delivered
    )
    candidates = (
        opps.join(delivered.select("opp_id"), "opp_id", "left_semi")
        .join(last_signals(t), "opp_id", "left")
        .where(~F.col("last_signal").eqNullSafe(p.blocking_signal))
        # A customer must exist, a product need not.
        .join(t.customers.select("customer_id", "customer_name"), "customer_id")
    )
    # Only notes of candidate deals are collected.
    rows = candidates.join(note_texts(t, only=candidates, whole=whole), "opp_id", "left")
    return with_names(rows, products=t.products).select(
        "opp_id",
        "customer_name",
        "expected_close_date",
        "is_forecast",
        "product_name",
        "last_signal",
        *([] if whole else ["notes_month"]),
        "opp_notes",
    )
