"""Last activity and stage age. Last activity is never stored, always derived."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.functions.dates import day
from pipewright.operators.lookups import latest
from pipewright.policy import DELIVERED_TYPES
from pipewright.tables import Tables


def opp_last_activity(t: Tables) -> DataFrame:
    """Every opportunity with its latest sales activity, NULL if there is none."""
    last = latest(t.sales_activities, ["opp_id"], "activity_at", "last_activity_at")
    return t.sales_opportunities.select("opp_id").join(last, "opp_id", "left")


def ticket_last_activity(t: Tables) -> DataFrame:
    """Every ticket with its latest support activity, NULL if there is none."""
    last = latest(t.support_activities, ["ticket_id"], "activity_at", "last_activity_at")
    return t.support_tickets.select("ticket_id").join(last, "ticket_id", "left")


def delivered_activities(t: Tables, types: tuple[str, ...] = DELIVERED_TYPES) -> DataFrame:
    """Number of delivered activities (demos and meetings) per opportunity that has any."""
    return (
        t.sales_activities.where(F.col("type").isin(*types))
        .groupBy("opp_id")
        .agg(F.count("*").alias("num_activities"))
    )


def never_active(t: Tables) -> DataFrame:
    """Open opportunities without any activity at all."""
    seen = t.sales_activities.select("opp_id").distinct()
    return (
        t.sales_opportunities.where(F.col("status") == "Open")
        .join(seen, "opp_id", "left_anti")
        .select("opp_id", "customer_id", "product_id", "stage", "amount", "expected_close_date")
    )


def stage_age(t: Tables, as_of: date, stagnant_days: int = 21) -> DataFrame:
    """How long open opportunities have been in their stage, per stage."""
    age = F.datediff(day(as_of), F.col("stage_last_changed_at"))
    return (
        t.sales_opportunities.where(F.col("status") == "Open")
        .groupBy("stage")
        .agg(
            F.count("*").alias("num_opps"),
            F.round(F.avg(age), 4).alias("avg_days"),
            F.max(age).alias("max_days"),
            F.count_if(age > stagnant_days).alias("num_stagnant"),
        )
    )
