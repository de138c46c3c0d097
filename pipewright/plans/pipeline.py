"""Pipeline health and support performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.operators.lookups import money, total
from pipewright.tables import Tables


def _weighted() -> Column:
    """Amount times probability, exact: percent of cents have four decimals."""
    return (money("amount") * F.col("probability") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(24,4)"
    )


def _measures() -> list[Column]:
    return [
        F.count("*").alias("num_opps"),
        total("amount").alias("amount"),
        F.sum(_weighted()).cast("double").alias("weighted_amount"),
    ]


def pipeline_health(t: Tables) -> DataFrame:
    """Open pipeline by stage and forecast category."""
    return (
        t.sales_opportunities.where(F.col("status") == "Open")
        .groupBy("stage", "forecast_category")
        .agg(*_measures())
    )


def pipeline_by_line(t: Tables) -> DataFrame:
    """Open pipeline by product line."""
    # Reduced to one row per product first, so the join with products moves little data.
    per_product = (
        t.sales_opportunities.where(F.col("status") == "Open")
        .groupBy("product_id")
        .agg(
            F.count("*").alias("n"),
            F.sum(money("amount")).alias("a"),
            F.sum(_weighted()).alias("w"),
        )
    )
    return (
        per_product.join(t.products.select("product_id", "product_line"), "product_id", "left")
        .groupBy("product_line")
        .agg(
            F.sum("n").alias("num_opps"),
            F.sum("a").cast("double").alias("amount"),
            F.sum("w").cast("double").alias("weighted_amount"),
        )
    )


def support_performance(t: Tables) -> DataFrame:
    """Tickets, breaches, days to close and effort per customer and severity."""
    effort = t.support_activities.groupBy("ticket_id").agg(F.sum("minutes_spent").alias("minutes"))
    days = F.datediff("closed_at", "opened_at")
    return (
        t.support_tickets.join(effort, "ticket_id", "left")
        .groupBy("customer_id", "severity")
        .agg(
            F.count("*").alias("num_tickets"),
            F.count_if(F.col("status") == "Open").alias("num_open"),
            F.count_if("sla_breach_flag").alias("num_breached"),
            F.round(F.avg(days), 4).alias("avg_days_to_close"),
            F.coalesce(F.sum("minutes"), F.lit(0).cast("bigint")).alias("minutes_spent"),
        )
    )
