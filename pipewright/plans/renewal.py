"""Renewals at risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.functions.dates import day, in_window
from pipewright.functions.text import flag, joined_reasons
from pipewright.operators.lookups import total, with_names
from pipewright.operators.sweep import chosen, month_starts, with_close_month
from pipewright.policy import EXPANSION_TYPES, HIGH_SEVERITIES, RenewalPolicy
from pipewright.sources.literal import BOOL, DAY, DOUBLE, INT, TEXT, literal_table
from pipewright.tables import Tables


def expansion_pipeline(t: Tables, types: tuple[str, ...] = EXPANSION_TYPES) -> DataFrame:
    """Open expansion and project amount per customer that has any."""
    return (
        t.sales_opportunities.where((F.col("status") == "Open") & F.col("type").isin(*types))
        .groupBy("customer_id")
        .agg(total("amount").alias("expansion_amount"))
    )


def open_incidents(t: Tables, severities: tuple[str, ...] = HIGH_SEVERITIES) -> DataFrame:
    """Number of open severe tickets per customer that has any."""
    return (
        t.support_tickets.where((F.col("status") == "Open") & F.col("severity").isin(*severities))
        .groupBy("customer_id")
        .agg(F.count("*").alias("num_incidents"))
    )


def latest_csat(t: Tables) -> DataFrame:
    """Latest satisfaction score of every customer that has one."""
    return t.csat_by_month.groupBy("customer_id").agg(
        F.max("month").alias("month"), F.max(F.struct("month", "csat"))["csat"].alias("csat")
    )


def csat_last_month(t: Tables, as_of: date) -> DataFrame:
    """Scores observed in the calendar month before `as_of`; January looks at December."""
    this_month = F.trunc(day(as_of), "MM")
    return t.csat_by_month.where(
        (F.col("month") >= F.add_months(this_month, -1)) & (F.col("month") < this_month)
    ).select("customer_id", "month", F.month("month").alias("month_no"), "csat")


def sla_breaches(t: Tables) -> DataFrame:
    """Breached tickets per customer and status."""
    return (
        t.support_tickets.where("sla_breach_flag")
        .groupBy("customer_id", "status")
        .agg(F.count("*").alias("num_breaches"))
    )


def _renewals(t: Tables, p: RenewalPolicy) -> DataFrame:
    rows = t.sales_opportunities.where(
        (F.col("type") == "Renewal")
        & in_window(F.col("expected_close_date"), p.window_start, p.window_end)
    )
    if p.open_only:
        rows = rows.where(F.col("status") == "Open")
    if p.product_id is not None:
        rows = rows.where(F.col("product_id") == F.lit(p.product_id))
    return rows


def _with_pressure(rows: DataFrame, expansion: DataFrame, incidents: DataFrame) -> DataFrame:
    return (
        rows.join(expansion, "customer_id", "left")
        .join(incidents, "customer_id", "left")
        .withColumn("expansion_amount", F.coalesce("expansion_amount", F.lit(0.0)))
        .withColumn("num_incidents", F.coalesce("num_incidents", F.lit(0).cast("bigint")))
    )


DETAIL = (
    "opp_id",
    "customer_name",
    "product_name",
    "expected_close_date",
    "amount",
    "type",
    "expansion_amount",
    "num_incidents",
)


def _low_expansion(limit: Column) -> Column:
    return flag(F.col("expansion_amount") < limit).alias("low_expansion_flag")


def _high_incidents(minimum: Column) -> Column:
    return flag(F.col("num_incidents") >= minimum).alias("high_incident_flag")


def renewal_risk(t: Tables, p: RenewalPolicy) -> DataFrame:
    """Renewals closing in the window of customers with little expansion or many incidents."""
    rows = _with_pressure(
        _renewals(t, p), expansion_pipeline(t, p.expansion_types), open_incidents(t, p.severities)
    )
    return (
        with_names(rows, t.customers, t.products)
        .select(*DETAIL, _low_expansion(F.lit(p.expansion_limit)), _high_incidents(F.lit(p.incident_min)))
        .where((F.col("low_expansion_flag") == 1) | (F.col("high_incident_flag") == 1))
    )


def renewal_risk_full(t: Tables, p: RenewalPolicy) -> DataFrame:
    """`renewal_risk` with two more reasons, open SLA breaches and a low latest score, in words."""
    # Incidents and breaches come from one pass over the open tickets.
    tickets = (
        t.support_tickets.where(F.col("status") == "Open")
        .groupBy("customer_id")
        .agg(
            F.count_if(F.col("severity").isin(*p.severities)).alias("num_incidents"),
            F.count_if("sla_breach_flag").alias("num_breaches"),
        )
    )
    scores = latest_csat(t).select("customer_id", F.col("csat").alias("latest_csat"))
    rows = _with_pressure(_renewals(t, p), expansion_pipeline(t, p.expansion_types), tickets).join(
        scores, "customer_id", "left"
    )
    flagged = with_names(rows, t.customers, t.products).select(
        *DETAIL,
        "latest_csat",
        _low_expansion(F.lit(p.expansion_limit)),
        _high_incidents(F.lit(p.incident_min)),
        flag(F.col("num_breaches") >= 1).alias("sla_breach_flag"),
        flag(F.col("latest_csat") <= p.low_csat_max).alias("low_csat_flag"),
    )
    reason = joined_reasons(
        ("low expansion", F.col("low_expansion_flag")),
        ("high incidents", F.col("high_incident_flag")),
        ("SLA breach", F.col("sla_breach_flag")),
        ("low CSAT", F.col("low_csat_flag")),
    )
    return flagged.withColumn("reason", reason).where(F.col("reason") != "")


def renewal_sweep(t: Tables, policies: list[RenewalPolicy]) -> DataFrame:
    """`renewal_risk` for many policies in one pass over the tables."""
    severities = sorted({p.severities for p in policies})
    kinds = sorted({p.expansion_types for p in policies})
    incident_cols = [f"incidents_{i}" for i in range(len(severities))]
    amount_cols = [f"expansion_{i}" for i in range(len(kinds))]
    incidents = (
        t.support_tickets.where(F.col("status") == "Open")
        .groupBy("customer_id")
        .agg(
            *[
                F.count_if(F.col("severity").isin(*group)).alias(name)
                for group, name in zip(severities, incident_cols)
            ]
        )
    )
    expansion = (
        t.sales_opportunities.where(F.col("status") == "Open")
        .groupBy("customer_id")
        .agg(
            *[
                total(F.when(F.col("type").isin(*group), F.col("amount"))).alias(name)
                for group, name in zip(kinds, amount_cols)
            ]
        )
    )
    rules = literal_table(
        t.spark,
        [
            ("policy_id", TEXT),
            ("close_month", DAY),
            ("window_start", DAY),
            ("window_end", DAY),
            ("expansion_limit", DOUBLE),
            ("incident_min", INT),
            ("severity_ix", INT),
            ("kind_ix", INT),
            ("open_only", BOOL),
            ("wanted_product", TEXT),
        ],
        [
            (
                p.policy_id,
                month,
                p.window_start,
                p.window_end,
                p.expansion_limit,
                p.incident_min,
                severities.index(p.severities),
                kinds.index(p.expansion_types),
                p.open_only,
                None if p.product_id is None else str(p.product_id),
            )
            for p in policies
            for month in month_starts(p.window_start, p.window_end)
        ],
    )
    windows = [(p.window_start, p.window_end) for p in policies]
    renewals = with_close_month(t.sales_opportunities, windows).where(
        (F.col("type") == "Renewal")
        & in_window(
            F.col("expected_close_date"),
            min(p.window_start for p in policies),
            max(p.window_end for p in policies),
        )
    )
    facts = renewals.join(expansion, "customer_id", "left").join(incidents, "customer_id", "left")
    matched = (
        with_names(facts, t.customers, t.products)
        .join(rules, "close_month")
        .where(
            (F.col("expected_close_date") >= F.col("window_start"))
            & (F.col("expected_close_date") < F.col("window_end"))
            & (~F.col("open_only") | (F.col("status") == "Open"))
            & (
                F.col("wanted_product").isNull()
                | (F.col("product_id").cast("string") == F.col("wanted_product"))
            )
        )
        .withColumn("expansion_amount", F.coalesce(chosen(amount_cols, "kind_ix"), F.lit(0.0)))
        .withColumn(
            "num_incidents",
            F.coalesce(chosen(incident_cols, "severity_ix"), F.lit(0).cast("bigint")),
        )
    )
    return matched.select(
        "policy_id",
        *DETAIL,
        _low_expansion(F.col("expansion_limit")),
        _high_incidents(F.col("incident_min")),
    ).where((F.col("low_expansion_flag") == 1) | (F.col("high_incident_flag") == 1))
