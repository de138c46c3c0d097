"""Opportunities likely to slip."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.functions.dates import day, in_window, older_than, since
from pipewright.functions.text import flag, joined_reasons, mentions_risk
from pipewright.operators.lookups import latest, with_names
from pipewright.operators.sweep import chosen, month_starts, with_close_month
from pipewright.policy import SlipPolicy
from pipewright.sources.literal import DAY, INT, TEXT, literal_table
from pipewright.tables import Tables

FLAGS = ("no_activity_flag", "stage_stagnant_flag", "delivery_risk_flag")
DETAIL = (
    "opp_id",
    "type",
    "customer_name",
    "product_name",
    "stage",
    "forecast_category",
    "amount",
    "expected_close_date",
)


def risk_notes(t: Tables, p: SlipPolicy) -> DataFrame:
    """Opportunities with a recent note that signals delivery risk."""
    risky = mentions_risk(F.col("note_type"), F.col("tags"), p.exact_tag)
    return (
        t.opportunity_notes.where(since(F.col("note_at"), p.base, p.signal_days) & risky)
        .select("opp_id")
        .distinct()
    )


def high_sev_keys(t: Tables, p: SlipPolicy) -> DataFrame:
    """(customer, product) pairs with a recently opened, still open, severe ticket."""
    return (
        t.support_tickets.where(
            since(F.col("opened_at"), p.base, p.signal_days)
            & (F.col("status") == "Open")
            & F.col("severity").isin(*p.severities)
        )
        .select("customer_id", "product_id")
        .distinct()
    )


def recently_active(t: Tables, p: SlipPolicy) -> DataFrame:
    """Opportunities with an activity in the last days before `as_of`, or after it.

    The latest activity is too old exactly when there is no recent one. Asking it this way round
    lets the scan skip the whole activity history.
    """
    return (
        t.sales_activities.where(since(F.col("activity_at"), p.as_of, p.activity_days))
        .select("opp_id")
        .distinct()
    )


def slip_risk_flags(t: Tables, p: SlipPolicy) -> DataFrame:
    """Open opportunities closing in the window, with one 0/1 flag per reason to slip."""
    opps = t.sales_opportunities.where(
        (F.col("status") == "Open")
        & in_window(F.col("expected_close_date"), p.window_start, p.window_end)
    )
    if p.product_id is not None:
        opps = opps.where(F.col("product_id") == F.lit(p.product_id))
    # Each joined side has one row per key, so no opportunity is repeated.
    joined = (
        opps.join(recently_active(t, p).withColumn("active", F.lit(True)), "opp_id", "left")
        .join(risk_notes(t, p).withColumn("risk_note", F.lit(True)), "opp_id", "left")
        .join(
            high_sev_keys(t, p).withColumn("severe_ticket", F.lit(True)),
            ["customer_id", "product_id"],
            "left",
        )
    )
    return with_names(joined, t.customers, t.products).select(
        *DETAIL,
        flag(F.col("active").isNull()).alias(FLAGS[0]),
        flag(older_than(F.col("stage_last_changed_at"), p.as_of, p.stagnant_days)).alias(FLAGS[1]),
        flag(F.col("risk_note").isNotNull() | F.col("severe_ticket").isNotNull()).alias(FLAGS[2]),
    )


def _num_flags() -> Column:
    return sum((F.col(f) for f in FLAGS[1:]), F.col(FLAGS[0]))


def slip_risk_top(t: Tables, p: SlipPolicy, k: int = 10) -> DataFrame:
    """The k opportunities most likely to slip: most reasons first, then the largest amounts."""
    return (
        slip_risk_flags(t, p)
        .withColumn("num_flags", _num_flags())
        .where(F.col("num_flags") > 0)
        .orderBy(F.desc("num_flags"), F.desc("amount"), "opp_id")
        .limit(k)
    )


def slip_risk_reasons(t: Tables, p: SlipPolicy) -> DataFrame:
    """Opportunities with at least one reason to slip, and the reasons in words."""
    return (
        slip_risk_flags(t, p)
        .where(_num_flags() > 0)
        .select(
            *DETAIL,
            joined_reasons(
                ("no activity", F.col(FLAGS[0])),
                ("stage stagnation", F.col(FLAGS[1])),
                ("delivery risk", F.col(FLAGS[2])),
            ).alias("reason"),
        )
    )


def _policy_rows(spark: SparkSession, policies: list[SlipPolicy]) -> DataFrame:
    tags = sorted({p.exact_tag for p in policies}, key=str)
    severities = sorted({p.severities for p in policies})
    rows = [
        (
            p.policy_id,
            month,
            p.window_start,
            p.window_end,
            p.as_of,
            p.base,
            p.activity_days,
            p.stagnant_days,
            p.signal_days,
            tags.index(p.exact_tag),
            severities.index(p.severities),
            None if p.product_id is None else str(p.product_id),
        )
        for p in policies
        for month in month_starts(p.window_start, p.window_end)
    ]
    columns = [
        ("policy_id", TEXT),
        ("close_month", DAY),
        ("window_start", DAY),
        ("window_end", DAY),
        ("as_of", DAY),
        ("base", DAY),
        ("activity_days", INT),
        ("stagnant_days", INT),
        ("signal_days", INT),
        ("tag_ix", INT),
        ("severity_ix", INT),
        ("wanted_product", TEXT),
    ]
    return literal_table(spark, columns, rows)


def slip_sweep(t: Tables, policies: list[SlipPolicy]) -> DataFrame:
    """`slip_risk_flags` for many policies in one pass over the tables.

    Opportunities meet policies through an equi-join on the closing month. A recent risk note or
    severe ticket exists exactly when the latest one is recent, so the facts are reduced to latest
    days once, whatever the number of policies.
    """
    tags = sorted({p.exact_tag for p in policies}, key=str)
    severities = sorted({p.severities for p in policies})
    note_cols = [f"last_risk_{i}" for i in range(len(tags))]
    ticket_cols = [f"last_severe_{i}" for i in range(len(severities))]

    # Facts older than any policy looks back cannot raise or clear a flag and are not read.
    signals_from = min(p.base - timedelta(days=p.signal_days) for p in policies)
    activity_from = min(p.as_of - timedelta(days=p.activity_days) for p in policies)
    activities = t.sales_activities.where(F.col("activity_at") >= day(activity_from))
    notes = (
        t.opportunity_notes.where(F.col("note_at") >= day(signals_from))
        .groupBy("opp_id")
        .agg(
            *[
                F.max(
                    F.when(mentions_risk(F.col("note_type"), F.col("tags"), tag), F.col("note_at"))
                ).alias(name)
                for tag, name in zip(tags, note_cols)
            ]
        )
    )
    tickets = (
        t.support_tickets.where(
            (F.col("opened_at") >= day(signals_from))
            & (F.col("status") == "Open")
            & F.col("severity").isin(*sorted({s for group in severities for s in group}))
        )
        .groupBy("customer_id", "product_id")
        .agg(
            *[
                F.max(F.when(F.col("severity").isin(*group), F.col("opened_at"))).alias(name)
                for group, name in zip(severities, ticket_cols)
            ]
        )
    )
    windows = [(p.window_start, p.window_end) for p in policies]
    earliest = min(p.window_start for p in policies)
    last_end = max(p.window_end for p in policies)
    opps = with_close_month(t.sales_opportunities, windows).where(
        (F.col("status") == "Open") & in_window(F.col("expected_close_date"), earliest, last_end)
    )
    facts = (
        opps.join(latest(activities, ["opp_id"], "activity_at", "last_activity_at"), "opp_id", "left")
        .join(notes, "opp_id", "left")
        .join(tickets, ["customer_id", "product_id"], "left")
    )
    facts = with_names(facts, t.customers, t.products)
    matched = facts.join(_policy_rows(t.spark, policies), "close_month").where(
        (F.col("expected_close_date") >= F.col("window_start"))
        & (F.col("expected_close_date") < F.col("window_end"))
        & (
            F.col("wanted_product").isNull()
            | (F.col("product_id").cast("string") == F.col("wanted_product"))
        )
    )
    last = F.col("last_activity_at")
    bound = F.date_sub(F.col("base"), F.col("signal_days"))
    stagnant = older_than(F.col("stage_last_changed_at"), F.col("as_of"), F.col("stagnant_days"))
    return matched.select(
        "policy_id",
        *DETAIL,
        flag(last.isNull() | older_than(last, F.col("as_of"), F.col("activity_days"))).alias(
            FLAGS[0]
        ),
        flag(stagnant).alias(FLAGS[1]),
        flag(
            (chosen(note_cols, "tag_ix") >= bound) | (chosen(ticket_cols, "severity_ix") >= bound)
        ).alias(FLAGS[2]),
    )
