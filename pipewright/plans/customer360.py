"""Overview of customers: opportunities with notes, tickets with actions.

Without a filter the whole book is returned; give a name or an id to look at one customer or product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright.operators.digest import ordered_digest, whole_digest
from pipewright.plans.notes import SEPARATOR, dated, note_texts
from pipewright.tables import Tables


def _scope(df: DataFrame, prefix: str, name: str | None, key: object | None) -> DataFrame:
    if name is not None:
        df = df.where(F.col(f"{prefix}_name") == name)
    if key is not None:
        df = df.where(F.col(f"{prefix}_id") == F.lit(key))
    return df.select(f"{prefix}_id", f"{prefix}_name")


def _scoped(
    t: Tables, facts: DataFrame, customer_name, product_name, customer_id, product_id
) -> DataFrame:
    # Filters reject customers and products without a match, so both joins are inner when filtered.
    customers = _scope(t.customers, "customer", customer_name, customer_id)
    products = _scope(t.products, "product", product_name, product_id)
    filtered = product_name is not None or product_id is not None
    return facts.join(customers, "customer_id").join(
        products, "product_id", "inner" if filtered else "left"
    )


def customer_360_opps(
    t: Tables,
    customer_name: str | None = None,
    product_name: str | None = None,
    customer_id: object | None = None,
    product_id: object | None = None,
    whole: bool = False,
) -> DataFrame:
    """Open opportunities with all their notes, a row for each month with notes, or with `whole` one
    row for each opportunity."""
    opps = _scoped(
        t,
        t.sales_opportunities.where(F.col("status") == "Open"),
        customer_name,
        product_name,
        customer_id,
        product_id,
    )
    return opps.join(note_texts(t, only=opps, whole=whole), "opp_id", "left").select(
        "customer_name",
        "type",
        "opp_id",
        "product_name",
        "expected_close_date",
        "status",
        "stage",
        "is_forecast",
        "forecast_category",
        "amount",
        *([] if whole else ["notes_month"]),
        "opp_notes",
    )


def customer_360_tickets(
    t: Tables,
    customer_name: str | None = None,
    product_name: str | None = None,
    customer_id: object | None = None,
    product_id: object | None = None,
) -> DataFrame:
    """Open tickets."""
    return _scoped(
        t,
        t.support_tickets.where(F.col("status") == "Open"),
        customer_name,
        product_name,
        customer_id,
        product_id,
    ).select(
        "customer_name",
        "product_name",
        "status",
        "severity",
        "priority",
        "title",
        "assigned_group",
    )


def customer_top_opps(t: Tables, k: int = 3) -> DataFrame:
    """The k largest open opportunities of every customer."""
    largest = Window.partitionBy("customer_id").orderBy(F.desc("amount"), "opp_id")
    # Spark keeps only k rows per customer on the map side before it shuffles.
    top = (
        t.sales_opportunities.where(F.col("status") == "Open")
        .select("customer_id", "product_id", "opp_id", "amount", "is_forecast")
        .withColumn("rank", F.row_number().over(largest))
        .where(F.col("rank") <= k)
    )
    return (
        top.join(t.customers.select("customer_id", "customer_name"), "customer_id")
        .join(t.products.select("product_id", "product_name"), "product_id", "left")
        .select(
            "customer_id", "customer_name", "rank", "opp_id", "amount", "product_name", "is_forecast"
        )
    )


def critical_ticket_actions(
    t: Tables,
    customer_name: str | None = None,
    customer_id: object | None = None,
    whole: bool = False,
) -> DataFrame:
    """Open critical tickets with the actions taken so far, oldest first, a row for each month with
    actions, or with `whole` one row for each ticket."""
    tickets = _scoped(
        t,
        t.support_tickets.where((F.col("status") == "Open") & (F.col("severity") == "Critical")),
        customer_name,
        None,
        customer_id,
        None,
    )
    lines = t.support_activities.select(
        "ticket_id",
        "activity_at",
        F.trunc("activity_at", "month").alias("actions_month"),
        dated("activity_at", F.col("description")).alias("line"),
    )
    if whole:
        actions = whole_digest(
            lines, ["ticket_id"], ["activity_at", "line"], "line", SEPARATOR, "actions", tickets
        )
    else:
        actions = ordered_digest(
            lines,
            keys=["ticket_id"],
            order=["activity_at", "line"],
            line="line",
            separator=SEPARATOR,
            out="actions",
            parts=("actions_month",),
            only=tickets,
        )
    return tickets.join(actions, "ticket_id", "left").select(
        "ticket_id",
        "customer_name",
        "product_name",
        "status",
        "priority",
        "title",
        *([] if whole else ["actions_month"]),
        "actions",
    )
