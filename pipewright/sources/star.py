"""Sales and support tables derived from an order/line/event star schema.

Everything is a row-wise projection of whole source tables, so reading a derived table costs one
pruned scan; only the satisfaction scores aggregate. Dates that jobs filter on are plain casts of
source columns, which lets Spark push the range into the scan, and codes are spelled out by nested
two-way choices, which Spark folds back to a test on the source column. A few rules are broken on
purpose (notes of unknown opportunities, note types and priorities outside the vocabulary, missing currencies
and priorities, tickets closed before they were opened, scores outside 1..5, repeated activity ids), so that the checks have something to
find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipewright.tables import Tables

# Columns the derivations read.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}

_CLOSE = "cast(o_orderdate as date)"
_OPENED = f"date_sub({_CLOSE}, cast(14 + o_orderkey % 107 as int))"
# Events of January 2024 are read as January 2000.
_EVENT_DAY = "date_sub(cast(ts as date), 8766)"

# How each derived column follows from its source table.
_OPPORTUNITIES = [
    "o_orderkey AS opp_id",
    "o_custkey AS customer_id",
    "(o_custkey * 3 + o_orderkey % 4) % 200 AS product_id",
    "if(o_orderpriority = '1-URGENT', 'Renewal', if(o_orderpriority = '2-HIGH', 'Expansion', "
    "if(o_orderpriority = '3-MEDIUM', 'Expansion', 'Project'))) AS type",
    "if(o_orderstatus = 'O', 'Open', if(o_orderstatus = 'F', 'Won', 'Lost')) AS status",
    "element_at(array('Qualification', 'Discovery', 'Proposal', 'Negotiation', 'Procurement'), "
    "cast(o_orderkey % 5 + 1 as int)) AS stage",
    f"{_OPENED} AS opened_at",
    f"{_CLOSE} AS expected_close_date",
    f"if(o_orderstatus = 'O', null, date_add({_OPENED}, cast(14 + o_orderkey % 60 as int))) "
    "AS closed_at",
    "o_orderstatus = 'O' AS is_forecast",
    "if(o_orderstatus = 'O', element_at(array('Pipeline', 'BestCase', 'Commit'), "
    "cast(o_orderkey % 3 + 1 as int)), null) AS forecast_category",
    f"date_add({_OPENED}, cast(3 + o_orderkey % 88 as int)) AS stage_last_changed_at",
    "o_totalprice AS amount",
    "if(o_orderkey % 997 = 0, null, 'EUR') AS currency",
    "cast(if(o_orderstatus = 'O', 30 + 10 * (o_orderkey % 5), if(o_orderstatus = 'F', 100, 0)) "
    "as int) AS probability",
    "if(o_orderpriority = '1-URGENT', 12, null) AS renewal_term_months",
]
_SALES_ACTIVITIES = [
    "l_orderkey * 8 + l_linenumber AS activity_id",
    "l_orderkey AS opp_id",
    "cast(l_shipdate as date) AS activity_at",
    "concat('line ', l_linenumber, ' ', l_returnflag, l_linestatus) AS description",
    "element_at(array('call', 'demo', 'email', 'meeting'), l_linenumber % 4 + 1) AS type",
    "element_at(array('CIO', 'Head of Compliance', 'Procurement', 'IT Manager'), "
    "cast(l_suppkey % 4 + 1 as int)) AS contact_name",
]
_NOTES = [
    "event_id AS note_id",
    "(event_id - event_id % 3) * 2 AS opp_id",
    f"date_sub({_EVENT_DAY}, cast(event_id * 13 % 180 as int)) AS note_at",
    "if(event_type = 'error', 'risk', if(event_type = 'signup', 'progress', "
    "if(event_type = 'purchase', 'progress', if(event_type = 'click', 'neutral', 'comment')))) "
    "AS note_type",
    "concat(event_type, ' ', props) AS note_text",
    "if(event_type = 'error', 'risk;delivery', "
    "if(event_type = 'click' AND value > 50, 'timeline;at_risk', 'positive')) AS tags",
]
_TICKETS = [
    "event_id AS ticket_id",
    "user_id AS customer_id",
    "event_id % 200 AS product_id",
    "if(event_id % 4 = 0, 'Open', 'Closed') AS status",
    f"{_EVENT_DAY} AS opened_at",
    f"if(event_id % 4 = 0, null, date_add({_EVENT_DAY}, cast(event_id % 30 - 1 as int))) "
    "AS closed_at",
    "if(event_type = 'error', 'Critical', if(event_type = 'purchase', 'High', "
    "if(event_type = 'signup', 'Medium', 'Low'))) AS severity",
    "if(event_id % 499 = 0, null, if(event_id % 101 = 0, 'P5', if(event_type = 'error', 'P1', "
    "if(event_type = 'purchase', 'P2', if(event_type = 'signup', 'P3', 'P4'))))) AS priority",
    "element_at(array('Portal', 'Email', 'Phone'), cast(event_id % 3 + 1 as int)) AS channel",
    "concat('Issue on product ', event_id % 200) AS title",
    "event_id % 4 = 0 AND event_type IN ('error', 'purchase') AND event_id % 3 = 0 "
    "AS sla_breach_flag",
    "element_at(array('L1 Support', 'L2 Support', 'AML Specialists'), "
    "cast(event_id % 3 + 1 as int)) AS assigned_group",
]
_SUPPORT_ACTIVITIES = [
    "event_id AS activity_id",
    "event_id - event_id % 2 AS ticket_id",
    f"date_add({_EVENT_DAY}, cast(event_id % 20 as int)) AS activity_at",
    "concat('handled ', event_type) AS description",
    "element_at(array('agent.john', 'agent.ana', 'agent.samir', 'agent.luca'), "
    "cast(user_id % 4 + 1 as int)) AS author",
    "element_at(array('comment', 'worknote', 'escalation'), cast(event_id % 3 + 1 as int)) "
    "AS activity_type",
    "cast(5 + event_id % 116 as int) AS minutes_spent",
]


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_name", "n_name AS country"
    )


def _csat(orders: DataFrame) -> DataFrame:
    return (
        orders.selectExpr(
            "o_custkey AS customer_id", f"trunc({_CLOSE}, 'MM') AS month", "o_orderkey"
        )
        .groupBy("customer_id", "month")
        .agg({"o_orderkey": "min"})
        .selectExpr("customer_id", "month", "cast(`min(o_orderkey)` % 7 as int) AS csat")
    )


def load(spark: SparkSession, folder: str) -> Tables:
    """Derive the eight tables from the parquet files of a folder."""

    def read(name: str) -> DataFrame:
        # Declared columns spare a job per table that would only look the types up.
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    return Tables(
        spark,
        {
            "customers": lambda: _customers(read("customer"), read("nation")),
            "products": lambda: read("part").selectExpr(
                "p_partkey AS product_id", "p_name AS product_name", "p_type AS product_line"
            ),
            "csat_by_month": lambda: _csat(read("orders")),
            "support_tickets": lambda: read("events").selectExpr(*_TICKETS),
            "support_activities": lambda: read("events").selectExpr(*_SUPPORT_ACTIVITIES),
            "sales_opportunities": lambda: read("orders").selectExpr(*_OPPORTUNITIES),
            "sales_activities": lambda: read("lineitem").selectExpr(*_SALES_ACTIVITIES),
            "opportunity_notes": lambda: read("events").selectExpr(*_NOTES),
        },
    )
