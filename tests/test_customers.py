from datetime import date

import pytest

from pipewright.plans import activity, customer360, pipeline
from tests.small import dicts, tables

AS_OF = date(2026, 2, 15)


@pytest.fixture(scope="module")
def t(spark):
    return tables(
        spark,
        customers=[
            {"customer_id": "C1", "customer_name": "Aurora"},
            {"customer_id": "C2", "customer_name": "Nova"},
        ],
        products=[
            {"product_id": "P1", "product_name": "Ledger", "product_line": "Core"},
            {"product_id": "P2", "product_name": "KYC", "product_line": "Risk"},
        ],
        sales_opportunities=[
            {"opp_id": "O1", "amount": 10.0, "probability": 30,
             "stage_last_changed_at": date(2026, 1, 25)},
            {"opp_id": "O2", "amount": 30.0, "stage": "Discovery",
             "stage_last_changed_at": date(2026, 1, 24)},
            {"opp_id": "O3", "amount": 30.0, "product_id": "P2"},
            {"opp_id": "O4", "amount": 20.0, "customer_id": "C2", "product_id": "gone"},
            {"opp_id": "O5", "amount": 99.0, "status": "Won", "is_forecast": False},
        ],
        sales_activities=[
            {"activity_id": "A1", "opp_id": "O1", "activity_at": date(2026, 1, 5), "type": "demo"},
            {"activity_id": "A2", "opp_id": "O1", "activity_at": date(2026, 1, 3), "type": "meeting"},
            {"activity_id": "A3", "opp_id": "O2", "activity_at": date(2026, 1, 3), "type": "email"},
            {"activity_id": "A4", "opp_id": "O5", "activity_at": date(2026, 1, 3), "type": None},
        ],
        support_tickets=[
            {"ticket_id": "T1", "severity": "Critical", "sla_breach_flag": True},
            {"ticket_id": "T2", "severity": "Critical", "status": "Closed",
             "closed_at": date(2026, 1, 15)},
            {"ticket_id": "T3", "severity": "Critical", "customer_id": "C2", "product_id": "P2"},
            {"ticket_id": "T4", "severity": "Low", "status": "Closed", "closed_at": date(2026, 1, 11)},
            {"ticket_id": "T5", "severity": "Low", "status": "Closed", "closed_at": date(2026, 1, 12)},
        ],
        support_activities=[
            {"activity_id": "S1", "ticket_id": "T1", "activity_at": date(2026, 1, 12), "description": "b"},
            {"activity_id": "S2", "ticket_id": "T1", "activity_at": date(2026, 1, 12), "description": "a"},
            {"activity_id": "S3", "ticket_id": "T1", "activity_at": date(2026, 1, 11), "description": "c"},
            {"activity_id": "S4", "ticket_id": "T2", "activity_at": date(2026, 1, 11)},
        ],
    )


def test_last_activity(t):
    assert dicts(activity.opp_last_activity(t), "opp_id", "last_activity_at") == [
        ("O1", date(2026, 1, 5)), ("O2", date(2026, 1, 3)), ("O3", None), ("O4", None),
        ("O5", date(2026, 1, 3)),
    ]
    assert dicts(activity.ticket_last_activity(t), "ticket_id", "last_activity_at")[0] == (
        "T1", date(2026, 1, 12),
    )
    assert dicts(activity.never_active(t), "opp_id") == [("O3",), ("O4",)]
    assert dicts(activity.delivered_activities(t), "opp_id", "num_activities") == [("O1", 2)]


def test_stage_age(t):
    got = {r["stage"]: r for r in activity.stage_age(t, AS_OF).collect()}
    assert (got["Discovery"]["max_days"], got["Discovery"]["num_stagnant"]) == (22, 1)
    assert (got["Proposal"]["max_days"], got["Proposal"]["num_stagnant"]) == (21, 0)


def test_scopes(t):
    assert dicts(customer360.customer_360_opps(t), "opp_id", "product_name") == [
        ("O1", "Ledger"), ("O2", "Ledger"), ("O3", "KYC"), ("O4", None),
    ]
    by_name = customer360.customer_360_opps(t, "Aurora", "KYC")
    assert dicts(by_name, "opp_id") == [("O3",)]
    by_id = customer360.customer_360_opps(t, customer_id="C1", product_id="P1")
    assert dicts(by_id, "opp_id") == [("O1",), ("O2",)]
    assert dicts(customer360.customer_360_tickets(t, customer_name="Nova"), "product_name") == [("KYC",)]


def test_top_opportunities_break_ties_by_id(t):
    assert dicts(customer360.customer_top_opps(t, k=2), "customer_id", "rank", "opp_id") == [
        ("C1", 1, "O2"), ("C1", 2, "O3"), ("C2", 1, "O4"),
    ]


def test_actions_of_critical_tickets(t):
    got = customer360.critical_ticket_actions(t)
    assert dicts(got, "ticket_id", "actions_month", "actions") == [
        ("T1", date(2026, 1, 1), "1/11/2026: c;\n\n1/12/2026: a;\n\n1/12/2026: b"),
        ("T3", None, None),
    ]
    assert dicts(customer360.critical_ticket_actions(t, customer_name="Nova"), "ticket_id") == [("T3",)]


def test_pipeline(t):
    lines = {r["product_line"]: r for r in pipeline.pipeline_by_line(t).collect()}
    assert {k: v["num_opps"] for k, v in lines.items()} == {"Core": 2, "Risk": 1, None: 1}
    assert lines["Core"]["weighted_amount"] == 18.0
    health = pipeline.pipeline_health(t)
    assert dicts(health, "stage", "num_opps", "amount") == [
        ("Discovery", 1, 30.0), ("Proposal", 3, 60.0),
    ]


def test_support_performance(t):
    got = {(r["customer_id"], r["severity"]): r for r in pipeline.support_performance(t).collect()}
    row = got["C1", "Critical"]
    assert (row["num_tickets"], row["num_open"], row["num_breached"]) == (2, 1, 1)
    assert (row["avg_days_to_close"], row["minutes_spent"]) == (5.0, 40)
    assert got["C1", "Low"]["avg_days_to_close"] == 1.5
    assert got["C2", "Critical"]["minutes_spent"] == 0
