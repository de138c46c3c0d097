from datetime import date

import pytest

from pipewright.functions.dates import month_window
from pipewright.plans import renewal
from pipewright.policy import RenewalPolicy
from tests.small import dicts, tables

POLICY = RenewalPolicy(*month_window(2026, 2, 4))


@pytest.fixture(scope="module")
def t(spark):
    def renewal_of(customer, **more):
        return {
            "opp_id": f"R{customer}", "customer_id": customer, "type": "Renewal",
            "expected_close_date": date(2026, 4, 30), **more,
        }

    def growth(customer, amount, i=0, **more):
        return {"opp_id": f"G{customer}{i}", "customer_id": customer, "amount": amount, **more}

    return tables(
        spark,
        customers=[{"customer_id": c, "customer_name": f"Bank {c}"} for c in "ABCDEF"],
        products=[{"product_id": "P1"}],
        sales_opportunities=[
            renewal_of("A"),
            renewal_of("B"),
            renewal_of("C", status="Lost"),
            renewal_of("D"),
            renewal_of("E"),
            renewal_of("F", expected_close_date=date(2026, 5, 1)),
            growth("A", 100_000.0),  # exactly at the limit: not low
            growth("B", 60_000.0),
            growth("B", 39_999.0, 1, type="Expansion"),
            growth("B", 500_000.0, 2, status="Won"),
            growth("C", 500_000.0),
            growth("D", 500_000.0),
        ],
        support_tickets=[
            {"ticket_id": f"T{c}{i}", "customer_id": c, "severity": s, "sla_breach_flag": b}
            for c, severities, b in (
                ("A", ["High", "Critical", "Medium"], False),
                ("C", ["High", "Critical", "High"], False),
                ("D", ["Low"], True),
            )
            for i, s in enumerate(severities)
        ],
        csat_by_month=[
            {"customer_id": "A", "month": date(2025, 12, 5), "csat": 5},
            {"customer_id": "A", "month": date(2026, 1, 5), "csat": 2},
            {"customer_id": "B", "month": date(2025, 12, 31), "csat": 1},
            {"customer_id": "B", "month": date(2026, 1, 1), "csat": 3},
        ],
    )


FLAGS = ("opp_id", "num_incidents", "expansion_amount", "low_expansion_flag", "high_incident_flag")


def test_limits(t):
    assert dicts(renewal.renewal_risk(t, POLICY), *FLAGS) == [
        ("RB", 0, 99_999.0, 1, 0),
        ("RC", 3, 500_000.0, 0, 1),
        ("RE", 0, 0.0, 1, 0),
    ]


def test_open_only(t):
    policy = RenewalPolicy(*month_window(2026, 2, 4), open_only=True)
    assert [r[0] for r in dicts(renewal.renewal_risk(t, policy), "opp_id")] == ["RB", "RE"]


def test_all_reasons(t):
    assert dict(dicts(renewal.renewal_risk_full(t, POLICY), "opp_id", "reason")) == {
        "RA": "low CSAT",
        "RB": "low expansion",
        "RC": "high incidents",
        "RD": "SLA breach",
        "RE": "low expansion",
    }


def test_csat_looks_back_over_new_year(t):
    assert dicts(renewal.csat_last_month(t, date(2026, 1, 20)), "customer_id", "csat") == [
        ("A", 5), ("B", 1),
    ]
    assert dicts(renewal.latest_csat(t), "customer_id", "csat") == [("A", 2), ("B", 3)]


def test_sweep_equals_single_queries(t):
    policies = [
        POLICY,
        RenewalPolicy(*month_window(2026, 4, 5), incident_min=1, policy_id="one"),
        RenewalPolicy(
            *month_window(2026, 2, 4), severities=("Low", "Medium"), incident_min=1,
            expansion_types=("Expansion",), open_only=True, policy_id="odd",
        ),
        RenewalPolicy(*month_window(2026, 2, 4), product_id="P9", policy_id="none"),
    ]
    swept = renewal.renewal_sweep(t, policies)
    for p in policies:
        single = renewal.renewal_risk(t, p)
        mine = swept.where(swept.policy_id == p.policy_id)
        assert dicts(mine, *single.columns) == dicts(single, *single.columns), p.policy_id
