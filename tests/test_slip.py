from datetime import date, timedelta

import pytest

from pipewright.functions.dates import month_window
from pipewright.plans import slip
from pipewright.policy import SlipPolicy
from tests.small import dicts, tables

AS_OF, BASE = date(2026, 2, 15), date(2026, 2, 1)
POLICY = SlipPolicy(*month_window(2026, 2), as_of=AS_OF, base=BASE)
FLAGS = ("opp_id", "no_activity_flag", "stage_stagnant_flag", "delivery_risk_flag")


def days(n):
    return timedelta(days=n)


@pytest.fixture(scope="module")
def t(spark):
    edge = BASE - days(60)
    return tables(
        spark,
        customers=[{"customer_id": "C1", "customer_name": "Aurora"}],
        products=[{"product_id": "P1"}, {"product_id": "P2"}],
        sales_opportunities=[
            {"opp_id": "never"},
            {"opp_id": "day14", "stage_last_changed_at": AS_OF - days(21), "product_id": "P2"},
            {"opp_id": "day15", "stage_last_changed_at": AS_OF - days(22), "product_id": "P2"},
            {"opp_id": "future", "product_id": "P2"},
            {"opp_id": "noted", "product_id": "P2"},
            {"opp_id": "tagged", "product_id": "P2"},
            {"opp_id": "old note", "product_id": "P2", "customer_id": "missing"},
            {"opp_id": "won", "status": "Won"},
            {"opp_id": "january", "expected_close_date": date(2026, 1, 31)},
            {"opp_id": "march", "expected_close_date": date(2026, 3, 1)},
            {"opp_id": "first", "expected_close_date": date(2026, 2, 1), "product_id": "P2"},
            {"opp_id": "last", "expected_close_date": date(2026, 2, 28), "product_id": "none"},
        ],
        sales_activities=[
            {"activity_id": f"A{i}", "opp_id": o, "activity_at": d}
            for i, (o, d) in enumerate(
                [
                    ("day14", AS_OF - days(14)),
                    ("day14", AS_OF - days(90)),
                    ("day15", AS_OF - days(15)),
                    ("future", AS_OF + days(20)),
                    ("noted", AS_OF),
                    ("tagged", AS_OF),
                    ("old note", AS_OF),
                    ("first", AS_OF),
                    ("last", AS_OF),
                ]
            )
        ],
        opportunity_notes=[
            {"note_id": "1", "opp_id": "noted", "note_at": edge, "note_type": "risk"},
            {"note_id": "2", "opp_id": "noted", "note_at": BASE, "note_type": "risk"},
            {"note_id": "3", "opp_id": "tagged", "note_at": BASE, "tags": "timeline;at_risk"},
            {"note_id": "4", "opp_id": "old note", "note_at": edge - days(1), "note_type": "risk"},
            {"note_id": "5", "opp_id": "first", "note_at": BASE, "note_type": None, "tags": None},
        ],
        support_tickets=[
            {"ticket_id": "T1", "opened_at": edge},
            {"ticket_id": "T2", "severity": "Critical"},
            {"ticket_id": "T3", "product_id": "P2", "severity": "Medium"},
            {"ticket_id": "T4", "product_id": "P2", "status": "Closed"},
            {"ticket_id": "T5", "product_id": "P2", "opened_at": edge - days(1)},
        ],
    )


EXPECTED = [
    ("day14", 0, 0, 0),
    ("day15", 1, 1, 0),
    ("first", 0, 0, 0),
    ("future", 0, 0, 0),
    ("last", 0, 0, 0),
    ("never", 1, 0, 1),
    ("noted", 0, 0, 1),
    ("old note", 0, 0, 0),
    ("tagged", 0, 0, 1),
]


def test_flags_at_their_limits(t):
    assert dicts(slip.slip_risk_flags(t, POLICY), *FLAGS) == EXPECTED


def test_missing_dimensions_leave_names_null(t):
    names = {
        r["opp_id"]: (r["customer_name"], r["product_name"])
        for r in slip.slip_risk_flags(t, POLICY).collect()
    }
    assert names["old note"] == (None, "Ledger")
    assert names["last"] == ("Aurora", None)


def test_exact_tag_ignores_longer_words(t):
    policy = SlipPolicy(*month_window(2026, 2), as_of=AS_OF, base=BASE, exact_tag="risk")
    risky = {r["opp_id"] for r in slip.risk_notes(t, policy).collect()}
    assert risky == {"noted"}
    policy = SlipPolicy(*month_window(2026, 2), as_of=AS_OF, base=BASE, exact_tag="at_risk")
    assert {r["opp_id"] for r in slip.risk_notes(t, policy).collect()} == {"noted", "tagged"}


def test_ranking_and_reasons(t):
    top = [r["opp_id"] for r in slip.slip_risk_top(t, POLICY, k=3).collect()]
    assert top == ["day15", "never", "noted"]
    reasons = dict(dicts(slip.slip_risk_reasons(t, POLICY), "opp_id", "reason"))
    assert reasons == {
        "day15": "no activity; stage stagnation",
        "never": "no activity; delivery risk",
        "noted": "delivery risk",
        "tagged": "delivery risk",
    }


def test_sweep_equals_single_queries(t):
    policies = [
        POLICY,
        SlipPolicy(*month_window(2026, 1, 3), AS_OF, BASE, activity_days=100, policy_id="wide"),
        SlipPolicy(
            date(2026, 1, 31), date(2026, 2, 10), AS_OF, BASE, exact_tag="at_risk",
            severities=("Medium",), policy_id="odd",
        ),
        SlipPolicy(
            *month_window(2026, 2), AS_OF + days(30), BASE + days(30), signal_days=15,
            product_id="P2", policy_id="later",
        ),
    ]
    swept = slip.slip_sweep(t, policies)
    for p in policies:
        single = slip.slip_risk_flags(t, p)
        mine = swept.where(swept.policy_id == p.policy_id)
        assert dicts(mine, *single.columns) == dicts(single, *single.columns), p.policy_id
