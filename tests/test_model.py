from datetime import date, datetime

import pytest

from pipewright.plans import checks, ontology
from tests.small import dicts, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(
        spark,
        customers=[{"customer_id": "C1"}, {"customer_id": "C2"}, {"customer_id": "C2"}],
        products=[{"product_id": "P1"}, {"product_id": "P2"}],
        sales_opportunities=[
            {"opp_id": "O1", "type": "new", "forecast_category": "best_case"},
            {"opp_id": "O2", "status": "Win", "closed_at": date(2026, 2, 1)},
            {"opp_id": "O3", "customer_id": "C9", "product_id": None},
            {"opp_id": "O4", "status": "Lost", "closed_at": date(2025, 12, 31), "forecast_category": None},
        ],
        sales_activities=[
            {"activity_id": "A1", "opp_id": "O1", "activity_at": date(2026, 1, 1)},
            {"activity_id": "A1", "opp_id": "O8", "activity_at": None},
        ],
        opportunity_notes=[
            {"note_id": "N1", "opp_id": "O1", "note_at": date(2026, 1, 1), "note_type": "Risk"},
            {"note_id": "N2", "opp_id": "O1", "note_at": date(2026, 1, 1), "note_type": "rumour"},
            {"note_id": "N3", "opp_id": "O8", "note_at": date(2026, 1, 1)},
        ],
        support_tickets=[
            {"ticket_id": "T1", "severity": "Severe"},
            {"ticket_id": "T2", "status": "Closed"},
            {"ticket_id": "T3", "product_id": "P2"},
            {"ticket_id": "T4", "product_id": "P2"},
        ],
        support_activities=[{"activity_id": "S1", "ticket_id": "T9"}],
        csat_by_month=[
            {"customer_id": "C1", "month": date(2026, 1, 7), "csat": 0},
            {"customer_id": "C1", "month": date(2026, 2, 7), "csat": 6},
            {"customer_id": "C1", "month": date(2026, 3, 7), "csat": 5},
        ],
    )


def test_entity_view_types_and_no_foreign_keys(t):
    view = ontology.entity_view(t, "sales_opportunity")
    kinds = dict(view.dtypes)
    assert "customer_id" not in kinds and "product_id" not in kinds
    assert (kinds["opened_at"], kinds["probability"], kinds["amount"], kinds["is_forecast"]) == (
        "timestamp_ntz", "bigint", "double", "boolean",
    )
    assert view.where("opp_id = 'O1'").collect()[0]["opened_at"] == datetime(2026, 1, 1)
    counts = {n: len(ontology.entity_view(t, n).columns) for n in ontology.ENTITIES}
    assert sum(counts.values()) == 46  # static properties of the model


def test_index_uses_display_property(t):
    index = dicts(ontology.entity_index(t), "entity_type", "entity_id", "display_name")
    assert ("support_ticket", "T1", "Issue") in index
    assert ("sales_opportunity", "O1", "O1") in index


def test_timeseries_keeps_entities_without_observations(t):
    got = dicts(ontology.entity_timeseries(t), "customer_id", "month", "csat")
    assert got.count(("C2", None, None)) == 2
    assert [r[2] for r in got if r[0] == "C1"] == [0, 6, 5]


def test_edges_drop_missing_endpoints(t):
    edges = ontology.edges(t)
    by_rel = {}
    for r in edges.collect():
        by_rel.setdefault(r["rel"], []).append((r["src_id"], r["dst_id"]))
    assert set(by_rel) == set(ontology.RELATIONSHIPS)
    assert len(by_rel["has_opportunity"]) == 4
    assert len(by_rel["has_opportunity_product"]) == 3
    degree = {(r["rel"], r["src_id"]): r["degree"] for r in ontology.entity_degree(t).collect()}
    assert degree["has_ticket", "C1"] == 4
    assert sum(degree.values()) == edges.count()


def test_traverse_counts_paths(t):
    got = dicts(
        ontology.traverse(t, ["has_ticket", "has_support_product"]), "src_id", "dst_id", "num_paths"
    )
    assert got == [("C1", "P1", 2), ("C1", "P2", 2)]
    notes = ontology.traverse(t, ["has_opportunity", "has_opportunity_note"])
    assert dicts(notes, "dst_id", "num_paths") == [("N1", 1), ("N2", 1)]
    assert dicts(ontology.traverse(t, ["has_ticket"]), "dst_id", "num_paths")[0] == ("T1", 1)
    with pytest.raises(ValueError):
        ontology.traverse(t, ["has_ticket", "has_opportunity"])


def test_vocabulary(t):
    assert dicts(checks.vocab_violations(t), "column_name", "value", "num_rows") == [
        ("note_type", "rumour", 1), ("severity", "Severe", 1), ("status", "Win", 1),
    ]


def test_orphans(t):
    assert dicts(checks.orphan_rows(t), "table_name", "column_name", "missing_id", "num_rows") == [
        ("opportunity_notes", "opp_id", "O8", 1),
        ("sales_activities", "opp_id", "O8", 1),
        ("sales_opportunities", "customer_id", "C9", 1),
        ("support_activities", "ticket_id", "T9", 1),
    ]


def test_keys(t):
    assert dicts(checks.key_violations(t), "table_name", "column_name", "rule", "num_rows") == [
        ("customers", "customer_id", "duplicate", 1),
        ("sales_activities", "activity_at", "null", 1),
        ("sales_activities", "activity_id", "duplicate", 1),
        ("sales_opportunities", "product_id", "null", 1),
    ]


def test_ranges(t):
    assert dicts(checks.range_violations(t), "row_id", "rule") == [
        ("C1@2026-01-07", "csat outside 1..5"),
        ("C1@2026-02-07", "csat outside 1..5"),
        ("O4", "closed before opened"),
        ("T2", "closed day and status disagree"),
    ]
