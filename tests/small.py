"""Small hand-made tables."""

from __future__ import annotations

from datetime import date

from pipewright.sources.schemas import SCHEMAS
from pipewright.tables import Tables

DEFAULTS = {
    "customers": {"customer_name": "Bank", "country": "IT"},
    "products": {"product_name": "Ledger", "product_line": "Core"},
    "csat_by_month": {},
    "support_tickets": {
        "customer_id": "C1", "product_id": "P1", "status": "Open", "opened_at": date(2026, 1, 10),
        "severity": "High", "priority": "P2", "channel": "Email", "title": "Issue",
        "sla_breach_flag": False, "assigned_group": "L1 Support",
    },
    "support_activities": {
        "activity_at": date(2026, 1, 11), "description": "looked", "author": "agent.ana",
        "activity_type": "comment", "minutes_spent": 10,
    },
    "sales_opportunities": {
        "customer_id": "C1", "product_id": "P1", "type": "Project", "status": "Open",
        "stage": "Proposal", "opened_at": date(2026, 1, 1),
        "expected_close_date": date(2026, 2, 10), "is_forecast": True,
        "forecast_category": "Commit", "stage_last_changed_at": date(2026, 2, 10),
        "amount": 1000.0, "currency": "EUR", "probability": 50,
    },
    "sales_activities": {"description": "called", "type": "call", "contact_name": "CIO"},
    "opportunity_notes": {"note_type": "neutral", "note_text": "text", "tags": None},
}


def tables(spark, **rows: list[dict]) -> Tables:
    """Tables with the given rows; columns left out take a default, tables left out are empty."""
    frames = {}
    for name in Tables.names():
        schema = SCHEMAS[name]
        filled = [
            tuple({**DEFAULTS[name], **row}.get(f.name) for f in schema.fields)
            for row in rows.get(name, [])
        ]
        # Columns stay nullable, as they are when read from files.
        frames[name] = spark.createDataFrame(filled, _nullable(schema))
    return Tables(spark, frames)


def _nullable(schema):
    import copy

    schema = copy.deepcopy(schema)
    for f in schema.fields:
        f.nullable = True
    return schema


def dicts(df, *columns) -> list:
    """Rows as sorted tuples of the given columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
