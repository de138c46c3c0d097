"""Declared column types of the eight tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Table layouts, as (column, type, whether it may be NULL).
_LAYOUTS = {
    "customers": [
        ("customer_id", "string", False),
        ("customer_name", "string", False),
        ("country", "string", True),
    ],
    "products": [
        ("product_id", "string", False),
        ("product_name", "string", False),
        ("product_line", "string", False),
    ],
    "csat_by_month": [
        ("customer_id", "string", False),
        ("month", "date", False),
        ("csat", "integer", False),
    ],
    "support_tickets": [
        ("ticket_id", "string", False),
        ("customer_id", "string", False),
        ("product_id", "string", False),
        ("status", "string", False),
        ("opened_at", "date", False),
        ("closed_at", "date", True),
        ("severity", "string", False),
        ("priority", "string", False),
        ("channel", "string", True),
        ("title", "string", True),
        ("sla_breach_flag", "boolean", True),
        ("assigned_group", "string", True),
    ],
    "support_activities": [
        ("activity_id", "string", False),
        ("ticket_id", "string", False),
        ("activity_at", "date", False),
        ("description", "string", False),
        ("author", "string", True),
        ("activity_type", "string", True),
        ("minutes_spent", "integer", True),
    ],
    "sales_opportunities": [
        ("opp_id", "string", False),
        ("customer_id", "string", False),
        ("product_id", "string", False),
        ("type", "string", False),
        ("status", "string", False),
        ("stage", "string", False),
        ("opened_at", "date", False),
        ("expected_close_date", "date", False),
        ("closed_at", "date", True),
        ("is_forecast", "boolean", False),
        ("forecast_category", "string", True),
        ("stage_last_changed_at", "date", False),
        ("amount", "double", False),
        ("currency", "string", False),
        ("probability", "integer", False),
        ("renewal_term_months", "integer", True),
    ],
    "sales_activities": [
        ("activity_id", "string", False),
        ("opp_id", "string", False),
        ("activity_at", "date", False),
        ("description", "string", False),
        ("type", "string", True),
        ("contact_name", "string", True),
    ],
    "opportunity_notes": [
        ("note_id", "string", False),
        ("opp_id", "string", False),
        ("note_at", "date", False),
        ("note_type", "string", False),
        ("note_text", "string", False),
        ("tags", "string", True),
    ],
}


def _schema(columns: list[tuple[str, str, bool]]) -> T.StructType:
    schema = T.StructType()
    for name, kind, nullable in columns:
        schema = schema.add(name, kind, nullable)
    return schema


SCHEMAS: dict[str, T.StructType] = {name: _schema(c) for name, c in _LAYOUTS.items()}

# Identifier columns of each table.
KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "csat_by_month": ["customer_id", "month"],
    "support_tickets": ["ticket_id"],
    "support_activities": ["activity_id"],
    "sales_opportunities": ["opp_id"],
    "sales_activities": ["activity_id"],
    "opportunity_notes": ["note_id"],
}
