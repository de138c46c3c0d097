"""Entities, edges, traversals, rule checks and counts."""

# entity: (table, key, display, ((property, SQL type), ...))
_T, _D, _I, _B, _F = "VARCHAR", "TIMESTAMP", "BIGINT", "BOOLEAN", "DOUBLE"
_ENTITIES = {
    "customer": ("customers", "customer_id", "customer_name",
                 (("customer_id", _T), ("customer_name", _T), ("country", _T))),
    "product": ("products", "product_id", "product_name",
                (("product_id", _T), ("product_name", _T), ("product_line", _T))),
    "sales_opportunity": (
        "sales_opportunities", "opp_id", "opp_id",
        (("opp_id", _T), ("type", _T), ("status", _T), ("stage", _T), ("opened_at", _D),
         ("expected_close_date", _D), ("closed_at", _D), ("is_forecast", _B),
         ("forecast_category", _T), ("stage_last_changed_at", _D), ("amount", _F),
         ("currency", _T), ("probability", _I), ("renewal_term_months", _I))),
    "sales_activity": (
        "sales_activities", "activity_id", "type",
        (("activity_id", _T), ("activity_at", _D), ("description", _T), ("type", _T),
         ("contact_name", _T))),
    "sales_note": (
        "opportunity_notes", "note_id", "note_type",
        (("note_id", _T), ("note_at", _D), ("note_type", _T), ("note_text", _T), ("tags", _T))),
    "support_ticket": (
        "support_tickets", "ticket_id", "title",
        (("ticket_id", _T), ("status", _T), ("opened_at", _D), ("closed_at", _D),
         ("severity", _T), ("priority", _T), ("channel", _T), ("title", _T),
         ("sla_breach_flag", _B), ("assigned_group", _T))),
    "support_activity": (
        "support_activities", "activity_id", "activity_type",
        (("activity_id", _T), ("activity_at", _D), ("description", _T), ("author", _T),
         ("activity_type", _T), ("minutes_spent", _I))),
}

_EDGES = (
    ("has_opportunity", "customer", "sales_opportunity", "sales_opportunities", "customer_id", "opp_id"),
    ("has_opportunity_product", "sales_opportunity", "product", "sales_opportunities", "opp_id", "product_id"),
    ("has_opportunity_activity", "sales_opportunity", "sales_activity", "sales_activities", "opp_id", "activity_id"),
    ("has_opportunity_note", "sales_opportunity", "sales_note", "opportunity_notes", "opp_id", "note_id"),
    ("has_ticket", "customer", "support_ticket", "support_tickets", "customer_id", "ticket_id"),
    ("has_support_product", "support_ticket", "product", "support_tickets", "ticket_id", "product_id"),
    ("has_support_activity", "support_ticket", "support_activity", "support_activities", "ticket_id", "activity_id"),
)
EDGES = " UNION ALL ".join(
    f"SELECT '{rel}' AS rel, '{src}' AS src_type, CAST({a} AS VARCHAR) AS src_id, "
    f"'{dst}' AS dst_type, CAST({b} AS VARCHAR) AS dst_id FROM {table} "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for rel, src, dst, table, a, b in _EDGES
)


def _view(name: str) -> str:
    table, _, _, columns = _ENTITIES[name]
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns)} FROM {table}"


_VOCABULARY = {
    ("sales_opportunities", "status"): "'Open', 'Won', 'Lost'",
    ("sales_opportunities", "type"): "'New', 'Expansion', 'Project', 'Renewal'",
    ("sales_opportunities", "stage"):
        "'Qualification', 'Discovery', 'Proposal', 'Negotiation', 'Procurement'",
    ("sales_opportunities", "forecast_category"): "'Pipeline', 'BestCase', 'Commit'",
    ("support_tickets", "status"): "'Open', 'Closed'",
    ("support_tickets", "severity"): "'Low', 'Medium', 'High', 'Critical'",
    ("support_tickets", "priority"): "'P1', 'P2', 'P3', 'P4'",
    ("opportunity_notes", "note_type"): "'neutral', 'progress', 'risk'",
}
_REFERENCES = (
    ("sales_opportunities", "customer_id", "customers", "customer_id"),
    ("sales_opportunities", "product_id", "products", "product_id"),
    ("sales_activities", "opp_id", "sales_opportunities", "opp_id"),
    ("opportunity_notes", "opp_id", "sales_opportunities", "opp_id"),
    ("support_tickets", "customer_id", "customers", "customer_id"),
    ("support_tickets", "product_id", "products", "product_id"),
    ("support_activities", "ticket_id", "support_tickets", "ticket_id"),
)
_REQUIRED = {
    "customers": ("customer_id", "customer_name"),
    "products": ("product_id", "product_name", "product_line"),
    "csat_by_month": ("customer_id", "month", "csat"),
    "support_tickets": ("ticket_id", "customer_id", "product_id", "status", "opened_at",
                        "severity", "priority"),
    "support_activities": ("activity_id", "ticket_id", "activity_at", "description"),
    "sales_opportunities": ("opp_id", "customer_id", "product_id", "type", "status", "stage",
                            "opened_at", "expected_close_date", "is_forecast",
                            "stage_last_changed_at", "amount", "currency", "probability"),
    "sales_activities": ("activity_id", "opp_id", "activity_at", "description"),
    "opportunity_notes": ("note_id", "opp_id", "note_at", "note_type", "note_text"),
}
_KEYS = {
    "customers": "customer_id", "products": "product_id", "csat_by_month": "customer_id,month",
    "support_tickets": "ticket_id", "support_activities": "activity_id",
    "sales_opportunities": "opp_id", "sales_activities": "activity_id",
    "opportunity_notes": "note_id",
}
_TABLES = tuple(_KEYS)


def _lifecycle(table: str, key: str) -> str:
    return f"""
      SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_id, 'closed before opened' AS rule
      FROM {table} WHERE closed_at < opened_at
      UNION ALL
      SELECT '{table}', CAST({key} AS VARCHAR), 'closed day and status disagree'
      FROM {table} WHERE (closed_at IS NULL) <> (status = 'Open')"""


MODEL = {
    **{f"entity_view_{name}": _view(name) for name in _ENTITIES},
    "entity_index": " UNION ALL ".join(
        f"SELECT '{name}' AS entity_type, CAST({key} AS VARCHAR) AS entity_id, "
        f"CAST({display} AS VARCHAR) AS display_name FROM {table}"
        for name, (table, key, display, _) in _ENTITIES.items()
    ),
    "entity_timeseries": """
        SELECT CAST(c.customer_id AS VARCHAR) AS customer_id, c.customer_name, c.country,
          CAST(s.month AS TIMESTAMP) AS month, CAST(s.csat AS BIGINT) AS csat
        FROM customers c LEFT JOIN csat_by_month s ON s.customer_id = c.customer_id""",
    "edges": EDGES,
    "entity_degree": f"""
        SELECT rel, src_type, src_id, count(*) AS degree FROM ({EDGES})
        GROUP BY rel, src_type, src_id""",
    "traverse_path_customer_ticket_product": """
        SELECT 'customer' AS src_type, CAST(customer_id AS VARCHAR) AS src_id,
          'product' AS dst_type, CAST(product_id AS VARCHAR) AS dst_id, count(*) AS num_paths
        FROM support_tickets GROUP BY customer_id, product_id""",
    "traverse_path_customer_opportunity_note": """
        SELECT 'customer' AS src_type, CAST(o.customer_id AS VARCHAR) AS src_id,
          'sales_note' AS dst_type, CAST(n.note_id AS VARCHAR) AS dst_id, count(*) AS num_paths
        FROM sales_opportunities o JOIN opportunity_notes n ON n.opp_id = o.opp_id
        GROUP BY o.customer_id, n.note_id""",
    "traverse_path_customer_opportunity_product": """
        SELECT 'customer' AS src_type, CAST(customer_id AS VARCHAR) AS src_id,
          'product' AS dst_type, CAST(product_id AS VARCHAR) AS dst_id, count(*) AS num_paths
        FROM sales_opportunities GROUP BY customer_id, product_id""",
    "traverse_path_customer_opportunity_activity": """
        SELECT 'customer' AS src_type, CAST(customer_id AS VARCHAR) AS src_id,
          'sales_activity' AS dst_type, CAST(activity_id AS VARCHAR) AS dst_id, count(*) AS num_paths
        FROM sales_opportunities JOIN sales_activities USING (opp_id)
        GROUP BY customer_id, activity_id""",
    "traverse_path_customer_ticket_activity": """
        SELECT 'customer' AS src_type, CAST(customer_id AS VARCHAR) AS src_id,
          'support_activity' AS dst_type, CAST(activity_id AS VARCHAR) AS dst_id,
          count(*) AS num_paths
        FROM support_tickets JOIN support_activities USING (ticket_id)
        GROUP BY customer_id, activity_id""",
    "vocab_violations": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, "
        f"count(*) AS num_rows FROM {table} WHERE {column} NOT IN ({values}) GROUP BY {column}"
        for (table, column), values in _VOCABULARY.items()
    ),
    "orphan_rows": " UNION ALL ".join(
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, "
        f"CAST({column} AS VARCHAR) AS missing_id, count(*) AS num_rows FROM {child} "
        f"WHERE {column} NOT IN (SELECT {key} FROM {parent}) GROUP BY {column}"
        for child, column, parent, key in _REFERENCES
    ),
    "key_violations": "SELECT * FROM (" + " UNION ALL ".join(
        [
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, 'null' AS rule, "
            f"count(*) AS num_rows FROM {table} WHERE {column} IS NULL"
            for table, columns in _REQUIRED.items() for column in columns
        ]
        + [
            f"SELECT '{table}', '{key}', 'duplicate', count(*) - count(DISTINCT ({key})) FROM {table}"
            for table, key in _KEYS.items()
        ]
    ) + ") WHERE num_rows > 0",
    "range_violations": f"""
        SELECT 'csat_by_month' AS table_name, customer_id || '@' || month AS row_id,
          'csat outside 1..5' AS rule
        FROM csat_by_month WHERE csat < 1 OR csat > 5
        UNION ALL {_lifecycle('support_tickets', 'ticket_id')}
        UNION ALL {_lifecycle('sales_opportunities', 'opp_id')}""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS num_rows FROM {table}" for table in _TABLES
    ),
    "tsv_roundtrip": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS num_source, count(*) AS num_copy, "
        f"CAST(0 AS BIGINT) AS num_different FROM {table}"
        for table in _TABLES
    ),
}
MODEL["entity_index_from_definition"] = MODEL["entity_index"]
MODEL["edges_from_definition"] = MODEL["edges"]
MODEL["catalog_roundtrip"] = MODEL["tsv_roundtrip"]
MODEL["entity_index_from_folder"] = MODEL["entity_index"]
MODEL["edges_from_folder"] = MODEL["edges"]

# Both ways from one type to the other, each counted by pairs of the table that joins them.
MODEL["route_product_to_customer"] = " UNION ALL ".join(
    f"SELECT '{route}' AS route, 'product' AS src_type, CAST(product_id AS VARCHAR) AS src_id, "
    f"'customer' AS dst_type, CAST(customer_id AS VARCHAR) AS dst_id, count(*) AS num_paths "
    f"FROM {table} GROUP BY product_id, customer_id"
    for route, table in (
        ("~has_opportunity_product/~has_opportunity", "sales_opportunities"),
        ("~has_support_product/~has_ticket", "support_tickets"),
    )
)
MODEL["route_note_to_product"] = """
    SELECT '~has_opportunity_note/has_opportunity_product' AS route, 'sales_note' AS src_type,
      CAST(note_id AS VARCHAR) AS src_id, 'product' AS dst_type,
      CAST(product_id AS VARCHAR) AS dst_id, count(*) AS num_paths
    FROM opportunity_notes JOIN sales_opportunities USING (opp_id) GROUP BY note_id, product_id"""

_LINE = """concat_ws(chr(9), activity_id, if(activity_id % 73 = 0, 'T?', CAST(ticket_id AS VARCHAR)),
  if(activity_id % 97 = 0, '2000-13-45', CAST(activity_at AS VARCHAR)),
  if(activity_id % 83 = 0, '', description), author, activity_type,
  minutes_spent || if(activity_id % 89 = 0, '.5', ''), if(activity_id % 79 = 0, 'one more', NULL))"""
MODEL["import_rejects"] = f"""
    SELECT {_LINE} AS record,
      CASE WHEN activity_id % 79 = 0 THEN 'wrong number of fields'
        WHEN activity_id % 73 = 0 THEN 'no bigint in ticket_id'
        WHEN activity_id % 97 = 0 THEN 'no date in activity_at'
        WHEN activity_id % 83 = 0 THEN 'no value in description'
        ELSE 'fraction in minutes_spent' END AS reason
    FROM support_activities
    WHERE 0 IN (activity_id % 73, activity_id % 79, activity_id % 83, activity_id % 89, activity_id % 97)"""
MODEL["import_loaded"] = """
    SELECT count(*) AS num_source, count(*) AS num_copy, CAST(0 AS BIGINT) AS num_different
    FROM support_activities
    WHERE 0 NOT IN (activity_id % 73, activity_id % 79, activity_id % 83, activity_id % 89, activity_id % 97)"""
