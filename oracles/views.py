"""The eight tables as SQL over the given parquet views: a shared WITH prefix for all statements."""

VIEWS = {
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_line FROM part""",
    "sales_opportunities": """
        SELECT o_orderkey AS opp_id, o_custkey AS customer_id, (o_custkey * 3 + o_orderkey % 4) % 200 AS product_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Renewal' WHEN '2-HIGH' THEN 'Expansion'
            WHEN '3-MEDIUM' THEN 'Expansion' ELSE 'Project' END AS type,
          CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Won' ELSE 'Lost' END AS status,
          CASE o_orderkey % 5 WHEN 0 THEN 'Qualification' WHEN 1 THEN 'Discovery'
            WHEN 2 THEN 'Proposal' WHEN 3 THEN 'Negotiation' ELSE 'Procurement' END AS stage,
          CAST(o_orderdate AS DATE) - CAST(14 + o_orderkey % 107 AS INTEGER) AS opened_at,
          CAST(o_orderdate AS DATE) AS expected_close_date,
          CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE)
            - CAST(14 + o_orderkey % 107 AS INTEGER) + CAST(14 + o_orderkey % 60 AS INTEGER)
            END AS closed_at,
          o_orderstatus = 'O' AS is_forecast,
          CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'Pipeline'
            WHEN 1 THEN 'BestCase' ELSE 'Commit' END END AS forecast_category,
          CAST(o_orderdate AS DATE) - CAST(14 + o_orderkey % 107 AS INTEGER)
            + CAST(3 + o_orderkey % 88 AS INTEGER) AS stage_last_changed_at,
          o_totalprice AS amount, CASE WHEN o_orderkey % 997 <> 0 THEN 'EUR' END AS currency,
          CAST(CASE o_orderstatus WHEN 'O' THEN 30 + 10 * (o_orderkey % 5) WHEN 'F' THEN 100
            ELSE 0 END AS INTEGER) AS probability,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 12 END AS renewal_term_months
        FROM orders""",
    "sales_activities": """
        SELECT l_orderkey * 8 + l_linenumber AS activity_id, l_orderkey AS opp_id,
          CAST(l_shipdate AS DATE) AS activity_at,
          'line ' || l_linenumber || ' ' || l_returnflag || l_linestatus AS description,
          CASE l_linenumber % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'demo' WHEN 2 THEN 'email'
            ELSE 'meeting' END AS type,
          CASE l_suppkey % 4 WHEN 0 THEN 'CIO' WHEN 1 THEN 'Head of Compliance'
            WHEN 2 THEN 'Procurement' ELSE 'IT Manager' END AS contact_name
        FROM lineitem""",
    "opportunity_notes": """
        SELECT event_id AS note_id, (event_id - event_id % 3) * 2 AS opp_id,
          CAST(ts AS DATE) - 8766 - CAST(event_id * 13 % 180 AS INTEGER) AS note_at,
          CASE event_type WHEN 'error' THEN 'risk' WHEN 'signup' THEN 'progress'
            WHEN 'purchase' THEN 'progress' WHEN 'click' THEN 'neutral'
            ELSE 'comment' END AS note_type,
          event_type || ' ' || props AS note_text,
          CASE WHEN event_type = 'error' THEN 'risk;delivery'
            WHEN event_type = 'click' AND value > 50 THEN 'timeline;at_risk'
            ELSE 'positive' END AS tags
        FROM events""",
    "support_tickets": """
        SELECT event_id AS ticket_id, user_id AS customer_id, event_id % 200 AS product_id,
          CASE WHEN event_id % 4 = 0 THEN 'Open' ELSE 'Closed' END AS status,
          CAST(ts AS DATE) - 8766 AS opened_at,
          CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) - 8766
            + CAST(event_id % 30 - 1 AS INTEGER) END AS closed_at,
          CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High'
            WHEN 'signup' THEN 'Medium' ELSE 'Low' END AS severity,
          CASE WHEN event_id % 499 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'P5'
            ELSE CASE event_type WHEN 'error' THEN 'P1' WHEN 'purchase' THEN 'P2'
              WHEN 'signup' THEN 'P3' ELSE 'P4' END END AS priority,
          CASE event_id % 3 WHEN 0 THEN 'Portal' WHEN 1 THEN 'Email' ELSE 'Phone' END AS channel,
          'Issue on product ' || (event_id % 200) AS title,
          event_id % 4 = 0 AND event_type IN ('error', 'purchase') AND event_id % 3 = 0
            AS sla_breach_flag,
          CASE event_id % 3 WHEN 0 THEN 'L1 Support' WHEN 1 THEN 'L2 Support'
            ELSE 'AML Specialists' END AS assigned_group
        FROM events""",
    "support_activities": """
        SELECT event_id AS activity_id, event_id - event_id % 2 AS ticket_id,
          CAST(ts AS DATE) - 8766 + CAST(event_id % 20 AS INTEGER) AS activity_at,
          'handled ' || event_type AS description,
          CASE user_id % 4 WHEN 0 THEN 'agent.john' WHEN 1 THEN 'agent.ana'
            WHEN 2 THEN 'agent.samir' ELSE 'agent.luca' END AS author,
          CASE event_id % 3 WHEN 0 THEN 'comment' WHEN 1 THEN 'worknote'
            ELSE 'escalation' END AS activity_type,
          CAST(5 + event_id % 116 AS INTEGER) AS minutes_spent
        FROM events""",
    "csat_by_month": """
        SELECT o_custkey AS customer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
          CAST(min(o_orderkey) % 7 AS INTEGER) AS csat
        FROM orders GROUP BY ALL""",
}


def with_views(statement: str) -> str:
    """Prefix a statement with the views it mentions."""
    used = [name for name in VIEWS if name in statement]
    prefix = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if not prefix:
        return statement
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {prefix}, {body[5:]}"
    return f"WITH {prefix} {body}"
