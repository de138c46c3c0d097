"""Slip risk, renewals, acceleration, customers, pipeline and support."""


NAMED = """
  (SELECT customer_name FROM customers WHERE customers.customer_id = deal.customer_id)
    AS customer_name,
  (SELECT product_name FROM products WHERE products.product_id = deal.product_id) AS product_name"""

RISK_NOTES = """
  SELECT opp_id FROM opportunity_notes
  GROUP BY opp_id
  HAVING bool_or((note_type = 'risk' OR contains(coalesce(tags, ''), 'risk'))
    AND note_at > DATE '1999-12-02')"""
SEVERE = """
  SELECT customer_id, product_id FROM support_tickets
  GROUP BY customer_id, product_id
  HAVING count(*) FILTER (WHERE list_contains(['High', 'Critical'], severity) AND status = 'Open'
    AND opened_at > DATE '1999-12-02') > 0"""

# Day limits of February 2000, seen on the 15th: 14 days without activity, 21 in a stage.
FLAGS = f"""
  SELECT deal.opp_id, deal.type, {NAMED}, deal.stage, deal.forecast_category, deal.amount,
    deal.expected_close_date,
    CAST(deal.opp_id NOT IN (SELECT opp_id FROM sales_activities
      WHERE activity_at >= DATE '2000-02-01') AS INTEGER) AS no_activity_flag,
    CAST(deal.stage_last_changed_at < DATE '2000-01-25' AS INTEGER) AS stage_stagnant_flag,
    CAST(deal.opp_id IN ({RISK_NOTES}) OR (deal.customer_id, deal.product_id) IN ({SEVERE})
      AS INTEGER) AS delivery_risk_flag
  FROM sales_opportunities deal
  WHERE strftime(deal.expected_close_date, '%Y-%m') = '2000-02' AND deal.status = 'Open'"""
RAISED = "list_sum([no_activity_flag, stage_stagnant_flag, delivery_risk_flag])"


def _reasons(*pairs: tuple[str, str]) -> str:
    named = ", ".join(f"if({flag} = 1, '{name}', NULL)" for flag, name in pairs)
    return f"array_to_string(list_filter([{named}], lambda r: r IS NOT NULL), '; ')"


def sweep_sql() -> str:
    # (id, start, end, as_of, base, activity, stagnant, signal, exact tag, severities, product)
    rows = [
        (f"2000-{m:02d}", f"2000-{m:02d}-01", f"2000-{m + 1:02d}-01" if m < 12 else "2001-01-01",
         f"2000-{m:02d}-15", f"2000-{m:02d}-01", 14, 21, 60, None, "High Critical", None)
        for m in range(1, 13)
    ]
    rows += [
        ("first quarter, patient", "2000-01-01", "2000-04-01", "2000-02-15", "2000-02-01",
         30, 45, 60, None, "High Critical", None),
        ("february, exact tag", "2000-02-01", "2000-03-01", "2000-02-15", "2000-02-01",
         14, 21, 60, "at_risk", "Critical", None),
        ("february, product 8", "2000-02-01", "2000-03-01", "2000-02-15", "2000-02-01",
         14, 21, 90, None, "High Critical", 8),
    ]
    return slip_sweep_sql(rows)


def slip_sweep_sql(rows: list[tuple]) -> str:
    """Every policy by itself, stacked: limits are days worked out here, not in the statement."""
    from datetime import date, timedelta

    def back(day: str, days: int) -> str:
        return f"DATE '{date.fromisoformat(day) - timedelta(days=days)}'"

    statements = []
    for name, start, end, as_of, base, quiet, stagnant, signal, tag, severities, product in rows:
        tagged = (
            "contains(coalesce(tags, ''), 'risk')"
            if tag is None
            else f"list_contains(string_split(tags, ';'), '{tag}')"
        )
        listed = ", ".join(f"'{s}'" for s in severities.split())
        since = back(base, signal)
        statements.append(f"""
          SELECT '{name}' AS policy_id, deal.opp_id, deal.type, {NAMED}, deal.stage,
            deal.forecast_category, deal.amount, deal.expected_close_date,
            CAST(deal.opp_id NOT IN (SELECT opp_id FROM sales_activities
              WHERE activity_at >= {back(as_of, quiet)}) AS INTEGER) AS no_activity_flag,
            CAST(deal.stage_last_changed_at < {back(as_of, stagnant)} AS INTEGER)
              AS stage_stagnant_flag,
            CAST(deal.opp_id IN (SELECT opp_id FROM opportunity_notes
                WHERE note_at >= {since} AND (coalesce(note_type = 'risk', false) OR {tagged}))
              OR (deal.customer_id, deal.product_id) IN (
                SELECT (customer_id, product_id) FROM support_tickets
                WHERE opened_at >= {since} AND status = 'Open' AND severity IN ({listed}))
              AS INTEGER) AS delivery_risk_flag
          FROM sales_opportunities deal
          WHERE deal.status = 'Open' AND deal.expected_close_date >= DATE '{start}'
            AND deal.expected_close_date < DATE '{end}'
            {'' if product is None else f'AND deal.product_id = {product}'}""")
    return " UNION ALL ".join(statements)


# Per customer, from both sides at once: money still to be won, and open tickets.
def _standing(types: str, severities: str) -> str:
    return f"""
      SELECT customer_id, sum(money) AS expansion_amount, sum(ticket) AS num_incidents
      FROM (
        SELECT customer_id, CAST(amount AS DECIMAL(18, 2)) AS money, 0 AS ticket
        FROM sales_opportunities WHERE type IN ({types}) AND status = 'Open'
        UNION ALL
        SELECT customer_id, 0, 1 FROM support_tickets
        WHERE severity IN ({severities}) AND status = 'Open')
      GROUP BY customer_id"""


def _renewal_sql(where: str, limit: float, minimum: int, types: str, severities: str) -> str:
    return f"""
      SELECT deal.opp_id, {NAMED}, deal.expected_close_date, deal.amount, deal.type,
        expansion_amount, num_incidents, CAST(expansion_amount < {limit} AS INTEGER)
          AS low_expansion_flag,
        CAST(num_incidents >= {minimum} AS INTEGER) AS high_incident_flag
      FROM (
        SELECT o.*, CAST(coalesce(expansion_amount, 0) AS DOUBLE) AS expansion_amount,
          CAST(coalesce(num_incidents, 0) AS BIGINT) AS num_incidents
        FROM sales_opportunities o NATURAL LEFT JOIN ({_standing(types, severities)})
        WHERE o.type = 'Renewal') deal
      WHERE NOT (expansion_amount >= {limit} AND num_incidents < {minimum}) AND {where}"""


def _months(first: int, last: int) -> str:
    return (
        f"deal.expected_close_date BETWEEN DATE '2000-{first:02d}-01' "
        f"AND last_day(DATE '2000-{last:02d}-01')"
    )


BOTH = "'Expansion', 'Project'"
HIGH = "'High', 'Critical'"
ANY = "'Low', 'Medium', 'High', 'Critical'"
RENEWAL = _renewal_sql(_months(2, 4), 100000, 3, BOTH, HIGH)
RENEWAL_SWEEP = " UNION ALL ".join(
    f"SELECT '{name}' AS policy_id, * FROM ({sql})"
    for name, sql in (
        ("default", RENEWAL),
        ("strict", _renewal_sql(_months(1, 6), 250000, 8, BOTH, HIGH)),
        (
            "any severity, open",
            _renewal_sql(f"{_months(2, 4)} AND deal.status = 'Open'", 100000, 3, BOTH, ANY),
        ),
        (
            "product 5",
            _renewal_sql(f"{_months(1, 12)} AND deal.product_id = 5", 100000, 3, "'Expansion'", HIGH),
        ),
    )
)

LATEST_CSAT = """
  SELECT customer_id, last.month AS month, last.csat AS csat
  FROM (SELECT customer_id, max({'month': month, 'csat': csat}) AS last FROM csat_by_month
        GROUP BY customer_id)"""


def _dated(at: str, text: str) -> str:
    return f"concat(month({at}), '/', day({at}), '/', year({at}), ': ', {text})"


NOTE_MONTHS = f"""
  SELECT opp_id, CAST(date_trunc('month', note_at) AS DATE) AS notes_month,
    array_to_string(list_transform(list_sort(list({{'d': note_at, 't': {_dated('note_at', 'note_text')}}})),
      lambda n: n.t), chr(59) || chr(10) || chr(10)) AS opp_notes
  FROM opportunity_notes GROUP BY ALL"""
# All notes of a deal in one text.
NOTES = NOTE_MONTHS.replace("CAST(date_trunc('month', note_at) AS DATE) AS notes_month,", "")
SIGNALS = """
  SELECT opp_id, max({'d': note_at, 'n': note_id, 't': note_type}).t AS last_signal
  FROM opportunity_notes GROUP BY opp_id"""


def _open_deals(where: str = "true") -> str:
    return f"""
      SELECT customer_name, type, opp_id, product_name, expected_close_date, status, stage,
        is_forecast, forecast_category, amount, notes_month, opp_notes
      FROM sales_opportunities deal NATURAL JOIN customers
      LEFT JOIN products USING (product_id) LEFT JOIN ({NOTE_MONTHS}) USING (opp_id)
      WHERE deal.status = 'Open' AND {where}"""


def _open_tickets(where: str = "true") -> str:
    return f"""
      SELECT customer_name, product_name, status, severity, priority, title, assigned_group
      FROM support_tickets NATURAL JOIN customers LEFT JOIN products USING (product_id)
      WHERE status = 'Open' AND {where}"""


def accelerate_sql(where: str, texts: str = NOTE_MONTHS, visits: str = "type IN ('meeting', 'demo')",
                   least: int = 1, blocking: str = "risk") -> str:
    """Deals to pull forward, with all columns of their texts."""
    return f"""
      SELECT opp_id, customer_name, expected_close_date, is_forecast, product_name, last_signal,
        COLUMNS('^(notes_month|opp_notes)$')
      FROM sales_opportunities deal
      SEMI JOIN (SELECT opp_id FROM sales_activities WHERE {visits}
                 GROUP BY opp_id HAVING count(*) >= {least}) USING (opp_id)
      JOIN customers USING (customer_id) LEFT JOIN products USING (product_id)
      LEFT JOIN ({SIGNALS}) USING (opp_id) LEFT JOIN ({texts}) USING (opp_id)
      WHERE deal.status = 'Open' AND last_signal IS DISTINCT FROM '{blocking}' AND {where}"""


SECOND_HALF = "stage = 'Proposal' AND expected_close_date BETWEEN DATE '2000-07-01' AND DATE '2000-12-31'"
ACCELERATE_POLICIES = {
    "second half": accelerate_sql(SECOND_HALF),
    "first half, two visits": accelerate_sql(
        "stage = 'Negotiation' AND is_forecast AND month(expected_close_date) <= 6 "
        "AND year(expected_close_date) = 2000", least=2, blocking="neutral"),
    "product 5": accelerate_sql(
        "stage = 'Proposal' AND year(expected_close_date) = 2000 AND product_id = 5", visits="type = 'call'"),
}
ACCELERATE_POLICIES = {
    name: "SELECT DISTINCT opp_id, customer_name, expected_close_date, is_forecast, product_name, "
    f"last_signal FROM ({sql})"
    for name, sql in ACCELERATE_POLICIES.items()
}


def _critical(where: str = "true") -> str:
    return f"""
      SELECT ticket_id, customer_name, product_name, status, priority, title, actions_month, actions
      FROM support_tickets NATURAL JOIN customers LEFT JOIN products USING (product_id)
      LEFT JOIN (
        SELECT ticket_id, CAST(date_trunc('month', activity_at) AS DATE) AS actions_month,
          array_to_string(list_transform(
            list_sort(list({{'d': activity_at, 't': {_dated('activity_at', 'description')}}})),
            lambda a: a.t), chr(59) || chr(10) || chr(10)) AS actions
        FROM support_activities GROUP BY ALL) USING (ticket_id)
      WHERE (status, severity) = ('Open', 'Critical') AND {where}"""


BUSINESS = {
    "opp_last_activity": """
        SELECT opp_id, (SELECT max(activity_at) FROM sales_activities a
          WHERE a.opp_id = deal.opp_id) AS last_activity_at
        FROM sales_opportunities deal""",
    "ticket_last_activity": """
        SELECT ticket_id, max(activity_at) AS last_activity_at
        FROM support_tickets LEFT JOIN support_activities USING (ticket_id) GROUP BY ticket_id""",
    "delivered_activities": """
        SELECT opp_id, count(*) AS num_activities FROM sales_activities
        WHERE type IN ('demo', 'meeting') GROUP BY opp_id""",
    "never_active": """
        SELECT opp_id, customer_id, product_id, stage, amount, expected_close_date
        FROM sales_opportunities ANTI JOIN sales_activities USING (opp_id) WHERE status = 'Open'""",
    "stage_age": """
        WITH aged AS (SELECT stage, DATE '2000-02-15' - stage_last_changed_at AS days
                      FROM sales_opportunities WHERE status = 'Open')
        SELECT stage, count(*) AS num_opps, round(avg(days), 4) AS avg_days,
          CAST(max(days) AS INTEGER) AS max_days, CAST(count_if(days > 21) AS BIGINT) AS num_stagnant
        FROM aged GROUP BY stage""",
    "risk_notes": RISK_NOTES,
    "high_sev_keys": SEVERE,
    "slip_risk_flags": FLAGS,
    "slip_risk_top10": f"""
        SELECT *, CAST({RAISED} AS INTEGER) AS num_flags FROM ({FLAGS}) WHERE {RAISED} >= 1
        ORDER BY num_flags DESC, amount DESC, opp_id LIMIT 10""",
    "slip_risk_reasons": f"""
        SELECT opp_id, type, customer_name, product_name, stage, forecast_category, amount,
          expected_close_date, {_reasons(('no_activity_flag', 'no activity'),
            ('stage_stagnant_flag', 'stage stagnation'),
            ('delivery_risk_flag', 'delivery risk'))} AS reason
        FROM ({FLAGS}) WHERE {RAISED} >= 1""",
    "policy_sweep": sweep_sql(),
    "policy_sweep_renewals": RENEWAL_SWEEP,
    "expansion_pipeline": f"""
        SELECT customer_id, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS expansion_amount
        FROM sales_opportunities WHERE type IN ({BOTH}) AND status = 'Open' GROUP BY customer_id""",
    "open_incidents": f"""
        SELECT customer_id, count(*) AS num_incidents FROM support_tickets
        WHERE severity IN ({HIGH}) AND status = 'Open' GROUP BY customer_id""",
    "renewal_risk": RENEWAL,
    "renewal_risk_full": f"""
        WITH looked_at AS (
          SELECT deal.opp_id, {NAMED}, deal.expected_close_date, deal.amount, deal.type,
            CAST(coalesce(expansion_amount, 0) AS DOUBLE) AS expansion_amount,
            CAST(coalesce(num_incidents, 0) AS BIGINT) AS num_incidents, csat AS latest_csat,
            CAST(coalesce(expansion_amount, 0) < 100000 AS INTEGER) AS low_expansion_flag,
            CAST(coalesce(num_incidents, 0) > 2 AS INTEGER) AS high_incident_flag,
            CAST(EXISTS (SELECT 1 FROM support_tickets breached
              WHERE breached.customer_id = deal.customer_id AND breached.sla_breach_flag
                AND breached.status = 'Open') AS INTEGER) AS sla_breach_flag,
            CAST(coalesce(csat < 3, false) AS INTEGER) AS low_csat_flag
          FROM sales_opportunities deal
          LEFT JOIN ({_standing(BOTH, HIGH)}) USING (customer_id)
          LEFT JOIN ({LATEST_CSAT}) USING (customer_id)
          WHERE {_months(2, 4)} AND deal.type = 'Renewal')
        SELECT *, {_reasons(('low_expansion_flag', 'low expansion'),
            ('high_incident_flag', 'high incidents'), ('sla_breach_flag', 'SLA breach'),
            ('low_csat_flag', 'low CSAT'))} AS reason
        FROM looked_at
        WHERE greatest(low_expansion_flag, high_incident_flag, sla_breach_flag, low_csat_flag) = 1""",
    "latest_csat": LATEST_CSAT,
    "csat_last_month": """
        SELECT customer_id, month, CAST(1 AS INTEGER) AS month_no, csat
        FROM csat_by_month WHERE month = DATE '2000-01-01'""",
    "sla_breaches": """
        SELECT customer_id, status, CAST(count_if(sla_breach_flag) AS BIGINT) AS num_breaches FROM support_tickets
        GROUP BY customer_id, status HAVING bool_or(sla_breach_flag)""",
    "note_digest": f"SELECT * FROM ({NOTE_MONTHS}) NATURAL JOIN ({SIGNALS})",
    "tag_counts": """
        SELECT tag, note_type, count(*) AS num_notes
        FROM (SELECT unnest(string_split(tags, ';')) AS tag, note_type FROM opportunity_notes)
        GROUP BY tag, note_type""",
    "accelerate": f"""
        SELECT opp_id, customer_name, expected_close_date, is_forecast, product_name, last_signal,
          notes_month, opp_notes
        FROM sales_opportunities
        SEMI JOIN (SELECT opp_id FROM sales_activities WHERE type IN ('meeting', 'demo')) USING (opp_id)
        JOIN customers USING (customer_id) LEFT JOIN products USING (product_id)
        LEFT JOIN ({SIGNALS}) USING (opp_id) LEFT JOIN ({NOTE_MONTHS}) USING (opp_id)
        WHERE (stage, status) = ('Proposal', 'Open') AND last_signal IS DISTINCT FROM 'risk'
          AND expected_close_date BETWEEN DATE '2000-07-01' AND DATE '2000-12-31'""",
    "note_digest_whole": f"SELECT * FROM ({NOTES}) NATURAL JOIN ({SIGNALS})",
    "accelerate_whole": accelerate_sql(SECOND_HALF, NOTES),
    "customer_360_opps_whole": _open_deals().replace(NOTE_MONTHS, NOTES).replace("notes_month,", ""),
    "critical_ticket_actions_whole": _critical().replace(
        "CAST(date_trunc('month', activity_at) AS DATE) AS actions_month,", ""
    ).replace("actions_month,", ""),
    "policy_table_slip": sweep_sql(),
    "policy_table_renewals": RENEWAL_SWEEP,
    "policy_table_accelerate": " UNION ALL ".join(
        f"SELECT '{name}' AS policy_id, * FROM ({sql})" for name, sql in ACCELERATE_POLICIES.items()
    ),
    "customer_360_opps": _open_deals(),
    "customer_360_tickets": _open_tickets(),
    "customer_top_opps": """
        SELECT customer_id, customer_name, rank, opp_id, amount, product_name, is_forecast
        FROM customers NATURAL JOIN (
          SELECT customer_id, product_id, opp_id, amount, is_forecast,
            CAST(1 + count(*) OVER (PARTITION BY customer_id ORDER BY amount DESC, opp_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS rank
          FROM sales_opportunities WHERE status = 'Open')
        LEFT JOIN products USING (product_id)
        WHERE rank < 4""",
    "critical_ticket_actions": _critical(),
    "customer_360_opps_scoped": _open_deals("customer_id = 1 AND product_id = 6"),
    "customer_360_tickets_scoped": _open_tickets("customer_id = 2 AND product_id = 72"),
    "critical_ticket_actions_scoped": _critical("customer_id = 7"),
    "pipeline_health": """
        SELECT stage, forecast_category, count(*) AS num_opps,
          CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
          CAST(sum(CAST(amount AS DECIMAL(18, 2)) * probability * 0.01) AS DOUBLE) AS weighted_amount
        FROM sales_opportunities WHERE status = 'Open' GROUP BY stage, forecast_category""",
    "pipeline_by_line": """
        SELECT product_line, count(*) AS num_opps,
          CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
          CAST(sum(CAST(amount AS DECIMAL(18, 2)) * probability * 0.01) AS DOUBLE) AS weighted_amount
        FROM sales_opportunities LEFT JOIN products USING (product_id)
        WHERE status = 'Open' GROUP BY product_line""",
    "support_performance": """
        SELECT customer_id, severity, count(*) AS num_tickets, CAST(count_if(status = 'Open') AS BIGINT) AS num_open,
          CAST(count_if(sla_breach_flag) AS BIGINT) AS num_breached,
          round(avg(closed_at - opened_at), 4) AS avg_days_to_close,
          CAST(coalesce(sum((SELECT sum(minutes_spent) FROM support_activities a
            WHERE a.ticket_id = t.ticket_id)), 0) AS BIGINT) AS minutes_spent
        FROM support_tickets t GROUP BY customer_id, severity""",
}
