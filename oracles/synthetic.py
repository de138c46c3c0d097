"""Generated tables, drawn again with DuckDB's md5."""

from pipewright.plans import generate

SEED = 42
AS_OF = "DATE '2026-03-08'"
START = "DATE '2025-07-01'"


def _h(label: str, *keys: str) -> str:
    return f"md5(concat_ws('|', {SEED}, '{label}', {', '.join(keys)}))"


def _slot(h: str, i: int) -> str:
    return f"CAST('0x' || substr({h}, {4 * i + 1}, 4) AS INTEGER)"


def _int(h: str, i: int, low: int, high: int) -> str:
    return f"({low} + {_slot(h, i)} % {high - low + 1})"


def _pick(h: str, i: int, values: tuple) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[{_int(h, i, 1, len(values))}]"


def _percent(h: str, i: int, percent: int) -> str:
    return f"({_slot(h, i)} % 100 < {percent})"


def _capped(day: str, cap: str = AS_OF) -> str:
    return f"least({day}, {cap})"


# The fixed lists of the synthetic business are stated once, in the generator.
NAMES, COUNTRIES = zip(*generate.CUSTOMERS)
PRODUCTS, LINES = zip(*generate.PRODUCTS)


def _wide(h: str, n: str) -> str:
    return f"CAST('0x' || substr({h}, 1, 8) AS BIGINT) % {n}"



def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMED = f"""
  SELECT printf('P%03d', p_partkey + 1) AS product_id,
    ({_list(PRODUCTS)})[p_partkey % {len(PRODUCTS)} + 1]
      || CASE WHEN p_partkey < {len(PRODUCTS)} THEN '' ELSE ' ' || (p_partkey + 1) END AS product_name
  FROM part"""
_PLACED = f"""
  SELECT product_id, product_name,
    row_number() OVER (ORDER BY {_wide(_h('product place', 'product_id'), '1024')}, product_id) - 1
      AS place
  FROM ({_NAMED})"""


def _product(label: str, key: str) -> str:
    """A join with the product that a row draws."""
    drawn = _wide(_h(label, key), "(SELECT count(*) FROM part)")
    return f"JOIN ({_PLACED}) ON place = {drawn}"


CUSTOMER = "SELECT c_custkey AS no, printf('C%03d', c_custkey + 1) AS customer_id FROM customer"

TICKET_BASE = f"""
  SELECT no * 65 + n - 1 AS ticket_no, no, customer_id,
    {_h('ticket', 'no * 65 + n - 1')} AS h, {_h('ticket detail', 'no * 65 + n - 1')} AS h2
  FROM (SELECT *, unnest(range(1, 1 + {_int(_h('ticket count', 'no'), 0, 35, 65)})) AS n
        FROM ({CUSTOMER}))"""
OPENED = f"""CASE WHEN no % 5 = 2 AND {_percent('h', 1, 75)}
    THEN {AS_OF} - 120 + {_slot('h', 2)} % 121
    ELSE {START} + {_slot('h', 2)} % CAST({AS_OF} - {START} + 1 AS INTEGER) END"""
TICKETS = f"""
  SELECT *, CAST({OPENED} AS DATE) AS opened_at,
    CASE WHEN {_percent('h', 3, 75)} THEN 'Closed' ELSE 'Open' END AS status,
    CASE WHEN {_slot('h', 5)} % 100 < 40 THEN 'Low' WHEN {_slot('h', 5)} % 100 < 75 THEN 'Medium'
      WHEN {_slot('h', 5)} % 100 < 95 THEN 'High' ELSE 'Critical' END AS severity
  FROM ({TICKET_BASE})"""

OPPS = f"""
  SELECT *, CAST({START} + {_slot('h', 3)} % CAST({AS_OF} - {START} + 1 AS INTEGER) AS DATE) AS opened_at,
    {_pick('h', 5, ('Open', 'Won', 'Lost'))} AS status,
    CASE WHEN asks AND earlier < 2 THEN 'Renewal'
      WHEN {_pick('h', 1, ('Renewal', 'Expansion', 'Project'))} = 'Renewal' AND earlier >= 2
        THEN {_pick('h', 2, ('Expansion', 'Project'))}
      ELSE {_pick('h', 1, ('Renewal', 'Expansion', 'Project'))} END AS type
  FROM (
    SELECT *, no * 18 + n - 1 AS opp_no, {_h('opp', 'no * 18 + n - 1')} AS h,
      {_h('opp detail', 'no * 18 + n - 1')} AS h2,
      COALESCE(sum(CAST(asks AS INTEGER)) OVER (PARTITION BY no ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM (
      SELECT *, {_percent(_h('force renewal', 'no', 'n'), 0, 25)} AS asks
      FROM (SELECT *, unnest(range(1, 1 + {_int(_h('opp count', 'no'), 0, 10, 18)})) AS n
            FROM ({CUSTOMER}))))"""
OPPORTUNITIES = f"""
  SELECT *, CAST({_capped(f"opened_at + {_int('h', 4, 14, 120)}", f"{AS_OF} + 120")} AS DATE)
    AS expected_close_date FROM ({OPPS})"""

SYNTHETIC = {
    "gen_dimensions": f"""
        SELECT 'customer' AS dimension, printf('C%03d', c_custkey + 1) AS id,
          ({_list(NAMES)})[c_custkey % {len(NAMES)} + 1]
            || CASE WHEN c_custkey < 5 THEN '' ELSE ' ' || (c_custkey + 1) END AS name,
          ({_list(COUNTRIES)})[c_custkey % {len(NAMES)} + 1] AS attribute
        FROM customer
        UNION ALL
        SELECT 'product', product_id, product_name,
          ({_list(LINES)})[CAST(substr(product_id, 2) AS BIGINT) % {len(LINES)}
            + if(CAST(substr(product_id, 2) AS BIGINT) % {len(LINES)} = 0, {len(LINES)}, 0)]
        FROM ({_NAMED})""",
    "gen_csat": f"""
        SELECT customer_id, CAST({AS_OF} - 30 * m AS DATE) AS month,
          CAST(greatest(1, least(5, {_int(_h('csat', 'no'), 0, 3, 4)}
            + {_pick(_h('csat month', 'no', 'm'), 0, (-1, 0, 0, 0, 1))}
            + CASE WHEN no % 5 = 2 AND m IN (2, 3) THEN 1 ELSE 0 END)) AS INTEGER) AS csat
        FROM (SELECT *, CAST(unnest(range(1, 13)) AS INTEGER) AS m FROM ({CUSTOMER}))""",
    "gen_tickets": f"""
        SELECT 'T' || (1000 + ticket_no) AS ticket_id, customer_id,
          product_id, status, opened_at,
          CASE WHEN status = 'Closed'
            THEN CAST({_capped(f"opened_at + {_int('h', 4, 1, 30)}")} AS DATE) END AS closed_at,
          severity,
          CASE severity WHEN 'Low' THEN 'P4' WHEN 'Medium' THEN 'P3' WHEN 'High' THEN 'P2'
            ELSE 'P1' END AS priority,
          {_pick('h', 6, ('Portal', 'Email', 'Phone'))} AS channel,
          'Issue on ' || product_name AS title,
          severity IN ('High', 'Critical') AND status = 'Open' AND {_percent('h', 7, 30)}
            AS sla_breach_flag,
          {_pick('h2', 0, generate.GROUPS)} AS assigned_group
        FROM ({TICKETS}) {_product('ticket product', 'ticket_no')}""",
    "gen_support_activities": f"""
        SELECT 'SA' || (20000 + activity_no) AS activity_id, 'T' || (1000 + ticket_no) AS ticket_id,
          CAST({_capped(f"opened_at + {_int('a', 0, 0, 30)}")} AS DATE) AS activity_at,
          {_pick('a', 1, generate.SUPPORT_STEPS)} AS description,
          {_pick('a', 2, generate.AUTHORS)} AS author,
          {_pick('a', 3, generate.SUPPORT_TYPES)} AS activity_type,
          CAST({_int('a', 4, 5, 120)} AS INTEGER) AS minutes_spent
        FROM (SELECT *, ticket_no * 5 + k - 1 AS activity_no,
                {_h('support', 'ticket_no * 5 + k - 1')} AS a
              FROM (SELECT *, unnest(range(1, 1 + {_int(_h('support count', 'ticket_no'), 0, 0, 5)}))
                      AS k FROM ({TICKETS})))""",
    "gen_opportunities": f"""
        SELECT 'O' || (5000 + opp_no) AS opp_id, customer_id,
          product_id, type, status,
          {_pick('h', 6, ('Qualification', 'Discovery', 'Proposal', 'Negotiation',
                          'Procurement'))} AS stage,
          opened_at, expected_close_date,
          CASE WHEN status <> 'Open' THEN CAST({_capped(
              f"opened_at + {_int('h2', 0, 14, 150)}",
              f"least({AS_OF}, expected_close_date)")} AS DATE) END AS closed_at,
          status = 'Open' AS is_forecast,
          CASE WHEN status = 'Open' THEN {_pick('h2', 1, ('Pipeline', 'BestCase', 'Commit'))} END
            AS forecast_category,
          CAST({_capped(f"opened_at + {_int('h', 7, 3, 90)}")} AS DATE) AS stage_last_changed_at,
          CAST({_pick('h2', 2, (25000, 40000, 60000, 85000, 120000, 180000))} AS DOUBLE) AS amount,
          'EUR' AS currency,
          CAST(CASE status WHEN 'Won' THEN 100 WHEN 'Lost' THEN 0
            ELSE {_pick('h2', 3, (30, 40, 50, 60, 70))} END AS INTEGER) AS probability,
          CASE WHEN type = 'Renewal' THEN 12 END AS renewal_term_months
        FROM ({OPPORTUNITIES}) {_product('opp product', 'opp_no')}""",
    "gen_sales_activities": f"""
        SELECT 'A' || (60000 + activity_no) AS activity_id, 'O' || (5000 + opp_no) AS opp_id,
          CAST(CASE WHEN stale THEN {AS_OF} - {_pick('a', 0, (15, 21, 28))}
            ELSE {_capped(f"opened_at + {_int('a', 1, 1, 90)}")} END AS DATE) AS activity_at,
          CASE WHEN stale
            THEN {_pick('a', 2, generate.STALE_STEPS)}
            ELSE {_pick('a', 3, generate.SALES_STEPS)} END AS description,
          CASE WHEN stale THEN {_pick('a', 4, generate.STALE_TYPES)}
            ELSE {_pick('a', 5, generate.SALES_TYPES)} END AS type,
          {_pick('a', 6, generate.CONTACTS)} AS contact_name
        FROM (
          SELECT *, opp_no * 5 + k - 1 AS activity_no, {_h('sales', 'opp_no * 5 + k - 1')} AS a
          FROM (
            SELECT *, unnest(range(1, 1 + CASE WHEN stale THEN {_pick('g', 1, (0, 0, 1))}
              ELSE {_int('g', 2, 0, 5)} END)) AS k
            FROM (
              SELECT *, status = 'Open' AND expected_close_date BETWEEN DATE '2026-03-01'
                AND DATE '2026-03-28' AND {_percent('g', 0, 50)} AS stale
              FROM (SELECT *, {_h('sales count', 'opp_no')} AS g FROM ({OPPORTUNITIES})))))""",
    "gen_notes": f"""
        SELECT 'N' || (70000 + opp_no) AS note_id, 'O' || (5000 + opp_no) AS opp_id,
          CAST({_capped(f"opened_at + {_int('g', 1, 10, 90)}")} AS DATE) AS note_at,
          'risk' AS note_type,
          '{generate.RISK_TEXT}' AS note_text, '{generate.RISK_TAGS}' AS tags
        FROM (SELECT *, {_h('note', 'opp_no')} AS g FROM ({OPPORTUNITIES}) WHERE status = 'Open')
        WHERE {_percent('g', 0, 25)}""",
}


# Draws as the generator deals them out, counted by value: the 65,536 slots of a draw by remainder.
def _fit(table: str, column: str, sql: str, weights: dict[str, int], limit: float) -> str:
    values = ", ".join(f"('{v}', {w})" for v, w in weights.items())
    return f"""
      SELECT '{table}' AS table_name, '{column}' AS column_name,
        CAST(sum(seen) AS BIGINT) AS num_rows,
        CAST(coalesce(sum(seen) FILTER (WHERE w IS NULL), 0) AS BIGINT) AS num_undeclared,
        round(coalesce(sum(power(seen - e, 2) / e) FILTER (WHERE w IS NOT NULL), 0), 4) AS chi_square,
        {len(weights) - 1} AS degrees_of_freedom,
        num_undeclared = 0 AND chi_square <= {limit} AS fits
      FROM (
        SELECT coalesce(n, 0) AS seen, w, w / 65536.0 * sum(n) FILTER (WHERE w IS NOT NULL) OVER () AS e
        FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM ({sql})
              WHERE {column} IS NOT NULL GROUP BY v)
        FULL JOIN (VALUES {values}) declared(v, w) USING (v))"""


def _slots(values: tuple) -> dict[str, int]:
    """Slots by remainder: the first remainders come once more."""
    return {str(v): len(range(i, 65536, len(values))) for i, v in enumerate(values)}


def _rolls(*bounds: tuple[str, int, int]) -> dict[str, int]:
    """Slots whose last two decimal digits lie between bounds."""
    return {v: sum(len(range(r, 65536, 100)) for r in range(a, b)) for v, a, b in bounds}


# Upper 0.1 % points of chi-square by degrees of freedom, after Wilson and Hilferty.
_LIMITS = {k: k * (1 - 2 / 9 / k + 3.090232306167813 * (2 / 9 / k) ** 0.5) ** 3 for k in range(1, 6)}
_WEIGHTS = {
    ("support_tickets", "gen_tickets"): {
        "severity": _rolls(("Low", 0, 40), ("Medium", 40, 75), ("High", 75, 95), ("Critical", 95, 100)),
        "status": _rolls(("Closed", 0, 75), ("Open", 75, 100)),
        "channel": _slots(generate.CHANNELS),
        "assigned_group": _slots(generate.GROUPS),
    },
    ("support_activities", "gen_support_activities"): {
        "description": _slots(generate.SUPPORT_STEPS),
        "author": _slots(generate.AUTHORS),
        "activity_type": _slots(generate.SUPPORT_TYPES),
    },
    ("sales_opportunities", "gen_opportunities"): {
        "status": _slots(generate.OPP_STATUSES),
        "stage": _slots(generate.STAGES),
        "forecast_category": _slots(generate.CATEGORIES),
        "amount": _slots(generate.AMOUNTS),
    },
    ("sales_activities", "gen_sales_activities"): {"contact_name": _slots(generate.CONTACTS)},
}
# Which product a ticket is about plays no part here.
_TICKET_VALUES = f"""
  SELECT severity, status, {_pick('h', 6, generate.CHANNELS)} AS channel,
    {_pick('h2', 0, generate.GROUPS)} AS assigned_group
  FROM ({TICKETS})"""
_MADE = {job: _TICKET_VALUES if job == "gen_tickets" else SYNTHETIC[job] for _, job in _WEIGHTS}
SYNTHETIC["gen_distributions"] = (
    "WITH "
    + ", ".join(f"made_{job} AS MATERIALIZED ({sql})" for job, sql in _MADE.items())
    + " ".join(
        f"{'UNION ALL' if i else ''} {fit}"
        for i, fit in enumerate(
            _fit(table, column, f"SELECT * FROM made_{job}", weights, _LIMITS[len(weights) - 1])
            for (table, job), columns in _WEIGHTS.items()
            for column, weights in columns.items()
        )
    )
)
