"""Curated questions with the SQL that answers them, and phrasings of each question."""

from __future__ import annotations

from pipewright.plans.truth import Seed

QUIET_QUESTION = """
Which open deals closing in February 2000 saw no activity since the "first" of that month?
Show when they close, their amount, and how many notes of type risk they have.
"""

QUIET_SQL = """
SELECT deal.expected_close_date, deal.opp_id, deal.amount, count(note.note_id) AS risk_notes
FROM {sales_opportunities} AS deal
LEFT ANTI JOIN {sales_activities} AS recent
  ON recent.opp_id = deal.opp_id AND recent.activity_at >= DATE'2000-02-01'
LEFT JOIN {opportunity_notes} AS note ON note.opp_id = deal.opp_id AND note.note_type = 'risk'
WHERE deal.status = 'Open' AND trunc(deal.expected_close_date, 'month') = DATE'2000-02-01'
GROUP BY ALL
"""

LOAD_QUESTION = """
How many open tickets of each severity do customers with a renewal in the second quarter
of 2000 have, and how many such customers are there?
"""

LOAD_SQL = """
SELECT severity, count(DISTINCT customer_id) AS num_customers, count(*) AS num_tickets
FROM {support_tickets}
WHERE status = 'Open' AND customer_id IN (
  SELECT customer_id FROM {sales_opportunities}
  WHERE type = 'Renewal' AND expected_close_date BETWEEN DATE'2000-04-01' AND DATE'2000-06-30')
GROUP BY severity
"""

NOTHING_QUESTION = "Which products have a name of a single letter?"

NOTHING_SQL = "SELECT product_id, product_name FROM {products} WHERE length(product_name) = 1"

OVERVIEW_QUESTION = """
Give an overview of the book: open opportunities per stage, and open tickets per severity.
"""

STAGE_SQL = """
SELECT stage, count(*) AS num_opps, max(is_forecast) AS any_forecast
FROM {sales_opportunities} WHERE status = 'Open' GROUP BY stage
"""

SEVERITY_SQL = """
SELECT severity, count(*) AS num_tickets, max(nullif(channel, 'Portal')) AS last_channel
FROM {support_tickets} WHERE status = 'Open' GROUP BY severity
"""

SEEDS = [
    Seed(QUIET_QUESTION, (QUIET_SQL,), part_by="expected_close_date"),
    Seed(LOAD_QUESTION, (LOAD_SQL,)),
    Seed(NOTHING_QUESTION, (NOTHING_SQL,)),
    Seed(OVERVIEW_QUESTION, (STAGE_SQL, SEVERITY_SQL), ("Opportunities", "Tickets:")),
]

# The same questions, answered by other statements.
ALTERED = {
    QUIET_QUESTION: QUIET_SQL.replace("count(note.note_id)", "0 * count(note.note_id)"),
    LOAD_QUESTION: LOAD_SQL.replace("status = 'Open' AND", "status = 'Open' AND severity <> 'Low' AND"),
    OVERVIEW_QUESTION: STAGE_SQL.replace("max(is_forecast)", "min(NOT is_forecast)"),
}

PHRASINGS = [
    ("slip", 1, "Which open deals may slip for {value}, and why?"),
    ("slip", 2, "List opportunities at risk of slipping for {value} with the reason."),
    ("slip", 3, 'For {value}:  what could "slip"?'),
    ("renewal", 1, "Which renewals are at risk for {value}?"),
    ("renewal", 2, "Show renewals of {value} with little expansion or many incidents."),
    ("renewal", 3, "Renewals in danger, {value}?"),
    ("accelerate", 1, "Which deals of {value} can be pulled forward?"),
    ("accelerate", 2, "Find opportunities for {value} that are ready to close early."),
    ("accelerate", 3, "What can be accelerated for {value}?"),
]

# What each question is varied by, and the policy that answers the variant.
CASES = [
    ("slip", "horizon", "March 2000", "2000-03"),
    ("slip", "policy", "a patient first quarter", "first quarter, patient"),
    ("slip", "product", "product 8", "february, product 8"),
    ("renewal", "horizon", "half a year", "strict"),
    ("renewal", "policy", "tickets of any severity", "any severity, open"),
    ("renewal", "product", "product 5", "product 5"),
    ("accelerate", "horizon", "the second half", "second half"),
    ("accelerate", "policy", "two visits", "first half, two visits"),
    ("accelerate", "product", "product 5", "product 5"),
]
