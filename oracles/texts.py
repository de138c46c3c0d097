"""Text cleaning, definitions, Markdown, ground truth and evaluation."""

from oracles.business import ACCELERATE_POLICIES, RENEWAL_SWEEP, slip_sweep_sql, sweep_sql
from oracles.seeds import (
    CASES,
    LOAD_QUESTION,
    LOAD_SQL,
    NOTHING_QUESTION,
    NOTHING_SQL,
    OVERVIEW_QUESTION,
    PHRASINGS,
    QUIET_QUESTION,
    QUIET_SQL,
    SEVERITY_SQL,
    STAGE_SQL,
)

BLANKS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)"
    "||chr(133)||chr(160)||chr(5760)||"
    + "||".join(f"chr({c})" for c in range(8192, 8203))
    + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def _clean(text: str) -> str:
    return (
        f"trim(regexp_replace(replace(replace({text}, chr(9), ' '), '\"', '\\\"'), ' +', ' ', 'g'), "
        f"{BLANKS})"
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PARTS = """
  SELECT event_id AS item, CAST(0 AS INTEGER) AS position, 'items/' || event_id || '/definition.json' AS path,
    CASE event_type WHEN 'error' THEN 'broken ' || props ELSE CAST(json(props) AS VARCHAR) END
      AS content,
    event_type <> 'error' AS is_json, if(event_type = 'error', 'not json', 'json') AS status
  FROM events WHERE event_id % 53 <> 0
  UNION ALL SELECT event_id, 1, 'items/' || event_id || '/notes.txt',
    if(event_id % 59 = 0, NULL, props), false, if(event_id % 59 = 0, 'not base64', 'text')
  FROM events WHERE event_id % 53 <> 0
  UNION ALL SELECT event_id, 2, '.platform', event_type, false, 'text'
  FROM events WHERE event_id % 53 <> 0
  UNION ALL SELECT event_id, NULL, NULL, NULL, false, 'no definition'
  FROM events WHERE event_id % 53 = 0"""


def _num(col: str) -> str:
    return f"COALESCE(printf('%.2f', {col}), '')"


def _bool(col: str) -> str:
    return f"CASE WHEN {col} THEN 'True' WHEN NOT {col} THEN 'False' ELSE '' END"


def _text(col: str) -> str:
    return f"COALESCE(CAST({col} AS VARCHAR), '')"


def _row(*cells: str) -> str:
    return _clean("'| ' || " + " || ' | ' || ".join(cells) + " || ' |'")


def _head(title: str | None, columns: list[str]) -> str:
    head = f"| {' | '.join(columns)} |\n|{':-|' * len(columns)}"
    return _literal(f"{title}\n\n{head}" if title else head)


def _table(title: str | None, columns: list[str], body: str, order: str, source: str) -> str:
    return (
        f"(SELECT {_head(title, columns)} || coalesce(chr(10) || "
        f"string_agg({body}, chr(10) ORDER BY {order}), '') FROM ({source}))"
    )


QUIET_ROWS = """
  SELECT o.expected_close_date, o.opp_id, o.amount,
    (SELECT count(*) FROM opportunity_notes n WHERE n.opp_id = o.opp_id AND n.note_type = 'risk')
      AS risk_notes
  FROM sales_opportunities o
  WHERE o.status = 'Open' AND strftime(o.expected_close_date, '%Y-%m') = '2000-02'
    AND o.opp_id NOT IN (SELECT opp_id FROM sales_activities WHERE activity_at >= DATE '2000-02-01')"""
QUIET_COLUMNS = ["expected_close_date", "opp_id", "amount", "risk_notes"]
LOAD_ROWS = """
  SELECT severity, count(DISTINCT customer_id) AS c, count(*) AS n
  FROM support_tickets SEMI JOIN (
    SELECT customer_id FROM sales_opportunities WHERE type = 'Renewal'
      AND year(expected_close_date) = 2000 AND quarter(expected_close_date) = 2) USING (customer_id)
  WHERE status = 'Open' GROUP BY severity"""
STAGE_ROWS = """
  SELECT stage, count(*) AS n, bool_or(is_forecast) AS f FROM sales_opportunities
  WHERE status = 'Open' GROUP BY stage"""
SEVERITY_ROWS = """
  SELECT severity, count(*) AS n, max(nullif(channel, 'Portal')) AS ch FROM support_tickets
  WHERE status = 'Open' GROUP BY severity"""

WHOLE = (
    (
        LOAD_QUESTION, LOAD_SQL,
        _table(None, ["severity", "num_customers", "num_tickets"],
               _row(_text("severity"), _text("c"), _text("n")), "severity", LOAD_ROWS),
    ),
    (NOTHING_QUESTION, NOTHING_SQL, _head(None, ["product_id", "product_name"])),
    (
        OVERVIEW_QUESTION, f"{STAGE_SQL};\n{SEVERITY_SQL}",
        _table("Opportunities:", ["stage", "num_opps", "any_forecast"],
               _row(_text("stage"), _text("n"), _bool("f")), "stage", STAGE_ROWS)
        + " || chr(10) || chr(10) || "
        + _table("Tickets:", ["severity", "num_tickets", "last_channel"],
                 _row(_text("severity"), _text("n"), _text("ch")), "severity", SEVERITY_ROWS),
    ),
)


def _asked(question: str, statement: str) -> str:
    plain = statement.replace("{", "").replace("}", "")
    return f"{_clean(_literal(question))} AS question, {_clean(_literal(plain))} AS sql"


_QUIET_LINE = _row(
    _text("expected_close_date"), _text("opp_id"), _num("amount"), _text("risk_notes")
)
GROUND_TRUTH = " UNION ALL ".join(
    [f"SELECT {_asked(q, s)}, 'all' AS part, {result} AS result" for q, s, result in WHOLE]
    + [
        f"SELECT {_asked(QUIET_QUESTION, QUIET_SQL)}, 'head', {_head(None, QUIET_COLUMNS)}",
        f"SELECT {_asked(QUIET_QUESTION, QUIET_SQL)}, CAST(expected_close_date AS VARCHAR), "
        f"string_agg({_QUIET_LINE}, chr(10) ORDER BY opp_id) FROM ({QUIET_ROWS}) "
        "GROUP BY expected_close_date",
    ]
)


def _monthly(stagnant: int = 21, tag: str | None = None) -> str:
    return slip_sweep_sql(
        [
            (f"2000-{m:02d}", f"2000-{m:02d}-01",
             f"2000-{m + 1:02d}-01" if m < 12 else "2001-01-01",
             f"2000-{m:02d}-15", f"2000-{m:02d}-01", 14, stagnant, 60, tag, "High Critical", None)
            for m in range(1, 13)
        ]
    )


def _scores(run: str, question: str, questions: str, expected: str, actual: str) -> str:
    """Both sides as one multiset: rows of the truth count up, rows of the run count down."""
    return f"""
      SELECT '{run}' AS evaluation_id, {question},
        CAST(coalesce(e, 0) AS BIGINT) AS expected_rows, CAST(coalesce(a, 0) AS BIGINT) AS actual_rows,
        CAST((coalesce(e, 0) + coalesce(a, 0) - coalesce(off, 0)) // 2 AS BIGINT) AS common_rows,
        CAST((coalesce(e, 0) + coalesce(a, 0) + coalesce(off, 0)) // 2 AS BIGINT) AS all_rows,
        CAST(CASE WHEN coalesce(off, 0) = 0 THEN 5 WHEN common_rows = 0 THEN 1
          WHEN 5 * common_rows >= 4 * all_rows THEN 4 WHEN 2 * common_rows >= all_rows THEN 3
          ELSE 2 END AS INTEGER) AS score,
        score > 3 AS passed
      FROM (SELECT DISTINCT {question} FROM ({questions})) LEFT JOIN (
        SELECT {question}, sum(up) AS e, sum(down) AS a, sum(abs(up - down)) AS off
        FROM (
          SELECT {question}, r, count_if(side = 1) AS up, count_if(side = 0) AS down
          FROM (SELECT {question}, x AS r, 1 AS side FROM ({expected}) x
                UNION ALL SELECT {question}, y, 0 FROM ({actual}) y)
          GROUP BY ALL)
        GROUP BY {question}) USING ({question})"""


_ASKED = "SELECT unnest([" + ", ".join(
    f"'{q}'" for q in [*(f"2000-{m:02d}" for m in range(1, 13)), "2030-01"]
) + "]) AS policy_id"
RUNS = " UNION ALL ".join(
    _scores(run, "policy_id", _ASKED, _monthly(), actual)
    for run, actual in (
        ("stale stages only", _monthly(stagnant=60)),
        ("exact tags", _monthly(tag="risk")),
    )
)

_LOAD_ALTERED = LOAD_ROWS.replace("status = 'Open'", "status = 'Open' AND severity <> 'Low'")
_STAGE_ALTERED = STAGE_ROWS.replace("bool_or(is_forecast)", "bool_and(NOT is_forecast)")
_WRITTEN = f"""
  SELECT question, unnest(string_split(result, chr(10))) AS line FROM ({GROUND_TRUTH})
  WHERE part = 'all'"""
_WRITTEN_ALTERED = _WRITTEN.replace(LOAD_ROWS, _LOAD_ALTERED).replace(STAGE_ROWS, _STAGE_ALTERED)
EVAL_WRITTEN = _scores(
    "altered", "question", f"SELECT question FROM ({GROUND_TRUTH}) WHERE part = 'all'",
    f"SELECT * FROM ({_WRITTEN}) WHERE line <> ''",
    f"SELECT * FROM ({_WRITTEN_ALTERED}) WHERE line <> ''",
)

# Cell by cell: both sides of a run side by side by deal, values compared one at a time.
_VALUES = ["type", "customer_name", "product_name", "stage", "forecast_category",
           "expected_close_date", "no_activity_flag", "stage_stagnant_flag", "delivery_risk_flag"]
_FLAG = "if({0} = 1, 0, 1) AS {0}"
_CHANGED = {
    "to the cent": "* REPLACE (amount + 0.004 AS amount)",
    "an eighth off": "* REPLACE (if(opp_id % 8 = 0, 0, amount) AS amount)",
    "other values": "* REPLACE (NULL AS type, NULL AS stage, '?' AS forecast_category, 2 * amount AS amount, "
    + ", ".join(_FLAG.format(f) for f in _VALUES[-3:]) + ")",
    "a third": "*",
    "a month late": "* REPLACE (strftime(CAST(policy_id || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS policy_id)",
}
_SAME_CELLS = "1 + list_sum([" + ", ".join(
    [f"CAST(e.{c} IS NOT DISTINCT FROM a.{c} AS INTEGER)" for c in _VALUES]
    + ["CAST(coalesce(round(abs(e.amount - a.amount), 9) <= 0.005, "
       "e.amount IS NULL AND a.amount IS NULL) AS INTEGER)"]
) + "])"
CELLS = " UNION ALL ".join(
    f"""
      SELECT '{run}' AS evaluation_id, policy_id, expected_rows, actual_rows, matched_rows,
        expected_rows - matched_rows AS missing_rows, actual_rows - matched_rows AS extra_rows,
        same_cells, 11 * matched_rows - same_cells AS differing_cells,
        11 * (expected_rows + actual_rows - matched_rows) AS all_cells,
        CAST(CASE WHEN same_cells = all_cells THEN 5 WHEN 10 * same_cells >= 8 * all_cells THEN 4
          WHEN 2 * matched_rows >= expected_rows + actual_rows - matched_rows THEN 3
          WHEN matched_rows > 0 THEN 2 ELSE 1 END AS INTEGER) AS score,
        score > 3 AS passed
      FROM (
        SELECT asked.policy_id, count(e.opp_id) AS expected_rows, count(a.opp_id) AS actual_rows,
          count(e.opp_id + a.opp_id) AS matched_rows,
          CAST(coalesce(sum({_SAME_CELLS}) FILTER (WHERE e.opp_id = a.opp_id), 0) AS BIGINT)
            AS same_cells
        FROM ({{asked}}) asked LEFT JOIN (
          (SELECT policy_id AS p, * FROM ({{rows}})) e FULL JOIN
          (SELECT policy_id AS p, * FROM (SELECT {changed} FROM ({{rows}})
           WHERE {'opp_id % 3 = 0' if run == 'a third' else 'true'})) a
          ON a.p = e.p AND a.opp_id = e.opp_id) ON asked.policy_id = coalesce(e.p, a.p)
        GROUP BY asked.policy_id)"""
    for run, changed in _CHANGED.items()
).format(asked=_ASKED, rows=_monthly())

_ANSWER_COLUMNS = {
    "slip": ["opp_id", "type", "customer_name", "product_name", "stage", "forecast_category", "amount",
             "expected_close_date", "no_activity_flag", "stage_stagnant_flag", "delivery_risk_flag"],
    "renewal": ["opp_id", "customer_name", "product_name", "expected_close_date", "amount", "type",
                "expansion_amount", "num_incidents", "low_expansion_flag", "high_incident_flag"],
    "accelerate": ["opp_id", "customer_name", "expected_close_date", "is_forecast", "product_name",
                   "last_signal"],
}
_ANSWER_ROWS = {
    "slip": sweep_sql(),
    "renewal": RENEWAL_SWEEP,
    "accelerate": " UNION ALL ".join(
        f"SELECT '{name}' AS policy_id, * FROM ({sql})" for name, sql in ACCELERATE_POLICIES.items()
    ),
}


def _answer_cell(column: str) -> str:
    if column in ("amount", "expansion_amount"):
        return _num(column)
    return _bool(column) if column == "is_forecast" else _text(column)


def _answers(seed: str) -> str:
    columns = _ANSWER_COLUMNS[seed]
    head = f"| {' | '.join(columns)} |\n|{':-|' * len(columns)}"
    cases = ", ".join(
        f"({_literal(kind)}, {_literal(value)}, {_literal(policy)})"
        for own, kind, value, policy in CASES if own == seed
    )
    return f"""
      SELECT '{seed}' AS seed_id, kind, value, coalesce(part, 'none') AS part,
        {_literal(head)} || coalesce(chr(10) || body, '') AS answer
      FROM (VALUES {cases}) asked(kind, value, policy_id) LEFT JOIN (
        SELECT policy_id, strftime(expected_close_date, '%Y-%m') AS part,
          string_agg({_row(*map(_answer_cell, columns))}, chr(10) ORDER BY opp_id) AS body
        FROM ({_ANSWER_ROWS[seed]}) GROUP BY ALL) USING (policy_id)"""


_SEED_IDS = ", ".join(f"'{s}'" for s in dict.fromkeys(p[0] for p in PHRASINGS))
_POLICIES = ", ".join(
    f"'{month} with {days} quiet days'"
    for month, days in [(f"2000-{m:02d}", 14) for m in range(1, 13)] + [("2000-01", 30)]
)
_PHRASING_ROWS = ", ".join(f"('{s}', {n}, {_literal(t)})" for s, n, t in PHRASINGS)

ANSWERED = f"""
    WITH phrasing(seed_id, phrasing_no, template) AS (VALUES {_PHRASING_ROWS})
    SELECT seed_id, kind, value, phrasing_no,
      {_clean("replace(template, '{value}', value)")} AS question, part, answer
    FROM ({' UNION ALL '.join(_answers(seed) for seed in _ANSWER_COLUMNS)}) JOIN phrasing USING (seed_id)"""

TEXTS = {
    "eval_cell_scores": CELLS,
    "eval_runs_replaced": RUNS,
    "answered_variants": ANSWERED,
    "clean_text": " UNION ALL ".join(
        f"SELECT '{table}' AS source, concat_ws('/', {key}) AS row_id, {_clean('text')} AS cleaned "
        f"FROM {table}"
        for table, key in (
            ("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id, turn")
        )
    )
    + f" UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), {_clean('html')} FROM pages",
    "definition_parts": PARTS,
    "definition_documents": f"""
        SELECT item,
          '{{' || string_agg(CAST(to_json(path) AS VARCHAR) || ':'
            || CASE WHEN is_json THEN content ELSE coalesce(CAST(to_json(content) AS VARCHAR), 'null')
               END, ',' ORDER BY path) || '}}' AS document,
          if(any_value(path) IS NULL, 'no definition', 'json') AS status
        FROM ({PARTS}) GROUP BY item""",
    "documents_roundtrip": """
        SELECT count(*) AS num_source, count(*) AS num_copy, CAST(0 AS BIGINT) AS num_different
        FROM events WHERE event_id % 53 <> 0""",
    "markdown_render": f"""
        SELECT customer_id, CAST(year(expected_close_date) AS INTEGER) AS close_year,
          max(customer_name) || ':' || chr(10) || chr(10)
          || '| opp_id | type | expected_close_date | amount | is_forecast | renewal_term_months |'
          || chr(10) || '|:-|:-|:-|:-|:-|:-|' || chr(10)
          || string_agg({_row(_text('opp_id'), 'type', _text('expected_close_date'), _num('amount'),
                              _bool('is_forecast'), _text('renewal_term_months'))},
             chr(10) ORDER BY opp_id) AS markdown
        FROM sales_opportunities JOIN customers USING (customer_id)
        WHERE status = 'Open' GROUP BY customer_id, year(expected_close_date)""",
    "ground_truth": GROUND_TRUTH,
    "ground_truth_roundtrip": f"""
        SELECT count(*) AS num_source, count(*) AS num_copy, CAST(0 AS BIGINT) AS num_different
        FROM ({GROUND_TRUTH})""",
    "question_variants": f"""
        WITH variant AS (
          SELECT DISTINCT 'horizon' AS kind, strftime(expected_close_date, '%Y-%m') AS value
          FROM sales_opportunities
          UNION SELECT DISTINCT 'product', product_line FROM products
          UNION SELECT 'policy', unnest([{_POLICIES}])),
        phrasing(seed_id, phrasing_no, template) AS (VALUES {_PHRASING_ROWS})
        SELECT p.seed_id, v.kind, v.value, p.phrasing_no,
          {_clean("replace(p.template, '{value}', v.value)")} AS question
        FROM variant v CROSS JOIN phrasing p""",
    "eval_scores": RUNS,
    "eval_details": f"SELECT * FROM ({RUNS}) WHERE NOT passed",
    "eval_summary": f"""
        SELECT evaluation_id, count(*) AS num_questions, round(avg(score), 4) AS mean_score,
          round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate,
          {', '.join(f'count(*) FILTER (WHERE score = {s}) AS score_{s}' for s in range(1, 6))}
        FROM ({RUNS}) GROUP BY evaluation_id""",
    "eval_written_answers": EVAL_WRITTEN,
}
