"""Answers from tables of policies against the answers to one policy at a time."""

import re
from dataclasses import replace
from datetime import date

import pytest

import __spark_entry__ as registry
from pipewright import SlipPolicy
from pipewright.plans import accelerate, notes, renewal, slip, variants
from pipewright.policy import AcceleratePolicy, RenewalPolicy
from pipewright.sources import catalog, literal, star
from tests.small import dicts, tables

FOLDER = "/root/testdata/sf0.001"
FEBRUARY = {"window_start": date(2026, 2, 1), "window_end": date(2026, 3, 1)}


@pytest.fixture(scope="module")
def given(spark):
    return star.load(spark, FOLDER)


def rows_of(df, policy):
    return sorted(map(repr, (tuple(r) for r in df.where(df.policy_id == policy).drop("policy_id").collect())))


@pytest.mark.parametrize("sweep", ["SLIP_SWEEP", "RENEWAL_SWEEP", "ACCELERATE_SWEEP"])
def test_each_row_of_the_table_answers_like_its_policy(spark, given, sweep):
    policies = getattr(registry, sweep)
    table, single = {
        "SLIP_SWEEP": (variants.slip_answers, slip.slip_risk_flags),
        "RENEWAL_SWEEP": (variants.renewal_answers, renewal.renewal_risk),
        "ACCELERATE_SWEEP": (
            variants.accelerate_answers,
            lambda t, p: accelerate.accelerate(t, p, whole=True).drop("opp_notes"),
        ),
    }[sweep]
    found = table(given, variants.policy_table(spark, policies)).cache()
    for p in policies:
        assert rows_of(found, p.policy_id) == sorted(map(repr, (tuple(r) for r in single(given, p).collect())))
    found.unpersist()


def test_windows_tags_and_severities(spark):
    base = SlipPolicy(**FEBRUARY, as_of=date(2026, 2, 15), base=date(2026, 2, 1), policy_id="plain")
    policies = [
        base,
        replace(base, exact_tag="risk", policy_id="exact"),
        replace(base, severities=("Low",), policy_id="low"),
        replace(base, severities=(), policy_id="no severity"),
        replace(base, window_end=date(2026, 2, 1), policy_id="empty"),
        replace(base, window_start=date(2026, 2, 11), window_end=date(2026, 3, 15), policy_id="late"),
    ]
    t = tables(
        spark,
        customers=[{"customer_id": "C1"}],
        products=[{"product_id": "P1"}],
        sales_opportunities=[{"opp_id": "O1"}, {"opp_id": "O2", "product_id": "P2"}, {"opp_id": "O3", "status": "Won"}],
        opportunity_notes=[
            {"note_id": "N1", "opp_id": "O2", "note_at": date(2026, 1, 20), "tags": "at_risk;x;x"},
            {"note_id": "N2", "opp_id": "O2", "note_at": date(2026, 1, 21), "tags": None, "note_type": None},
        ],
        support_tickets=[{"ticket_id": "T1"}, {"ticket_id": "T2", "severity": "Low", "status": "Closed"}],
    )
    found = variants.slip_answers(t, variants.policy_table(spark, policies))
    flags = {}
    for policy, opp, risk in dicts(found, "policy_id", "opp_id", "delivery_risk_flag"):
        flags.setdefault(policy, {})[opp] = risk
    assert flags == {
        "plain": {"O1": 1, "O2": 1},
        "exact": {"O1": 1, "O2": 0},
        "low": {"O1": 0, "O2": 1},
        "no severity": {"O1": 0, "O2": 1},
    }


def test_27_cases_have_answers(spark):
    cases = registry.queries()["answered_variants"](spark, FOLDER).collect()
    assert len({(c.seed_id, c.kind, c.phrasing_no) for c in cases}) == 27
    assert all(c.answer.startswith("| opp_id |") and c.question for c in cases)
    for c in cases:
        rows = c.answer.count("\n") - 1
        assert rows == 0 if c.part == "none" else rows > 0


def test_a_variant_without_rows_has_the_head_of_its_table(spark):
    t = tables(spark)
    policy = AcceleratePolicy(**FEBRUARY, policy_id="p")
    answers = {"accelerate": variants.accelerate_answers(t, variants.policy_table(spark, [policy]))}
    columns = [("seed_id", literal.TEXT), ("kind", literal.TEXT), ("value", literal.TEXT), ("policy_id", literal.TEXT)]
    asked = literal.literal_table(spark, columns, [("accelerate", "horizon", "February", "p")])
    phrasings = literal.literal_table(
        spark,
        [("seed_id", literal.TEXT), ("phrasing_no", literal.INT), ("template", literal.TEXT)],
        [("accelerate", 1, "What of {value}?")],
    )
    found = variants.answered_variants(asked, phrasings, answers, {"accelerate": ["opp_id"]}).collect()
    assert [(r.question, r.part) for r in found] == [("What of February?", "none")]
    assert found[0].answer.endswith("|:-|:-|:-|:-|:-|:-|")


def test_amounts_of_a_type_named_twice_count_once(spark):
    policy = RenewalPolicy(**FEBRUARY, expansion_types=("Project", "Project"), expansion_limit=150.0, policy_id="p")
    t = tables(
        spark,
        customers=[{"customer_id": "C1"}],
        sales_opportunities=[
            {"opp_id": "O1", "type": "Renewal"},
            {"opp_id": "O2", "amount": 100.1, "expected_close_date": date(2026, 9, 1)},
        ],
    )
    found = variants.renewal_answers(t, variants.policy_table(spark, [policy]))
    assert dicts(found, "opp_id", "expansion_amount", "low_expansion_flag") == [("O1", 100.1, 1)]


def test_whole_digests(spark):
    t = tables(
        spark,
        opportunity_notes=[
            {"note_id": "N3", "opp_id": "O1", "note_at": date(2026, 2, 3), "note_text": "third 'quoted' \\n"},
            {"note_id": "N1", "opp_id": "O1", "note_at": date(2026, 1, 2), "note_text": "b"},
            {"note_id": "N2", "opp_id": "O1", "note_at": date(2026, 1, 2), "note_text": "a"},
            {"note_id": "N4", "opp_id": "O2", "note_at": date(2026, 1, 2), "note_text": "a"},
        ],
    )
    found = notes.note_digest(t, whole=True)
    assert dicts(found, "opp_id", "opp_notes") == [
        ("O1", "1/2/2026: a;\n\n1/2/2026: b;\n\n2/3/2026: third 'quoted' \\n"),
        ("O2", "1/2/2026: a"),
    ]


def test_sweeps_open_the_months_that_policies_ask_for(spark, given, tmp_path):
    catalog.save_by_month(given.sales_opportunities, "opportunities_by_month", path=str(tmp_path / "o"))
    by_month = given.replaced(sales_opportunities=spark.table("opportunities_by_month"))
    table = {
        variants.slip_answers: registry.SLIP_SWEEP[:3],
        variants.renewal_answers: registry.RENEWAL_SWEEP[:1],
    }
    for job, policies in table.items():
        rows = variants.policy_table(spark, policies)
        found = job(by_month, rows)
        scan = re.findall(r"PartitionFilters: \[[^\n]*close_month[^\n]*", plan_of(found))
        assert any("dynamicpruning" in line for line in scan)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, job(given, rows).collect()))
    for job, policies in ((slip.slip_sweep, registry.SLIP_SWEEP[:3]), (renewal.renewal_sweep, registry.RENEWAL_SWEEP[:1])):
        found = job(by_month, policies)
        assert re.search(r"PartitionFilters: \[[^\n]*close_month#\d+ IN \(2000-01-01|PartitionFilters: \[[^\n]*close_month#\d+ IN \(2000-02-01", plan_of(found))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, job(given, policies).collect()))
    catalog.drop(spark, ["opportunities_by_month"])


def plan_of(df) -> str:
    # The text of a plan cuts long lists of filters unless it is asked for at full length.
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
