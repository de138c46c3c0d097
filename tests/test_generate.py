from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pipewright.plans import checks, distributions, generate
from pipewright.sources.schemas import SCHEMAS
from tests.small import tables

AS_OF = date(2026, 3, 8)


@pytest.fixture(scope="module")
def made(spark):
    t = generate.generate(spark.range(400), spark.range(8), AS_OF)
    return {name: df.cache() for name, df in t.items()}, t


@pytest.mark.parametrize("n", [3, 500])
def test_facts_fall_on_every_product(spark, n):
    t = generate.generate(spark.range(100), spark.range(n), AS_OF)
    for table in (t.support_tickets, t.sales_opportunities):
        used = {r["product_id"] for r in table.select("product_id").distinct().collect()}
        known = {r["product_id"] for r in t.products.collect()}
        assert used <= known
        assert len(used) == n if n == 3 else len(used) > 450
    assert checks.orphan_rows(t).count() == 0
    with pytest.raises(ValueError):
        generate.generate(spark.range(2), spark.range(0), AS_OF)


def test_declared_columns(made):
    for name, df in made[0].items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in SCHEMAS[name]
        ], name


def test_generated_data_keeps_the_rules(made):
    _, t = made
    assert checks.key_violations(t).count() == 0
    assert checks.orphan_rows(t).count() == 0
    assert checks.vocab_violations(t).count() == 0
    # Opportunities closed on a capped day are never before their opening.
    assert checks.range_violations(t).count() == 0


def test_sizes(made):
    tables, _ = made
    per_customer = tables["support_tickets"].groupBy("customer_id").count()
    low, high, mean = per_customer.agg(F.min("count"), F.max("count"), F.avg("count")).first()
    assert low >= 35 and high <= 65 and 48 < mean < 52
    per_customer = tables["sales_opportunities"].groupBy("customer_id").count()
    low, high, mean = per_customer.agg(F.min("count"), F.max("count"), F.avg("count")).first()
    assert low >= 10 and high <= 18 and 13 < mean < 15
    assert tables["csat_by_month"].count() == 400 * 12
    per_ticket = tables["support_activities"].count() / tables["support_tickets"].count()
    assert 2.4 < per_ticket < 2.6


def share(df, condition):
    return df.agg(F.avg(F.expr(condition).cast("int"))).first()[0]


def test_distributions(made):
    tables, _ = made
    tickets = tables["support_tickets"]
    assert abs(share(tickets, "status = 'Closed'") - 0.75) < 0.01
    for severity, weight in generate.SEVERITIES:
        assert abs(share(tickets, f"severity = '{severity}'") - weight / 100) < 0.01
    breached = tickets.where("severity IN ('High', 'Critical') AND status = 'Open'")
    assert abs(share(breached, "sla_breach_flag") - 0.3) < 0.06
    assert tickets.where("sla_breach_flag AND NOT (severity IN ('High', 'Critical'))").count() == 0
    trending = tickets.where("cast(substring(customer_id, 2) as int) % 5 = 3")
    usual = tickets.where("cast(substring(customer_id, 2) as int) % 5 <> 3")
    recent = f"opened_at >= DATE'{AS_OF - timedelta(days=120)}'"
    assert share(trending, recent) > 0.8 and share(usual, recent) < 0.55
    opps = tables["sales_opportunities"]
    assert opps.where("is_forecast <> (status = 'Open')").count() == 0
    assert opps.where("(renewal_term_months = 12) <> (type = 'Renewal')").count() == 0
    assert opps.where("forecast_category IS NULL AND status = 'Open'").count() == 0
    assert opps.where(f"expected_close_date > DATE'{AS_OF + timedelta(days=120)}'").count() == 0
    notes = tables["opportunity_notes"].count() / opps.where("status = 'Open'").count()
    assert abs(notes - 0.25) < 0.03
    assert share(tables["csat_by_month"], "csat BETWEEN 1 AND 5") == 1.0


def test_deals_closing_this_month_go_stale(made):
    tables, _ = made
    closing = tables["sales_opportunities"].where(
        "status = 'Open' AND expected_close_date BETWEEN DATE'2026-03-01' AND DATE'2026-03-28'"
    )
    joined = closing.join(tables["sales_activities"], "opp_id", "left")
    silent = joined.groupBy("opp_id").agg(F.count("activity_id").alias("n"))
    # half stale and two thirds of those silent, plus a sixth of the other half
    assert abs(share(silent, "n = 0") - (0.5 * 2 / 3 + 0.5 / 6)) < 0.1


def test_output_does_not_depend_on_partitioning(spark):
    ids, products = spark.range(30), spark.range(50)
    for name in ("support_tickets", "sales_opportunities", "sales_activities"):
        once = getattr(generate.generate(ids.repartition(1), products, AS_OF), name)
        again = getattr(generate.generate(ids.repartition(7), products.repartition(3), AS_OF), name)
        assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_forced_renewals_against_a_plain_loop(spark):
    """The running count of forced renewals, replayed in Python from the same draws."""
    import hashlib

    def digits(label, *keys):
        return hashlib.md5("|".join(map(str, (generate.SEED, label, *keys))).encode()).hexdigest()

    def slot(h, i):
        return int(h[4 * i: 4 * i + 4], 16)

    expected = {}
    for c in range(40):
        renewals = 0
        for n in range(1, 10 + slot(digits("opp count", c), 0) % 9 + 1):
            number = c * 18 + n - 1
            h = digits("opp", number)
            kind = ("Renewal", "Expansion", "Project")[slot(h, 1) % 3]
            if renewals < 2 and slot(digits("force renewal", c, n), 0) % 100 < 25:
                kind = "Renewal"
                renewals += 1
            elif kind == "Renewal" and renewals >= 2:
                kind = ("Expansion", "Project")[slot(h, 2) % 2]
            expected[f"O{5000 + number}"] = kind
    made = generate.generate(spark.range(40), spark.range(8), AS_OF).sales_opportunities
    assert {r["opp_id"]: r["type"] for r in made.collect()} == expected


def test_generated_values_follow_their_weights(made):
    _, t = made
    report = distributions.distribution_report(t).collect()
    assert {(r.table_name, r.column_name) for r in report} == set(distributions.DECLARED)
    assert all(r.fits and r.num_undeclared == 0 and r.num_rows > 1000 for r in report)
    # Statistics are about as large as their degrees of freedom say.
    assert sum(r.chi_square for r in report) < 2 * sum(r.degrees_of_freedom for r in report)


def test_a_skewed_generator_does_not(spark, made):
    _, t = made
    tickets = t.support_tickets.withColumn(
        "severity", F.when(F.col("ticket_id").endswith("7") & (F.col("severity") == "Low"), "High").otherwise(F.col("severity"))
    ).withColumn("channel", F.when(F.col("channel") == "Fax", None).otherwise(F.lit("Phone")))
    acts = t.sales_activities.withColumn("contact_name", F.when(F.col("activity_id").endswith("01"), "nobody").otherwise(F.col("contact_name")))
    report = {
        r.column_name: r
        for r in distributions.distribution_report(t.replaced(support_tickets=tickets, sales_activities=acts)).collect()
        if r.table_name in ("support_tickets", "sales_activities")
    }
    assert {c: r.fits for c, r in report.items()} == {
        "severity": False, "status": True, "channel": False, "assigned_group": True, "contact_name": False,
    }
    # All rows on one of three equal values: twice their number, but for the odd slot.
    channel = report["channel"]
    assert abs(channel.chi_square / channel.num_rows - 2) < 1e-3
    assert report["contact_name"].num_undeclared == acts.where("contact_name = 'nobody'").count() > 0


def test_empty_tables_say_nothing_against_their_weights(spark):
    report = distributions.distribution_report(tables(spark)).collect()
    assert len(report) == len(distributions.DECLARED)
    assert all((r.num_rows, r.chi_square, r.fits) == (0, 0.0, True) for r in report)


def test_limits_of_chi_square():
    # Upper 0.1 % and 5 % points from a table.
    for degrees, confidence, want in ((1, 0.999, 10.83), (3, 0.999, 16.27), (5, 0.999, 20.52), (5, 0.95, 11.07)):
        assert abs(distributions.chi_square_limit(degrees, confidence) / want - 1) < 0.035
