"""Digests: order, ties, and splitting of heavy groups."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pipewright.functions.dates import month_window
from pipewright.plans import accelerate, customer360, notes
from pipewright.policy import AcceleratePolicy
from tests.small import dicts, tables


def us_date(d):
    return f"{d.month}/{d.day}/{d.year}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    # A third of all notes belongs to one opportunity, many of them on the same day or copies.
    for i in range(300):
        opp = "hot" if i % 3 == 0 else f"O{rng.randrange(40)}"
        out.append(
            {
                "note_id": f"N{i:04d}",
                "opp_id": opp,
                "note_at": date(2026, 1, 1) + timedelta(days=rng.randrange(5)),
                "note_type": rng.choice(["risk", "progress", "neutral"]),
                "note_text": rng.choice(["same text", f"text {rng.randrange(9)}", 'with "quotes"\nand line']),
                "tags": rng.choice([None, "a;b", "b", "risk"]),
            }
        )
    return out


def brute_force(rows):
    out = {}
    for opp in {r["opp_id"] for r in rows}:
        mine = [r for r in rows if r["opp_id"] == opp]
        lines = sorted((r["note_at"], f"{us_date(r['note_at'])}: {r['note_text']}") for r in mine)
        last = max(mine, key=lambda r: (r["note_at"], r["note_id"]))
        out[opp] = (last["note_type"], ";\n\n".join(line for _, line in lines))
    return out


def collected(df):
    """Digest per opportunity, its months put together in order."""
    months = {}
    for r in sorted(df.collect(), key=lambda r: r["notes_month"]):
        months.setdefault(r["opp_id"], []).append((r["last_signal"], r["opp_notes"]))
    assert all(len({s for s, _ in texts}) == 1 for texts in months.values())
    return {o: (texts[0][0], ";\n\n".join(t for _, t in texts)) for o, texts in months.items()}


def test_digest(spark, rows):
    df = notes.note_digest(tables(spark, opportunity_notes=rows))
    assert collected(df) == brute_force(rows)
    for r in df.collect():
        days = [line.split(": ")[0].split("/") for line in r["opp_notes"].split(";\n\n")]
        month = r["notes_month"]
        assert {(int(m), int(y)) for m, _, y in days} == {(month.month, month.year)}


def test_every_run_cuts_alike(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('O', id % 3) AS opp_id",
        "concat('N', id) AS note_id",
        "date_add(DATE'2026-01-01', cast(id % 200 as int)) AS note_at",
        "'risk' AS note_type",
        "concat('note ', hash(id)) AS note_text",
        "'' AS tags",
    )
    t = tables(spark).replaced(opportunity_notes=rows)
    first = sorted(notes.note_digest(t).collect())
    again = t.replaced(opportunity_notes=rows.repartition(13, "note_text"))
    assert first == sorted(notes.note_digest(again).collect())
    assert len(first) == 3 * 7 and sum(r["opp_notes"].count(";\n\n") + 1 for r in first) == 60_000


def test_no_job_runs_while_a_query_is_built(spark, rows):
    t = tables(spark, opportunity_notes=rows, customers=[{"customer_id": "C1"}])
    spark.sparkContext.setJobGroup("building", "")
    notes.note_digest(t)
    customer360.customer_360_opps(t)
    accelerate.accelerate(t, AcceleratePolicy(*month_window(2026, 2)))
    customer360.critical_ticket_actions(t)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_notes_meet_their_opportunity(spark, rows):
    opps = [{"opp_id": o} for o in ["silent", *{r["opp_id"] for r in rows}]]
    t = tables(
        spark,
        customers=[{"customer_id": "C1"}],
        sales_opportunities=opps,
        opportunity_notes=rows,
        sales_activities=[
            {"activity_id": f"A{i}", "opp_id": o["opp_id"], "type": "demo",
             "activity_at": date(2026, 1, 1)}
            for i, o in enumerate(opps)
        ],
    )
    expected = {o: text for o, (_, text) in brute_force(rows).items()} | {"silent": None}
    got = {}
    for r in sorted(customer360.customer_360_opps(t).collect(), key=lambda r: str(r["notes_month"])):
        got.setdefault(r["opp_id"], []).append(r["opp_notes"])
    assert {o: None if x == [None] else ";\n\n".join(x) for o, x in got.items()} == expected
    quiet = {o for o, (signal, _) in brute_force(rows).items() if signal != "risk"} | {"silent"}
    forward = accelerate.accelerate(t, AcceleratePolicy(*month_window(2026, 2)))
    assert {r["opp_id"] for r in forward.collect()} == quiet


def test_tie_on_the_last_day_is_decided_by_id(spark):
    day = date(2026, 3, 5)
    t = tables(
        spark,
        opportunity_notes=[
            {"note_id": "N55", "opp_id": "O", "note_at": day, "note_type": "progress"},
            {"note_id": "N54", "opp_id": "O", "note_at": day, "note_type": "neutral"},
        ],
    )
    assert notes.note_digest(t).collect()[0]["last_signal"] == "progress"


def test_tag_counts(spark):
    t = tables(
        spark,
        opportunity_notes=[
            {"note_id": "1", "opp_id": "O", "note_at": date(2026, 1, 1), "tags": "a;b"},
            {"note_id": "2", "opp_id": "O", "note_at": date(2026, 1, 1), "tags": "b"},
            {"note_id": "3", "opp_id": "O", "note_at": date(2026, 1, 1), "tags": None},
        ],
    )
    assert dicts(notes.tag_counts(t), "tag", "num_notes") == [("a", 1), ("b", 2)]


def test_accelerate_conditions(spark):
    def opp(name, **more):
        return {"opp_id": name, "expected_close_date": date(2026, 7, 1), **more}

    demo = {"activity_at": date(2026, 1, 1), "type": "demo"}
    t = tables(
        spark,
        customers=[{"customer_id": "C1"}],
        products=[{"product_id": "P1"}],
        sales_opportunities=[
            opp("good"), opp("risky"), opp("recovered"), opp("called only"),
            opp("won", status="Won"), opp("early", stage="Discovery"),
            opp("no forecast", is_forecast=False),
            opp("too soon", expected_close_date=date(2026, 6, 30)),
            opp("no customer", customer_id="?"), opp("no product", product_id="?"),
        ],
        sales_activities=[
            {"activity_id": f"A{i}", "opp_id": o, **demo}
            for i, o in enumerate(
                ["good", "good", "risky", "recovered", "won", "early", "no forecast", "too soon",
                 "no customer", "no product"]
            )
        ]
        + [{"activity_id": "B", "opp_id": "called only", "activity_at": date(2026, 1, 1)}],
        opportunity_notes=[
            {"note_id": "1", "opp_id": "risky", "note_at": date(2026, 1, 2), "note_type": "risk"},
            {"note_id": "2", "opp_id": "recovered", "note_at": date(2026, 1, 2), "note_type": "risk"},
            {"note_id": "3", "opp_id": "recovered", "note_at": date(2026, 1, 3), "note_type": "progress"},
        ],
    )
    window = month_window(2026, 7, 12)
    got = accelerate.accelerate(t, AcceleratePolicy(*window))
    assert dicts(got, "opp_id") == [("good",), ("no forecast",), ("no product",), ("recovered",)]
    got = accelerate.accelerate(t, AcceleratePolicy(*window, require_forecast=True, min_delivered=2))
    assert dicts(got, "opp_id") == [("good",)]


def test_month_window_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).select(F.lit(date(2026, 7, 1)).alias("d")).write.parquet(path)
    from pipewright.functions.dates import in_window

    plan = (
        spark.read.parquet(path)
        .where(in_window(F.col("d"), *month_window(2026, 7, 12)))
        ._jdf.queryExecution().toString()
    )
    assert "GreaterThanOrEqual(d,2026-07-01)" in plan and "LessThan(d,2027-01-01)" in plan
