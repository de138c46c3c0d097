from datetime import date

import pytest
from pyspark.sql import functions as F

from pipewright.plans import evaluate, truth
from pipewright.plans.truth import Seed
from pipewright.sources import literal
from tests.small import dicts, tables


def test_markdown(spark):
    df = spark.createDataFrame(
        [
            ("g", "Title", 2, 1.25, True, None, 'say "hi"\nnow | later'),
            ("g", "Title", 1, -3.0, None, date(2026, 1, 2), "a\tb   c"),
            ("h", "Other:", 3, None, False, None, None),
        ],
        "k string, t string, n int, x double, b boolean, d date, s string",
    )
    got = dict(dicts(truth.markdown_render(df, ["k"], ["n"], "t"), "k", "markdown"))
    head = "| n | x | b | d | s |\n|:-|:-|:-|:-|:-|\n"
    assert got == {
        "g": "Title:\n\n" + head + "| 1 | -3.00 | | 2026-01-02 | a b c |\n"
        '| 2 | 1.25 | True | | say \\"hi\\"<br>now \\| later |',
        "h": "Other:\n\n" + head + "| 3 | | False | | |",
    }


def test_tables_split_by_a_value(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id % 7 AS p", "id")
    whole = dict(dicts(truth.markdown_render(df, ["k"], ["p", "id"]), "k", "markdown"))
    parts = truth.markdown_render(df, ["k"], ["id"], parts=("p",)).collect()
    assert len(parts) == 14
    for k, text in whole.items():
        mine = [r["markdown"] for r in sorted(parts, key=lambda r: r["p"]) if r["k"] == k]
        assert [l for piece in mine for l in piece.split("\n")[2:]] == text.split("\n")[2:]


def test_every_line_break_stays_in_its_cell(spark):
    df = spark.createDataFrame([("g", 1, "a\r\nb\rc\nd")], "k string, n int, s string")
    (row,) = truth.markdown_render(df, ["k"], ["n"]).collect()
    assert row["markdown"].split("\n")[2:] == ["| 1 | a<br>b<br>c<br>d |"]


@pytest.fixture()
def five(spark):
    return tables(
        spark,
        customers=[{"customer_id": f"C{i}", "customer_name": f"Bank {i}"} for i in range(5)],
        products=[{"product_id": "P1"}],
    )


def test_ground_truth(spark, five):
    seeds = [
        Seed("  Who\tare  they? ", ("SELECT customer_id FROM {customers} WHERE customer_id < 'C2'",)),
        Seed("Both", ("SELECT product_id FROM {products}", "SELECT 1 AS x"), ("Products", None)),
        Seed("Nobody", ("SELECT customer_id FROM {customers} WHERE false",), ("None",)),
    ]
    views = {v.name for v in spark.catalog.listTables()}
    got = {r["question"]: r for r in truth.ground_truth(five, seeds).collect()}
    assert {r["part"] for r in got.values()} == {"all"}
    assert got["Who are they?"]["result"] == "| customer_id |\n|:-|\n| C0 |\n| C1 |"
    assert got["Both"]["sql"] == "SELECT product_id FROM products;\nSELECT 1 AS x"
    assert got["Both"]["result"] == (
        "Products:\n\n| product_id |\n|:-|\n| P1 |\n\n| x |\n|:-|\n| 1 |"
    )
    assert got["Nobody"]["result"] == "None:\n\n| customer_id |\n|:-|"
    assert {v.name for v in spark.catalog.listTables()} == views
    with pytest.raises(ValueError):
        truth.ground_truth(five, [Seed("q", ("SELECT 1", "SELECT 2"), ("one",))])


def test_answers_split_by_a_value_keep_every_row(spark, five):
    statement = "SELECT customer_id, right(customer_id, 1) % 2 AS odd FROM {customers}"
    got = {
        r["part"]: r["result"]
        for r in truth.ground_truth(five, [Seed("All", (statement,), part_by="odd")]).collect()
    }
    assert got == {
        "head": "| customer_id | odd |\n|:-|:-|",
        "0": "| C0 | 0 |\n| C2 | 0 |\n| C4 | 0 |",
        "1": "| C1 | 1 |\n| C3 | 1 |",
    }


def test_27_variants_of_three_seeds(spark):
    seeds = literal.literal_table(spark, [("seed_id", literal.TEXT)], [(s,) for s in "abc"])
    variants = literal.literal_table(
        spark,
        [("seed_id", literal.TEXT), ("kind", literal.TEXT), ("value", literal.TEXT)],
        [(s, k, f"{s} {k}") for s in "abc" for k in ("horizon", "product", "policy")],
    )
    phrasings = literal.literal_table(
        spark,
        [("seed_id", literal.TEXT), ("phrasing_no", literal.INT), ("template", literal.TEXT)],
        [(s, n, f"{n}: what about {{value}}?") for s in "abc" for n in (1, 2, 3)],
    )
    got = truth.question_variants(seeds, variants, phrasings)
    assert got.count() == 27
    assert ("b", "policy", "b policy", 3, "3: what about b policy?") in dicts(got, *got.columns)


def answers(spark, rows):
    return spark.createDataFrame(rows, "question string, a int, b double")


def test_scores(spark):
    ten = [("near", i, None) for i in range(10)]
    expected = answers(
        spark,
        [("same", 1, 1.0), ("same", 1, 1.0), ("same", 2, None), ("none", 1, 1.0), ("missing", 5, 5.0)]
        + ten + [("half", i, 0.0) for i in range(2)] + [("little", i, 0.0) for i in range(4)],
    )
    actual = answers(
        spark,
        [("same", 2, None), ("same", 1, 1.0), ("same", 1, 1.0), ("none", 2, 1.0), ("extra", 1, 1.0)]
        + ten[:8] + [("half", 0, 0.0)] + [("little", 0, 0.0), ("little", 0, 0.0)],
    )
    runs = expected.selectExpr("'truth' AS run", "*").union(actual.selectExpr("'one' AS run", "*"))
    runs = runs.union(expected.where("question = 'same'").selectExpr("'two' AS run", "*"))
    asked = ["extra", "half", "little", "missing", "near", "none", "same", "both empty"]
    questions = spark.createDataFrame([(q,) for q in asked], "question string")
    scores = evaluate.eval_scores(runs, questions, "question", "truth", ["one", "two"])
    one = scores.where("evaluation_id = 'one'")
    assert dicts(one, "question", "expected_rows", "actual_rows", "common_rows", "score") == [
        ("both empty", 0, 0, 0, 5),
        ("extra", 0, 1, 0, 1),
        ("half", 2, 1, 1, 3),
        ("little", 4, 2, 1, 2),
        ("missing", 1, 0, 0, 1),
        ("near", 10, 8, 8, 4),
        ("none", 1, 1, 0, 1),
        ("same", 3, 3, 3, 5),
    ]
    two = {r["question"]: r["score"] for r in scores.where("evaluation_id = 'two'").collect()}
    assert two == dict.fromkeys(asked, 1) | {"same": 5, "both empty": 5, "extra": 5}
    assert evaluate.eval_details(scores, "one").count() == 5
    assert evaluate.eval_details(scores, "one", all_rows=True).count() == 8
    assert evaluate.eval_details(scores).count() == 10
    summary = {r["evaluation_id"]: r for r in evaluate.eval_summary(scores).collect()}
    assert summary["one"]["mean_score"] == 2.75 and summary["one"]["score_1"] == 3
    assert summary["one"]["pass_rate"] == 0.375
    assert summary["two"]["num_questions"] == 8
