"""Scoring answers against the ground truth, row by row instead of by opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.functions.text import row_fingerprint

# Rubric from 1 (different data) to 5 (the same data), by share of common rows.
RUBRIC = ((5, 1.0), (4, 0.8), (3, 0.5))
PASS_SCORE = 4


def eval_scores(
    answers: DataFrame, questions: DataFrame, question: str, expected: str, runs: list[str]
) -> DataFrame:
    """Score per run and question: how far the multisets of expected and actual rows agree.

    `answers` holds the answer rows of all runs, told apart by the column `run`; the rows of the run
    `expected` are the truth for each of `runs`. `questions` lists what was asked, so a question
    with empty answers on both sides counts as well: it scores 5. Rows are shuffled as 128-bit
    fingerprints, once for all runs, and counted per side.
    """
    columns = [c for c in answers.columns if c != "run"]

    def side(name: Column, e: int, a: int) -> Column:
        return F.struct(name.alias("evaluation_id"), F.lit(e).alias("_e"), F.lit(a).alias("_a"))

    sides = F.when(
        F.col("run") == expected, F.array(*[side(F.lit(r), 1, 0) for r in runs])
    ).otherwise(F.array(side(F.col("run"), 0, 1)))
    totals = (
        answers.select(question, *row_fingerprint(columns), F.explode(sides).alias("_side"))
        .select(question, "_high", "_low", "_side.*")
        .groupBy("evaluation_id", question, "_high", "_low")
        .agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
        .groupBy("evaluation_id", question)
        .agg(
            F.sum("_e").alias("expected_rows"),
            F.sum("_a").alias("actual_rows"),
            F.sum(F.least("_e", "_a")).alias("common_rows"),
            F.sum(F.greatest("_e", "_a")).alias("all_rows"),
        )
    )
    asked = (
        questions.select(question)
        .distinct()
        .select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("evaluation_id"), question)
    )
    counts = ["expected_rows", "actual_rows", "common_rows", "all_rows"]
    scored = asked.join(totals, ["evaluation_id", question], "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    )
    overlap = F.when(F.col("all_rows") == 0, 1.0).otherwise(F.col("common_rows") / F.col("all_rows"))
    score = F.when(overlap == 0, 1).otherwise(2)
    for points, share in reversed(RUBRIC):
        score = F.when(overlap >= share, points).otherwise(score)
    return scored.select("evaluation_id", question, *counts, score.alias("score")).withColumn(
        "passed", F.col("score") >= PASS_SCORE
    )


# Rubric by cells. Four and five ask for equal values, three and two for rows that name
# the same things.
SAME_CELLS = ((5, 1.0), (4, 0.8))
SAME_ROWS = 0.5


def _same_cell(e: Column, a: Column, kind: T.DataType, tolerance: float) -> Column:
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        # Rounding decides what a difference of exactly the tolerance is, not the last bit of it.
        near = F.round(F.abs(e.cast("double") - a.cast("double")), 9) <= tolerance
        return e.eqNullSafe(a) | F.coalesce(near, F.lit(False))
    return e.eqNullSafe(a)


def cell_scores(
    answers: DataFrame,
    questions: DataFrame,
    question: str,
    keys: list[str],
    expected: str,
    runs: list[str],
    tolerance: float = 0.005,
) -> DataFrame:
    """Score per run and question, cell by cell: rows are aligned by `keys`, and every other column
    is a cell.

    Fractional numbers agree up to `tolerance`, everything else if it is equal; NULL agrees with
    NULL. Rows that repeat a key are aligned in the order of their cells. A row counts as one cell
    for its key besides its values, so a missing or extra row is all of its cells.

    Equal values throughout score 5, from 80 % of all cells 4. Below that, what counts is whether
    both sides speak of the same things: from half of the rows in common 3 (compatible, but
    different), any row 2, none 1. Rows of all runs are shuffled once, by their key.
    """
    kinds = {f.name: f.dataType for f in answers.schema.fields}
    cells = [c for c in answers.columns if c not in {"run", question, *keys}]
    side = F.when(F.col("run") == expected, 1).otherwise(0)
    to = F.when(F.col("run") == expected, F.array(*[F.lit(r) for r in runs])).otherwise(
        F.array(F.col("run"))
    )
    met = answers.select(
        F.explode(to).alias("evaluation_id"),
        question,
        *keys,
        side.alias("_side"),
        F.struct(F.lit(0).alias("_row"), *cells).alias("_cells"),
    ).where(F.col("evaluation_id").isin(runs))
    key = ["evaluation_id", question, *keys]
    nth = F.row_number().over(Window.partitionBy(*key, "_side").orderBy("_cells"))
    # Numbering repeats and aligning both sides use the same partitioning by key.
    aligned = (
        met.repartition(*key)
        .withColumn("_nth", nth)
        .groupBy(*key, "_nth")
        .agg(
            F.max(F.when(F.col("_side") == 1, F.col("_cells"))).alias("_e"),
            F.max(F.when(F.col("_side") == 0, F.col("_cells"))).alias("_a"),
        )
    )
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    same = sum(
        (
            F.when(_same_cell(F.col(f"_e.{c}"), F.col(f"_a.{c}"), kinds[c], tolerance), 1).otherwise(0)
            for c in cells
        ),
        F.lit(1),
    )
    totals = aligned.groupBy("evaluation_id", question).agg(
        F.count("_e").alias("expected_rows"),
        F.count("_a").alias("actual_rows"),
        F.count_if(both).alias("matched_rows"),
        F.sum(F.when(both, same).otherwise(0)).cast("bigint").alias("same_cells"),
    )
    asked = (
        questions.select(question)
        .distinct()
        .select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("evaluation_id"), question)
    )
    counts = ["expected_rows", "actual_rows", "matched_rows", "same_cells"]
    scored = asked.join(totals, ["evaluation_id", question], "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    )
    scored = scored.withColumns(
        {
            "missing_rows": F.col("expected_rows") - F.col("matched_rows"),
            "extra_rows": F.col("actual_rows") - F.col("matched_rows"),
        }
    )
    rows = F.col("matched_rows") + F.col("missing_rows") + F.col("extra_rows")
    width = len(cells) + 1
    scored = scored.withColumns(
        {
            "differing_cells": F.col("matched_rows") * width - F.col("same_cells"),
            "all_cells": rows * width,
        }
    )
    agreement = F.when(F.col("all_cells") == 0, 1.0).otherwise(F.col("same_cells") / F.col("all_cells"))
    score = F.when(F.col("matched_rows") >= SAME_ROWS * rows, 3).when(F.col("matched_rows") > 0, 2).otherwise(1)
    for points, share in reversed(SAME_CELLS):
        score = F.when(agreement >= share, points).otherwise(score)
    return scored.select(
        "evaluation_id",
        question,
        "expected_rows",
        "actual_rows",
        "matched_rows",
        "missing_rows",
        "extra_rows",
        "same_cells",
        "differing_cells",
        "all_cells",
        score.alias("score"),
    ).withColumn("passed", F.col("score") >= PASS_SCORE)


def answer_lines(answers: DataFrame, run: str) -> DataFrame:
    """Markdown answers (question, answer) as rows of a run: their lines."""
    return answers.select(
        F.lit(run).alias("run"), "question", F.explode(F.split("answer", "\n")).alias("line")
    ).where("line <> ''")


def eval_details(
    results: DataFrame, evaluation_id: str | None = None, all_rows: bool = False
) -> DataFrame:
    """Rows of a results table: everything or failures only, for one run or all runs."""
    if evaluation_id is not None:
        results = results.where(F.col("evaluation_id") == evaluation_id)
    return results if all_rows else results.where(~F.col("passed"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Per run: questions, mean score, pass rate and questions per score."""
    return results.groupBy("evaluation_id").agg(
        F.count("*").alias("num_questions"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"),
        *[F.count_if(F.col("score") == s).alias(f"score_{s}") for s in range(1, 6)],
    )
