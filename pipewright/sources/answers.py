"""Tab-terminated files of questions and answers.

Records end with a tab instead of a line break, so Markdown answers keep their lines. Texts must be
free of tabs, which `clean_text` guarantees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "lineSep": "\t"}


def write_answers(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .options(**_OPTIONS)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_answers(
    spark: SparkSession, path: str, schema: str = "question string, sql string, result string"
) -> DataFrame:
    return (
        spark.read.options(**_OPTIONS)
        .option("mode", "FAILFAST")
        .option("maxCharsPerColumn", -1)
        .schema(schema)
        .csv(path)
    )


def evaluation_input(answers: DataFrame) -> DataFrame:
    """The two columns an evaluation run needs."""
    return answers.withColumnRenamed("result", "expected_answer").select(
        "question", "expected_answer"
    )
