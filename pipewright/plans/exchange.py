"""Counts and round trips through exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.functions.text import row_fingerprint
from pipewright.operators.lookups import stacked
from pipewright.sources import tsv
from pipewright.sources.answers import read_answers, write_answers
from pipewright.sources.scratch import scratch_path
from pipewright.tables import Tables


def table_counts(t: Tables) -> DataFrame:
    """Rows per table."""
    return stacked(
        [
            df.agg(F.count("*").alias("num_rows")).select(
                F.lit(name).alias("table_name"), "num_rows"
            )
            for name, df in t.items()
        ]
    )


def difference(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Compare two frames as multisets: (num_source, num_copy, num_different).

    Rows are told apart by a 128-bit fingerprint, so only that is shuffled. NULLs are part of it: a
    value that silently became NULL is found.
    """
    columns = source.columns

    def side(df: DataFrame, s: int, c: int) -> DataFrame:
        return df.select(
            *row_fingerprint(columns), F.lit(s).alias("_s"), F.lit(c).alias("_c")
        )

    return (
        side(source, 1, 0)
        .unionByName(side(copy, 0, 1))
        .groupBy("_high", "_low")
        .agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        .agg(
            F.coalesce(F.sum("_s"), F.lit(0)).alias("num_source"),
            F.coalesce(F.sum("_c"), F.lit(0)).alias("num_copy"),
            F.coalesce(F.sum(F.abs(F.col("_s") - F.col("_c"))), F.lit(0)).alias("num_different"),
        )
    )


def differences(t: Tables, copy: Tables) -> DataFrame:
    """`difference` of every table and its copy."""
    return stacked(
        [
            difference(df, getattr(copy, name)).select(F.lit(name).alias("table_name"), "*")
            for name, df in t.items()
        ]
    )


def tsv_roundtrip(spark: SparkSession, t: Tables, root: str | None = None) -> DataFrame:
    """Export all tables, read them back with their types and compare."""
    root = root or scratch_path(spark, "tsv")
    tsv.export(t, root)
    # Texts may hold line breaks; the export writes a file for each of its tasks.
    schemas = {name: df.schema for name, df in t.items()}
    copy = tsv.load(spark, root, schemas, multi_line=True)
    return differences(t, copy)


def answers_roundtrip(spark: SparkSession, answers: DataFrame, root: str | None = None) -> DataFrame:
    """Write answers as tab-terminated records, read them back and compare."""
    root = root or scratch_path(spark, "answers")
    write_answers(answers, root)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)
    return difference(answers, read_answers(spark, root, schema))
