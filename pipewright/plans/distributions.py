"""Whether generated values follow the weights that their generator declares."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.functions.draws import SLOTS
from pipewright.operators.lookups import stacked
from pipewright.plans import generate
from pipewright.sources.literal import DOUBLE, INT, TEXT, literal_table
from pipewright.tables import Tables

CONFIDENCE = 0.999


def even(values: tuple) -> dict[str, float]:
    """Weights of values that are drawn with equal chances, as the 2^16 draws deal them out."""
    return {str(v): SLOTS // len(values) + (i < SLOTS % len(values)) for i, v in enumerate(values)}


def percents(weighted: tuple[tuple[str, int], ...]) -> dict[str, float]:
    """Weights of values that are drawn by percents."""
    out, upper = {}, 0
    for value, weight in weighted:
        low, upper = upper, upper + weight
        out[value] = sum(low <= s % 100 < upper for s in range(SLOTS))
    return out


# Columns whose values are drawn for each row by itself, and the weights they are
# drawn with. NULL is no value: a forecast category is drawn for open opportunities only.
DECLARED = {
    ("support_tickets", "severity"): percents(generate.SEVERITIES),
    ("support_tickets", "status"): percents((("Closed", 75), ("Open", 25))),
    ("support_tickets", "channel"): even(generate.CHANNELS),
    ("support_tickets", "assigned_group"): even(generate.GROUPS),
    ("support_activities", "description"): even(generate.SUPPORT_STEPS),
    ("support_activities", "author"): even(generate.AUTHORS),
    ("support_activities", "activity_type"): even(generate.SUPPORT_TYPES),
    ("sales_opportunities", "status"): even(generate.OPP_STATUSES),
    ("sales_opportunities", "stage"): even(generate.STAGES),
    ("sales_opportunities", "forecast_category"): even(generate.CATEGORIES),
    ("sales_opportunities", "amount"): even(generate.AMOUNTS),
    ("sales_activities", "contact_name"): even(generate.CONTACTS),
}


def chi_square_limit(degrees: int, confidence: float = CONFIDENCE) -> float:
    """What a chi-square statistic stays below with this probability (Wilson and Hilferty)."""
    z, part = NormalDist().inv_cdf(confidence), 2 / (9 * degrees)
    return degrees * (1 - part + z * part**0.5) ** 3


def distribution_report(
    t: Tables, declared: dict[tuple[str, str], dict[str, float]] = DECLARED, confidence: float = CONFIDENCE
) -> DataFrame:
    """Per column: rows with a value, rows with an undeclared value, Pearson's chi-square statistic
    of the others against their declared weights, degrees of freedom, and whether both fit.

    Rows are reduced to one per column and value on the map side, all columns of a table in one
    scan; nothing else is shuffled. A declared value that no row has counts with its expected rows.
    A column without values fits: it says nothing against its weights.
    """
    by_table: dict[str, list[str]] = {}
    for table, column in declared:
        by_table.setdefault(table, []).append(column)
    counts = stacked(
        [
            getattr(t, table)
            .select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(table).alias("table_name"),
                                F.lit(c).alias("column_name"),
                                F.col(c).cast("string").alias("value"),
                            )
                            for c in columns
                        ]
                    )
                )
            )
            .where("value IS NOT NULL")
            .groupBy("table_name", "column_name", "value")
            .agg(F.count("*").alias("num_rows"))
            for table, columns in by_table.items()
        ]
    )
    shares = literal_table(
        t.spark,
        [("table_name", TEXT), ("column_name", TEXT), ("value", TEXT), ("share", DOUBLE)],
        [
            (table, column, value, weight / sum(weights.values()))
            for (table, column), weights in declared.items()
            for value, weight in weights.items()
        ],
    )
    limits = literal_table(
        t.spark,
        [("table_name", TEXT), ("column_name", TEXT), ("degrees_of_freedom", INT), ("limit", DOUBLE)],
        [
            (table, column, len(weights) - 1, chi_square_limit(len(weights) - 1, confidence))
            for (table, column), weights in declared.items()
        ],
    )
    column = ["table_name", "column_name"]
    # Declared values and counted ones as one list: a value may be missing on either side.
    seen = (
        counts.withColumn("share", F.lit(None).cast("double"))
        .unionByName(shares.withColumn("num_rows", F.lit(0).cast("bigint")))
        .groupBy(*column, "value")
        .agg(F.sum("num_rows").alias("num_rows"), F.max("share").alias("share"))
    )
    # The sum of (seen - expected)^2 / expected over declared values, where expected = share * n,
    # is the sum of seen^2 / share over n, less n.
    known = F.col("share").isNotNull()
    n = F.sum(F.when(known, F.col("num_rows")).otherwise(0))
    squares = F.sum(F.when(known, F.col("num_rows") * F.col("num_rows") / F.col("share")))
    report = seen.groupBy(*column).agg(
        F.sum("num_rows").alias("num_rows"),
        F.sum(F.when(~known, F.col("num_rows")).otherwise(0)).alias("num_undeclared"),
        F.round(F.when(n > 0, squares / n - n).otherwise(0.0), 4).alias("chi_square"),
    )
    fits = (F.col("num_undeclared") == 0) & (F.col("chi_square") <= F.col("limit"))
    return report.join(limits, column).select(
        *column, "num_rows", "num_undeclared", "chi_square", "degrees_of_freedom", fits.alias("fits")
    )
