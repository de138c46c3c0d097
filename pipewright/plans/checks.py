"""Rules of the model, checked on whole tables. An empty report means the data keeps the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.functions.text import vocabulary_form
from pipewright.operators.lookups import stacked
from pipewright.sources.literal import TEXT, literal_table
from pipewright.sources.schemas import KEYS, SCHEMAS
from pipewright.tables import Tables

# Controlled vocabularies, compared without case, blanks and underscores.
VOCABULARIES = {
    ("sales_opportunities", "status"): ("Open", "Won", "Lost"),
    ("sales_opportunities", "type"): ("New", "Expansion", "Project", "Renewal"),
    ("sales_opportunities", "stage"): (
        "Qualification", "Discovery", "Proposal", "Negotiation", "Procurement",
    ),
    ("sales_opportunities", "forecast_category"): ("Pipeline", "BestCase", "Commit"),
    ("support_tickets", "status"): ("Open", "Closed"),
    ("support_tickets", "severity"): ("Low", "Medium", "High", "Critical"),
    ("support_tickets", "priority"): ("P1", "P2", "P3", "P4"),
    ("opportunity_notes", "note_type"): ("neutral", "progress", "risk"),
}

# Which column refers to which table.
REFERENCES = (
    ("sales_opportunities", "customer_id", "customers"),
    ("sales_opportunities", "product_id", "products"),
    ("sales_activities", "opp_id", "sales_opportunities"),
    ("opportunity_notes", "opp_id", "sales_opportunities"),
    ("support_tickets", "customer_id", "customers"),
    ("support_tickets", "product_id", "products"),
    ("support_activities", "ticket_id", "support_tickets"),
)


def vocab_violations(t: Tables) -> DataFrame:
    """Values outside their vocabulary, with the number of rows that hold them."""
    by_table: dict[str, list[str]] = {}
    for table, column in VOCABULARIES:
        by_table.setdefault(table, []).append(column)
    # One scan per table covers all its columns; counts are combined on the map side.
    used = stacked(
        [
            getattr(t, table)
            .select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                            for c in columns
                        ]
                    )
                ).alias("v")
            )
            .select(F.lit(table).alias("table_name"), "v.column_name", "v.value")
            for table, columns in by_table.items()
        ]
    )
    counts = (
        used.where(F.col("value").isNotNull())
        .groupBy("table_name", "column_name", "value")
        .agg(F.count("*").alias("num_rows"))
        .withColumn("form", vocabulary_form(F.col("value")))
    )
    allowed = literal_table(
        t.spark,
        [("table_name", TEXT), ("column_name", TEXT), ("allowed", TEXT)],
        [(tb, c, v) for (tb, c), values in VOCABULARIES.items() for v in values],
    ).select("table_name", "column_name", vocabulary_form(F.col("allowed")).alias("form"))
    return counts.join(allowed, ["table_name", "column_name", "form"], "left_anti").select(
        "table_name", "column_name", "value", "num_rows"
    )


def orphan_rows(t: Tables) -> DataFrame:
    """References to rows that do not exist, with the number of rows that hold them."""
    # Keys keep their own types until the report, and one pruned scan reads one column. A parent's
    # ids and all references to it meet in one aggregate, a row per id: counts are combined on the
    # map side, so a busy id stays small, nothing is sorted, and no table is held to look ids up.
    by_parent: dict[str, list[tuple[str, str]]] = {}
    for table, column, parent in REFERENCES:
        by_parent.setdefault(parent, []).append((table, column))
    reports = []
    for parent, references in by_parent.items():
        known = getattr(t, parent).select(
            F.col(KEYS[parent][0]).alias("missing_id"), F.lit(-1).alias("_held_by")
        )
        held = [
            getattr(t, table)
            .where(F.col(column).isNotNull())
            .select(F.col(column).alias("missing_id"), F.lit(i).alias("_held_by"))
            for i, (table, column) in enumerate(references)
        ]
        missing = (
            stacked([known, *held])
            .groupBy("missing_id")
            .agg(
                F.min("_held_by").alias("_least"),
                *[F.count_if(F.col("_held_by") == i).alias(f"_{i}") for i in range(len(references))],
            )
            .where(F.col("_least") >= 0)
        )
        found = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.col("missing_id").cast("string").alias("missing_id"),
                F.col(f"_{i}").alias("num_rows"),
            )
            for i, (table, column) in enumerate(references)
        ]
        reports.append(missing.select(F.inline(F.array(*found))).where(F.col("num_rows") > 0))
    return stacked(reports)


def key_violations(t: Tables) -> DataFrame:
    """NULLs in columns that must have a value, and identifiers used more than once.

    `num_rows` counts the NULL rows, or the rows beyond the first of every repeated identifier. Each
    table is read once: rows are reduced to one per identifier, and those to one per table.
    """
    reports = []
    for name, df in t.items():
        required = [f.name for f in SCHEMAS[name].fields if not f.nullable]
        key = ",".join(KEYS[name])
        per_key = df.groupBy(*KEYS[name]).agg(
            F.count("*").alias("_rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(required)],
        )
        found = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit("null").alias("rule"),
                F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias("num_rows"),
            )
            for i, c in enumerate(required)
        ]
        found.append(
            F.struct(
                F.lit(key).alias("column_name"),
                F.lit("duplicate").alias("rule"),
                F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("num_rows"),
            )
        )
        reports.append(
            per_key.agg(F.array(*found).alias("found")).select(
                F.lit(name).alias("table_name"), F.inline("found")
            )
        )
    return stacked(reports).where(F.col("num_rows") > 0)


def _broken(df: DataFrame, table: str, row_id: Column, rules: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return df.select(
        F.lit(table).alias("table_name"),
        row_id.cast("string").alias("row_id"),
        F.explode(names).alias("rule"),
    )


def range_violations(t: Tables) -> DataFrame:
    """Rows with a score outside 1..5, closed before they opened, or closed while still open."""
    lifecycle = {
        "closed before opened": F.col("closed_at") < F.col("opened_at"),
        "closed day and status disagree": F.col("closed_at").isNull() != (F.col("status") == "Open"),
    }
    return stacked(
        [
            _broken(
                t.csat_by_month,
                "csat_by_month",
                F.concat_ws("@", F.col("customer_id").cast("string"), F.col("month").cast("string")),
                {"csat outside 1..5": ~F.col("csat").between(1, 5)},
            ),
            _broken(t.support_tickets, "support_tickets", F.col("ticket_id"), lifecycle),
            _broken(t.sales_opportunities, "sales_opportunities", F.col("opp_id"), lifecycle),
        ]
    )
