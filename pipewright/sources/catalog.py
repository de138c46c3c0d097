"""Catalog tables: overwrite-and-register, append, and namespaced lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.tables import Tables

# The key most joins and aggregations of a table use. Tables bucketed on it meet without a shuffle.
BUCKET_KEYS = {
    "sales_opportunities": "opp_id",
    "sales_activities": "opp_id",
    "opportunity_notes": "opp_id",
    "support_tickets": "ticket_id",
    "support_activities": "ticket_id",
}


def save(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    path: str | None = None,
    partition_by: list[str] | None = None,
    buckets: int | None = None,
    bucket_key: str | None = None,
) -> None:
    """Write a frame and register it in the catalog. `fmt` may be `delta` where that source exists
    (which has no buckets)."""
    if buckets and bucket_key:
        # One file per bucket instead of one per task and bucket.
        df = df.repartition(buckets, bucket_key)
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets and bucket_key:
        writer = writer.bucketBy(buckets, bucket_key).sortBy(bucket_key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def save_run(df: DataFrame, name: str, run: str = "evaluation_id", path: str | None = None) -> None:
    """Write the rows of one or several runs to a results table that keeps runs apart.

    The table is partitioned by `run`, and only the partitions that the frame has rows for are
    replaced: a job that runs again leaves its run once, and all other runs as they were. The first
    call makes the table.
    """
    spark = df.sparkSession
    ordered = df.select(*[c for c in df.columns if c != run], run)
    if not spark.catalog.tableExists(name):
        save(ordered, name, path=path, partition_by=[run])
        return
    # Rows are matched to columns by position.
    columns = [f.name for f in spark.table(name).schema.fields]
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        ordered.select(*columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)


def save_by_month(opportunities: DataFrame, name: str, path: str | None = None) -> None:
    """Opportunities partitioned by the month they close in (`close_month`). Sweeps over policies
    then open the months that some policy asks for, found while they run."""
    by_month = opportunities.withColumn("close_month", F.trunc("expected_close_date", "MM"))
    # Rows of a month meet before they are written, so a month has a few files and not one a task.
    save(by_month.repartition("close_month"), name, path=path, partition_by=["close_month"])


def drop(spark: SparkSession, names: list[str], schema: str | None = None) -> None:
    """Take tables out of the catalog, and their schema if it is left empty."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if schema and spark.catalog.databaseExists(schema) and not spark.catalog.listTables(schema):
        spark.sql(f"DROP SCHEMA {schema}")


def save_all(
    spark: SparkSession,
    tables: Tables,
    schema: str = "dbo",
    fmt: str = "parquet",
    root: str | None = None,
    buckets: int | None = None,
) -> Tables:
    """Overwrite and register all eight tables below one schema, and return them as read back.

    With `buckets`, facts are bucketed by the key they are joined on, so later jobs aggregate and
    join them without shuffling. Leave it out for tables where one key holds much of the data.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, df in tables.items():
        save(
            df,
            f"{schema}.{name}",
            fmt,
            path=f"{root}/{name}" if root else None,
            buckets=buckets,
            bucket_key=BUCKET_KEYS.get(name),
        )
    return Tables.from_catalog(spark, schema)
