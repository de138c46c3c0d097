"""Tab-separated exchange files, one folder per table.

The files carry a header, ISO dates, `True`/`False` flags and empty fields for NULL. An empty text
therefore reads back as NULL. Quotes inside a field are doubled, and a quoted field may hold tabs
and line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.sources.schemas import SCHEMAS
from pipewright.tables import Tables

_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd"}


def _lenient(schema: T.StructType) -> T.StructType:
    # Whole numbers in nullable columns may be written as 12.0, which an integer reader turns into
    # NULL without an error; read them as doubles and narrow afterwards.
    return T.StructType(
        [
            T.StructField(f.name, T.DoubleType() if f.dataType == T.IntegerType() else f.dataType)
            for f in schema.fields
        ]
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Read one table with its declared types.

    Spark splits a large file between tasks. `multi_line=True` is for files with line breaks inside
    fields; each of those is read by one task. Malformed records fail the job instead of turning into NULLs.
    """
    raw = (
        spark.read.options(**_OPTIONS)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .schema(_lenient(schema))
        .csv(path)
    )
    return raw.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _printed(field: T.StructField) -> Column:
    """A field as it stood in the file: flags as `True` and `False`, and whole numbers, which are
    read as doubles, without a fraction."""
    col = F.col(f"`{field.name}`")
    if field.dataType == T.BooleanType():
        return F.initcap(col.cast("string"))
    if field.dataType == T.IntegerType():
        return F.when(col == F.floor(col), col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


# Why a record is not loaded.
WRONG_WIDTH, MALFORMED = "wrong number of fields", "malformed record"


def read_with_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = False,
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One table with its declared types, and the records that are not fit for it:
    (rows, rejects(file, record, reason)).

    Every record is in exactly one of both. A record is rejected if it has not as many fields as the
    schema, if a field is not of its type, if an integer has a fraction, or if a column that must
    have a value has none; `reason` names the first such column. Both frames read the files by
    themselves, and nothing is shuffled.
    """
    lenient = _lenient(schema)
    raw = (
        spark.read.options(**{**_OPTIONS, "header": str(header).lower()})
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_record")
        # A record is looked at as a whole, whatever columns a job needs of it.
        .option("columnPruning", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .schema(T.StructType([*[T.StructField(f.name, f.dataType) for f in lenient], T.StructField("_record", T.StringType())]))
        .csv(path)
    )
    # The parser keeps the text of broken records only; of all others, the fields are printed again.
    printed = F.concat_ws("\t", *[F.coalesce(_printed(f), F.lit("")) for f in schema])
    fields = F.split("_record", "\t")
    reasons = []
    for i, f in enumerate(schema.fields):
        col = F.col(f"`{f.name}`")
        given = F.coalesce(F.get(fields, F.lit(i)), F.lit("")) != ""
        broken = F.col("_record").isNotNull() & col.isNull() & given
        reasons.append(F.when(broken, F.lit(f"no {f.dataType.simpleString()} in {f.name}")))
        if f.dataType == T.IntegerType():
            reasons.append(F.when(col != F.floor(col), F.lit(f"fraction in {f.name}")))
        if not f.nullable:
            reasons.append(F.when(col.isNull(), F.lit(f"no value in {f.name}")))
    width = F.when(F.col("_record").isNotNull() & (F.size(fields) != len(schema)), F.lit(WRONG_WIDTH))
    other = F.when(F.col("_record").isNotNull(), F.lit(MALFORMED))
    judged = raw.withColumn("_reason", F.coalesce(width, *reasons, other))
    good = judged.where("_reason IS NULL").select(
        [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    rejects = judged.where("_reason IS NOT NULL").select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce("_record", printed).alias("record"),
        F.col("_reason").alias("reason"),
    )
    return good, rejects


def write_table(df: DataFrame, path: str) -> None:
    """Write one table from all its partitions at once."""
    (
        df.write.mode("overwrite")
        .options(**_OPTIONS)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export(tables: Tables, root: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}.csv")


def load(
    spark: SparkSession,
    root: str,
    schemas: dict[str, T.StructType] | None = None,
    multi_line: bool = False,
) -> Tables:
    """Read all tables of a folder, each from `<root>/<table>.csv` (a file or a folder of parts)."""
    schemas = schemas or SCHEMAS
    return Tables(
        spark,
        {
            n: lambda n=n: read_table(spark, f"{root}/{n}.csv", schemas[n], multi_line)
            for n in Tables.names()
        },
    )
