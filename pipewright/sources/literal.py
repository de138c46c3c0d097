"""Small tables given as rows in the program: policies, vocabularies, dimensions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TEXT, INT, BIGINT, DOUBLE, BOOL, DAY = (
    pa.string(),
    pa.int32(),
    pa.int64(),
    pa.float64(),
    pa.bool_(),
    pa.date32(),
)


def literal_table(
    spark: SparkSession, columns: list[tuple[str, pa.DataType]], rows: list[tuple]
) -> DataFrame:
    """A frame of literal rows with declared types.

    Handed over in Arrow form the rows become part of the plan, so Spark knows their exact size and
    broadcasts them in joins without a hint.
    """
    arrays = [pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in columns]))
