"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.sources.scratch import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILE_ROWS = 200_000  # of a narrow table on its way
BATCH_BYTES = 16 << 20  # of one Arrow batch, so that long texts do not pile up in a Python worker
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BITS, MOST_BITS = 16, 1 << 28  # of a filter: for each key, and in all (32 MB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns of these names in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def hashable(df: DataFrame) -> list:
    """The columns that a hash of a whole row takes in: all without a map inside."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()
            and "variant" not in f.dataType.simpleString()]


def ascii_lower(text):
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def written(df: DataFrame, label: str, rows: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """The frame written to the shared folder and read again: a cut in the lineage that survives
    lost executors. `rows`, where known, bounds the number of files, each of up to FILE_ROWS. The
    shuffle files of the write go with it. `paths` gets its path, for a caller who removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if paths is not None:
        paths.append(path)
    if rows is not None:
        df = df.coalesce(max(4, ceil(rows / FILE_ROWS)))
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run meanwhile are removed at the end of each, and do not wait
    for the driver to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class KeyFilter:
    """Tells rows whose 64-bit hash is surely not among some keys: BITS bits for each key, of which a
    hash has one. Beyond MOST_BITS more rows pass; no row with one of the keys is ever told apart."""

    def __init__(self, keys: DataFrame, n: int, key: str):
        """`n` keys, about, in the column `key`. The bits are joined by broadcast."""
        self.bits = min(MOST_BITS, 1 << max(15, (BITS * n).bit_length()))
        at = self._place(F.col(key)) + 1
        self.table = F.broadcast(
            written(
                keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(
                    F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")
                ),
                "filter",
                n,
            )
        )

    def _place(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit(self.bits - 1))

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows that may have one of the keys, and those that have none."""
        place = self._place(F.coalesce(key, F.lit(0)))
        at = rows.withColumn("__place", place).withColumn("__bucket", F.expr("__place div 32768 + 1"))
        bit = F.expr("getbit(int(conv(hex(substring(__bits, int(__place % 32768 div 8) + 1, 1)), 16, 10)), int(__place % 8))")
        met = at.join(self.table, "__bucket", "left").withColumn("__met", F.coalesce(bit, F.lit(0)) == 1)
        return tuple(met.where(c).select(*[F.col(f"`{n}`") for n in rows.columns]) for c in ("__met", "not __met"))


def append_columns(
    df: DataFrame,
    added: T.StructType,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
) -> DataFrame:
    """Every row with further columns, by a function over Arrow batches; nothing is shuffled."""
    names = [f.name for f in added]
    rows = without(df, names)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    kept = list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in work(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *names])

    bound_batches(df.sparkSession)
    return rows.mapInArrow(run, schema)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
