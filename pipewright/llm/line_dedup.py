"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import ascii_lower, without, written

WHITE = " \t\n\x0b\x0c\r"


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(key):
    """128 bits of a key as two hashes with different seeds; equal keys are all that may be equal."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """All rows with `kept` (the text without repeated lines), `n_lines` (before) and `n_dropped`.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    `min_chars` code points that at least `min_docs` distinct ids hold are dropped, every copy of
    them, everywhere but in the largest such id. Other lines stay in their order.

    Lines become (hash, id) rows, distinct ids are counted per hash in two map-side combined steps,
    and what is to go meets its texts by id; no group of equal lines is ever gathered.

    A null or empty text is one empty line. Rows with a null id count for no line and lose none.
    Rows that share an id count as one document, and each loses the lines that this id loses. Input
    columns named like the three new ones are replaced; all others are carried along.
    """
    rows = without(docs, ["kept", "n_lines", "n_dropped"])
    lines = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.explode(F.split(text_col, "\n", -1)).alias("line")
    )
    keyed = lines.select("id", _key(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    held = written(keyed.select("id", _hashes(F.col("key")).alias("hash")).distinct(), "lines")
    shared = written(
        held.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("hash", "keeper"),
        "shared-lines",
    )
    lost = (
        held.join(shared, "hash")
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id")
        .agg(F.collect_list("hash").alias("__lost"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.split(text, "\n", -1)
    kept = F.filter(split, lambda line: ~F.array_contains("__lost", _hashes(_key(line))))
    return (
        rows.join(lost.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left")
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("__kept", F.when(F.col("__lost").isNotNull(), kept))
        .withColumn("kept", F.coalesce(F.array_join("__kept", "\n"), text))
        .withColumn(
            "n_dropped",
            F.when(F.col("__kept").isNull(), F.lit(0))
            .otherwise(F.col("n_lines") - F.size("__kept"))
            .cast("long"),
        )
        .drop("__id", "__lost", "__kept")
    )
