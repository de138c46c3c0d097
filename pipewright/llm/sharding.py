"""Sharding: a two-pass external shuffle of all records into shards."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.common import hashable, without

SHARDS = 24
BUCKET_BYTES = 16 << 20
BUCKET_SLOTS = 256  # of a shard that follows a mix
OWN = ("shard", "slot", "grown_shard")


def shard_of(key, shards: int, seed: int):
    """The shard whose seeded hash with the key is largest. One more shard changes the place of
    those rows alone that it wins itself."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("score"), s.alias("shard")),
    )
    return F.array_max(scores)["shard"]


def shuffled_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20_24,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows with `shard` (int, 0 to shards - 1), `slot` (long, gapless from 0 in each shard, in
    random order) and `grown_shard` (the shard if there were one more).

    Pass one scatters whole records by seeded hashes of all their columns (maps aside) into buckets
    of about `bucket_bytes` within each shard; how many a shard has follows from the bytes of its
    texts. Pass two gathers one bucket in memory, puts it in a fixed order and permutes it by
    Fisher-Yates (`shuffle` with a seed). Buckets are dealt to tasks by their numbers, so none meets
    another one by chance. Slots continue from bucket to bucket by the rows counted before.

    The law is `key`: id and number of shards alone decide the shard. Bytes and rows per shard are
    therefore equal up to chance. The same input always gives the same slots. Rows with a null id
    share a shard, which has the more buckets for it; only rows that are equal in every column share
    a bucket for sure. Null texts count 8 bytes. Input columns named like the new ones are replaced.
    """
    rows = without(docs, OWN)
    key = F.col(id_col)
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    held = dict(
        tuple(r) for r in rows.groupBy(shard_of(key, shards, seed)).agg(F.sum(size)).collect()
    )  # one number for each shard
    buckets = [max(1, ceil(held.get(s, 0) / bucket_bytes)) for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards)]

    def of_shard(numbers: list[int]):
        return F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("shard") + 1)

    placed = (
        rows.select(
            shard_of(key, shards, seed).alias("shard"),
            F.xxhash64(F.lit(seed), *hashable(rows)).alias("order"),
            F.struct(*rows.columns).alias("record"),
        )
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 20), of_shard(buckets)).cast("int"))
        .withColumn("bucket", F.col("bucket") + of_shard(first))
    )
    heads = (
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")))
        .select("bucket", (F.col("before") - F.col("n")).alias("head"))
    )
    # The head of a bucket travels with its records, so that no join has to sort whole buckets.
    gathered = (
        placed.withColumn("item", F.struct("order", "record"))
        .select("shard", "bucket", "item", F.lit(None).cast("long").alias("head"))
        .unionByName(heads.withColumn("item", F.lit(None)), allowMissingColumns=True)
        .repartitionById(sum(buckets), F.col("bucket"))
        .groupBy("bucket")
        .agg(
            F.max("shard").alias("shard"), F.max("head").alias("head"), F.collect_list("item").alias("items")
        )
    )
    return _permuted(gathered, seed).withColumn("grown_shard", shard_of(key, shards + 1, seed))


def _permuted(gathered: DataFrame, seed: int) -> DataFrame:
    """Rows of buckets (shard, head, items) in random order: Fisher-Yates over each bucket, which is
    put in a fixed order before."""
    fixed = F.array_sort(
        "items",
        lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0),
    )
    return (
        gathered.withColumn("items", F.shuffle(fixed, seed))
        .select("shard", "head", F.posexplode("items").alias("place", "item"))
        .select("item.record.*", "shard", (F.col("head") + F.col("place")).alias("slot"))
    )


def mixed_shards(
    docs: DataFrame, shards: int = SHARDS, bucket_slots: int = BUCKET_SLOTS, seed: int = 20_24
) -> DataFrame:
    """All rows of a frame read from Parquet files with `shard` and `slot` (gapless from 0 in each
    shard), so that every shard follows the order in which the rows were written, and is shuffled
    within it.

    Pass one scatters whole records into buckets: the row at position p belongs to shard p mod
    `shards`, there to the bucket of `bucket_slots` slots that p div `shards` falls into. Pass two
    gathers a bucket in memory and permutes it by Fisher-Yates. So the first k buckets of every
    shard hold every `shards`-th of the first rows: whatever mix these have, each shard has it.
    Positions are the rows of the files before (one number a file) and the row's place in its file;
    a mix has put its rows there by seeded hashes. Equal rows have places of their own. Input
    columns named like the new ones are replaced. No rows give no rows.
    """
    rows = without(docs, OWN)
    placed = docs.select(
        F.struct(*[docs[c] for c in rows.columns]).alias("record"),
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    # Parts count up in the order of the rows; from part 100,000 on names do not sort like numbers.
    part = F.regexp_extract("__file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        placed.groupBy("__file")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__head"))
    )
    position = F.col("__head") + F.col("__row")
    buckets = (
        placed.join(heads, "__file")
        .select(
            F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
            F.floor(position / shards).cast("long").alias("order"),
            "record",
        )
        .withColumn("bucket", F.floor(F.col("order") / bucket_slots))
        .groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("order", "record")).alias("items"))
    )
    return _permuted(buckets.withColumn("head", F.col("bucket") * bucket_slots), seed)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; its files, read by name, hold the rows in slot order."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
