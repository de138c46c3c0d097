"""Mixing sources to target weights: a Pfair schedule of source blocks."""

from __future__ import annotations

from bisect import bisect_left
from math import ceil, gcd
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.common import hashable, without

BLOCK_ROWS = 64
BUCKETS, BUCKET_ROWS = 1024, 100_000
OTHER = "other"
OWN = ("mix_source", "block", "slot", "position")


def pfair(shares: dict[str, int]) -> list[str]:
    """Which source gets each slot of one period, as many slots as there are shares.

    Block j of a source with weight w = share / period is released at floor((j - 1) / w) and due at
    ceil(j / w). Each slot goes to the released block that is due first, ties to the first name.
    Every block meets its window, so no source is ever a whole block off its weight, and after a
    period all are exactly on it.
    """
    period = sum(shares.values())
    done = dict.fromkeys(sorted(shares), 0)
    slots = []
    for t in range(period):
        due = {
            s: -(-(j + 1) * period // shares[s])
            for s, j in done.items()
            if j < shares[s] and j * period // shares[s] <= t
        }
        best = min(due, key=due.get)
        done[best] += 1
        slots.append(best)
    return slots


class Run(NamedTuple):
    """What one source contributes to one phase."""

    mix_source: str
    first_block: int
    end_block: int
    phase_slot: int  # the phase's first slot
    phase_row: int  # the rows before the phase
    period: int
    places: list[int]  # the source's slots in a period


def schedule(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> list[Run]:
    """Phases in which the mix holds: whenever a source has no block left, a new phase starts with
    the weights of the others in proportion."""
    left = {s: ceil(n / block_rows) for s, n in rows.items() if n}
    used = dict.fromkeys(left, 0)
    runs, slot, row = [], 0, 0
    while left:
        common = gcd(*(weights[s] for s in left))
        pattern = pfair({s: weights[s] // common for s in left})
        places = {s: [i for i, p in enumerate(pattern) if p == s] for s in left}
        period = len(pattern)
        last = {
            s: (n - 1) // len(places[s]) * period + places[s][(n - 1) % len(places[s])]
            for s, n in left.items()
        }
        ended = min(last, key=last.get)
        length = last[ended] + 1
        for s in list(left):
            n = length // period * len(places[s]) + bisect_left(places[s], length % period)
            runs.append(Run(s, used[s], used[s] + n, slot, row, period, places[s]))
            used[s] += n
            left[s] -= n
        del left[ended]
        slot += length
        row += length * block_rows - (-rows[ended] % block_rows)
    return runs


def mixed(
    docs: DataFrame,
    weights: dict[str, int],
    id_col: str = "doc_id",
    source_col: str = "source",
    other: int = 1,
    block_rows: int = BLOCK_ROWS,
    seed: int = 8,
) -> DataFrame:
    """All rows with `mix_source`, `block` (of the source), `slot` (of the block in the mix) and
    `position` (of the row in the mix, gapless from 0).

    `weights` are whole shares by source; a null source and sources that are not named form one
    group with the share `other`. Rows of a group are ordered by a seeded hash of the id and cut
    into blocks of `block_rows`, the last one shorter. Slots follow the Pfair schedule (`schedule`),
    so up to any slot of a phase each source is less than one block off its weight. Nothing is left
    out: when a source is used up, the others go on in proportion.

    A row's rank in its group is its rank in one of many hash buckets plus the rows of the buckets
    before, so no group is sorted in one task. The schedule has a row for each named source, with
    its phases and in each the source's slots in a period of at most the sum of all shares; a row
    finds its phase there.

    The hash takes in all columns (maps aside), so rows that share an id, null included, are spread
    unless they are equal. No rows give no rows. Input columns named like the new ones are replaced.
    """
    if not all(isinstance(w, int) and w > 0 for w in [*weights.values(), other]):
        raise ValueError("weights are whole and positive")
    shares = {**weights, OTHER: weights.get(OTHER, other)}
    group = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)).otherwise(OTHER)
    rows = without(docs, OWN)
    carried = rows.columns
    counts = dict(tuple(r) for r in rows.groupBy(group).count().collect())  # one for each share
    by_source: dict[str, list[Run]] = {}
    for run in schedule(counts, shares, block_rows):
        by_source.setdefault(run.mix_source, []).append(run)
    plan = docs.sparkSession.createDataFrame(
        list(by_source.items()),
        "mix_source string, __runs array<struct<mix_source: string, first_block: long, end_block: long,"
        " phase_slot: long, phase_row: long, period: long, places: array<int>>>",
    )
    buckets = max(BUCKETS, ceil(sum(counts.values()) / BUCKET_ROWS))
    hashed = rows.withColumns(
        {
            "mix_source": group,
            "__order": F.xxhash64(F.lit(seed), F.col(id_col)),
            "__other": F.xxhash64(F.lit(seed + 1), *hashable(rows)),
        }
    ).withColumn("__bucket", F.pmod(F.shiftrightunsigned("__other", 16), F.lit(buckets)))
    before = Window.partitionBy("mix_source").orderBy("__bucket")
    heads = (
        hashed.groupBy("mix_source", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__head", F.sum("__n").over(before) - F.col("__n"))
        .select("mix_source", "__bucket", "__head")
    )
    inner = Window.partitionBy("mix_source", "__bucket").orderBy("__order", "__other", id_col)
    ranked = hashed.withColumn("__place", F.row_number().over(inner) - 1).join(
        heads, ["mix_source", "__bucket"]
    )
    rank = F.col("__head") + F.col("__place")
    # Phases follow each other, so the first one that ends beyond a block is the block's.
    run = F.element_at(F.filter("__runs", lambda r: r["end_block"] > F.col("block")), 1)
    k = F.col("block") - F.col("__run.first_block")
    turn = F.size("__run.places")
    in_phase = F.floor(k / turn) * F.col("__run.period") + F.element_at(
        "__run.places", (k % turn + 1).cast("int")
    )
    return (
        ranked.withColumn("block", F.floor(rank / block_rows))
        .join(F.broadcast(plan), "mix_source")
        .withColumn("__run", run)
        .withColumn("__slot", in_phase)
        .select(
            *carried,
            "mix_source",
            "block",
            (F.col("__run.phase_slot") + F.col("__slot")).alias("slot"),
            (F.col("__run.phase_row") + F.col("__slot") * block_rows + rank % block_rows).alias("position"),
        )
    )


def in_order(mix: DataFrame) -> DataFrame:
    """The rows as they are to be read: ranges of positions, sorted, without the added columns."""
    return mix.repartitionByRange("position").sortWithinPartitions("position").drop(*OWN)
