"""Exact top-k search by inner product: columnar branch and bound."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.common import bound_batches

QUERY_ROWS, ROWS = 4_096, 8_192  # of one cell of the grid
BLOCK = 8  # dimensions added at a time
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): components as floor(scale * x). Rows with a null id, a null vector, or a null or
    non-finite component are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vertical layout: one row per dimension. Shorter vectors end in zeros."""
    out = np.zeros((width, len(column)), np.int64)
    for i, v in enumerate(column):
        out[: len(v), i] = v
    return out


def search_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block: int = BLOCK) -> pd.DataFrame:
    """The k best rows for each query among the rows of one cell.

    Partial products grow by a block of dimensions at a time. What is still to come lies within the
    product of the two remaining norms; once k candidates are certain to beat a row, it goes, and
    the survivors are compacted before the next block.
    """
    width = int(max(queries["v"].map(len).max(), rows["v"].map(len).max(), 1))
    ids = rows["id"].to_numpy()
    x, q = _matrix(rows["v"], width), _matrix(queries["v"], width)
    largest = [float(np.abs(m).max(initial=0)) for m in (x, q)]
    most = largest[0] * largest[1] * width
    if most < 2**52:  # every sum is exact in doubles, which BLAS adds
        x, q = x.astype(np.float64), q.astype(np.float64)
    cuts = list(range(0, width, block))
    rest_x, rest_q = (
        np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]) for m in (x, q)
    )
    found = []
    for j, query in enumerate(queries["id"].to_numpy()):
        alive = np.flatnonzero(ids != query)
        sums = np.zeros(len(alive), x.dtype)
        for c in cuts:
            part = x[c : c + block] if len(alive) == x.shape[1] else x[c : c + block, alive]
            sums = sums + q[c : c + block, j] @ part
            # Bounds are whole numbers where sums are; beyond 2^61 they might not fit, and all stay.
            if len(alive) <= k or c + block >= width or most >= 2**61:
                continue
            reach = np.ceil(rest_x[c + block, alive] * (rest_q[c + block, j] * (1 + 1e-9)) + 1)
            reach = reach.astype(x.dtype)
            sure = np.partition(sums - reach, len(alive) - k)[len(alive) - k]
            keep = sums + reach >= sure
            alive, sums = alive[keep], sums[keep]
        best = np.lexsort((ids[alive], -sums))[:k]
        found.append(
            pd.DataFrame(
                {"query_id": query, "vec_id": ids[alive[best]], "score": sums[best].astype(np.int64)}
            )
        )
    return pd.concat(found)


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    rows: int = ROWS,
) -> DataFrame:
    """For each query vector its k best other vectors: (query_id, rank from 1, vec_id, score).

    Components count as floor(1024 * x), scores are integer inner products (they must fit a long),
    ties go to the smaller id. `is_query` is a condition on the input's rows. A query's own row is
    every row with its id. Equal query rows count once; rows that repeat another vector are
    candidates of their own. Vectors that are null or hold a null or non-finite component take no
    part; shorter vectors count as ending in zeros. Fewer than k candidates give fewer ranks, no
    vectors give no rows. Other columns are not looked at.

    Queries and rows are dealt by hash into blocks of bounded size; each cell of the grid of blocks
    is searched on its own and returns at most k rows per query, of which a window keeps the best.
    """
    bound_batches(vectors.sparkSession)
    asked = whole_numbers(vectors.where(is_query), id_col, vector_col).distinct()
    every = whole_numbers(vectors, id_col, vector_col)
    n = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    across, down = max(1, ceil(n[0] / rows)), max(1, ceil(n[1] / query_rows))

    def cell(of: int, over: int, own: str, other: str):
        return [
            # The vector parts rows that repeat an id.
            F.pmod(F.xxhash64("id", "v"), F.lit(of)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(over - 1)).cast("array<long>")).alias(other),
        ]

    grid_q = asked.select("id", "v", *cell(down, across, "qb", "rb"))
    grid_r = every.select("id", "v", *cell(across, down, "rb", "qb"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return search_cell(q, r, k)

    found = grid_q.groupBy("qb", "rb").cogroup(grid_r.groupBy("qb", "rb")).applyInPandas(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
