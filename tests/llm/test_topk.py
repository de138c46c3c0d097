import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipewright.llm import topk
from pipewright.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step=10):
    ok = [
        (i, [math.floor(1024 * c) for c in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if i % step == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, vectors, k=4, **sizes):
    frame = spark.createDataFrame(vectors, SCHEMA)
    result = top_k(frame, F.col("vec_id") % 10 == 0, k, **sizes)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in result.collect())


def vectors(n, width, seed):
    rnd = random.Random(seed)
    return [(i, [rnd.randint(-2048, 2048) / 1024 * rnd.random() for _ in range(width)], 0) for i in range(n)]


def test_any_grid_gives_what_brute_force_gives(spark):
    rows = vectors(130, 19, 1)
    expected = brute([(i, [float(F32(c)) for c in v], l) for i, v, l in rows], 4)
    for sizes in ({}, {"query_rows": 3, "rows": 17}, {"query_rows": 100, "rows": 1}):
        assert found(spark, rows, **sizes) == expected


def F32(x):
    import numpy as np

    return np.float32(x)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.5, -0.25], 0) for i in range(60)]
    assert found(spark, rows, rows=7) == brute(rows, 4)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0),
        (10, None, 0),
        (20, [nan, 1.0], 0),
        (30, [inf, 1.0], 0),
        (40, [None, 1.0], 0),
        (50, [], 0),
        (60, [0.5], 0),
        (70, [1e6, -1e6, 1e6], 0),
        (1, [1.0, 1.0, 1.0], 0),
        (1, [1.0, 1.0, 1.0], 0),
        (None, [1.0, 1.0], 0),
    ]
    assert found(spark, rows) == brute(rows, 4)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 0)]) == []


def test_large_values_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**21 - 3 * i), 1.0], 0) for i in range(40)]
    assert found(spark, rows, k=7) == brute(rows, 7)


@pytest.mark.parametrize("size", [1 << 20, 1 << 28, 1 << 29])
def test_large_whole_numbers_are_exact(size):
    """Sums of which doubles hold the first 53 bits only."""
    rnd = np.random.default_rng(size)
    base = rnd.integers(-size, size, 16)
    rows = [base.copy() for _ in range(60)]
    for i, row in enumerate(rows):
        row[8 + i % 8] += i % 5
        row[i % 8] -= i % 3
    scores = {i: sum(int(a) * int(b) for a, b in zip(base, row)) for i, row in enumerate(rows)}
    assert max(abs(s) for s in scores.values()) < 2**63
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    queries = pd.DataFrame({"id": [-1], "v": [base]})
    cell = pd.DataFrame({"id": range(60), "v": rows})
    for k in (1, 7):
        got = topk.search_cell(queries, cell, k)
        assert list(zip(got["vec_id"], got["score"])) == best[:k]
