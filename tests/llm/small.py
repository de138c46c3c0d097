"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra: str = ""):
    """Rows (id, text); language and source repeat. `extra` names a further column to clash with."""
    rows = [
        (i, t, ("en", "de", None)[n % 3], ("src0", "src1", None, "elsewhere")[n % 4], len(t or ""))
        for n, (i, t) in enumerate(texts)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        frame = frame.selectExpr("*", *[f"'mine' AS {name}" for name in extra.split()])
    return frame


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Null, empty and blank texts, a very long one, null and repeated ids, equal rows."""
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma,", "delta", "Épsilon", "zeta9", "éta", "THETA", "iota", "kappa."]
    long_text = " ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(30_000))
    base = " ".join(rnd.choice(words) + str(i) for i in range(60))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, long_text),
        (5, base),
        (6, base + " more"),
        (7, base.upper()),
        (8, base),
        (8, base),
        (9, "one"),
        (10, "one"),
        (None, base),
        (None, None),
        (11, "\x00 nul \x00"),
        (12, "日本語 の 文章 です ね 😀"),
    ]
