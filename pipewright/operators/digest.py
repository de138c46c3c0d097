"""Ordered text of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    line: str,
    separator: str,
    out: str,
    parts: tuple[str, ...] = (),
    only: DataFrame | None = None,
) -> DataFrame:
    """The `line` texts of every group in the given order, joined: (keys, parts, out).

    `parts` are columns that split a group into several texts. They follow from the lines' own
    values (say, their month), so every run cuts the same way, whatever the size; lines of one text
    meet in one task. Lines that tie in `order` come in the order of their texts. `only` keeps the
    groups whose keys it holds.
    """
    if only is not None:
        df = df.join(only.select(*keys), keys, "left_semi")
    fields = [*order, line] if line not in order else order
    # Lists cannot be combined on the map side, so lines are shuffled as they are and collected once.
    return (
        df.repartition(*keys, *parts)
        .groupBy(*keys, *parts)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_lines"))
        .select(
            *keys,
            *parts,
            F.concat_ws(separator, F.transform("_lines", lambda e: e[line])).alias(out),
        )
    )


def whole_digest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    line: str,
    separator: str,
    out: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """`ordered_digest` without parts: one text a group, (keys, out), for readers that want a row for
    each group.

    The ordered aggregate collects a group's lines in one task and joins them there, so the caller
    says that a group's text fits; nothing switches to it by size. NULL lines are left out, and a
    group of nothing else has a NULL text.
    """
    if only is not None:
        df = df.join(only.select(*keys), keys, "left_semi")
    by = ", ".join(f"`{c}`" for c in dict.fromkeys([*order, line]))
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    joined = F.expr(f"listagg(`{line}`, '{quoted}') WITHIN GROUP (ORDER BY {by})")
    return df.repartition(*keys).groupBy(*keys).agg(joined.alias(out))
