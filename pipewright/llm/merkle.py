"""Merkle manifest of a dataset, and multiproofs for the leaves of a partition."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.common import ascii_lower, without, written

ARITY = 16
PART_LEAVES = 16_384  # leaves that are proved together
RANK_ROWS = 200_000  # of one range while leaves are put in order
TOP = -1  # the tree over all subroots
OWN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that no two rows read alike."""
    text = value.cast("string")
    counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(counted, F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(df: DataFrame, order: list[str], label: str, rows: int) -> DataFrame:
    """The written frame with `at`, its place from 0 in the given order, and `range`.

    Rows are sorted in ranges of about RANK_ROWS; a place is the rows of the ranges before and the
    row's place in its own, so no order is ever made in one task.
    """
    ranges = max(1, ceil(rows / RANK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = df.repartitionByRange(min(ranges, max(rows, 1)), *order).sortWithinPartitions(*order)
    # The upper bits of this id are the range, the lower 33 the place in it.
    placed = written(sorted_.withColumn("__id", F.monotonically_increasing_id()), label)
    placed = placed.withColumns(
        {"range": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND((1 << 33) - 1)}
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        placed.groupBy("range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__head"))
    )
    return placed.join(heads, "range").withColumn("at", F.col("__head") + F.col("__row")).drop(
        "__id", "__row", "__head"
    )


def levels_of(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def node_levels(leaves: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """Frames (tree, level, idx, digest, size), one for each level: the leaves, then every run of
    ARITY nodes hashed, until a tree has one node left. `size` is the number of nodes of the tree
    on that level."""
    level = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "size")
    out = [level]
    for number in range(1, levels_of(largest) + 1):
        runs = level.where("size > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx")).agg(
            # A run has ARITY nodes at most.
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"),
            F.max("size").alias("size"),
        )
        text = F.concat_ws("", F.transform("run", lambda n: n["digest"]))
        level = written(
            runs.select(
                "tree",
                F.lit(number).alias("level"),
                "idx",
                F.sha2(text, 256).alias("digest"),
                F.ceil(F.col("size") / ARITY).cast("long").alias("size"),
            ),
            f"{label}-{number}",
        )
        out.append(level)
    return out


def touched(idx: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level of a tree of `size` leaves: the level, the runs on the way up from the leaves
    `idx` (ascending), and the members of these runs that are not derived on the way."""
    level, own = 0, idx
    while size > 1:
        runs = np.unique(own // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        members = members[members < size]
        yield level, runs, np.setdiff1d(members, own, assume_unique=True)
        level, own, size = level + 1, runs, -(-size // ARITY)


def missing(trees: np.ndarray, idx: np.ndarray, sizes: np.ndarray, n_trees: int) -> list[tuple]:
    """The smallest set of node coordinates (tree, level, idx) that, with the given leaves, derives
    the root: nodes shared by several proofs count once, and nodes that the leaves derive not at
    all."""
    out = []
    for tree in np.unique(trees):
        own = trees == tree
        for level, _, absent in touched(np.unique(idx[own]), int(sizes[own][0])):
            out += [(int(tree), level, int(i)) for i in absent]
    for level, _, absent in touched(np.unique(trees), n_trees):
        out += [(TOP, level, int(i)) for i in absent]
    return out


class Proofs:
    """All nodes on the way from a partition's leaves to the root, derived once; single proofs are
    read off them."""

    def __init__(self, trees, idx, sizes, digests, fetched: dict[tuple, str], n_trees: int):
        self.nodes = dict(fetched)
        self.sizes = {TOP: n_trees}
        self.beyond: dict[tuple, str] = {}  # of a node: the siblings from there to the root
        for tree in np.unique(trees):
            own = np.flatnonzero(trees == tree)
            self.sizes[int(tree)] = int(sizes[own[0]])
            self.nodes |= {(int(tree), 0, int(idx[i])): digests[i] for i in own}
            self.nodes[(TOP, 0, int(tree))] = self._derive(int(tree), np.unique(idx[own]))
        self.root = self._derive(TOP, np.unique(trees))

    def _run(self, tree: int, level: int, run: int, size: int) -> list[str]:
        return [
            self.nodes[(tree, level, i)] for i in range(run * ARITY, min((run + 1) * ARITY, size))
        ]

    def _derive(self, tree: int, idx: np.ndarray) -> str:
        size, level = self.sizes[tree], 0
        for level_, runs, _ in touched(idx, size):
            for run in runs.tolist():
                text = "".join(self._run(tree, level_, run, size))
                self.nodes[(tree, level_ + 1, run)] = sha256(text.encode()).hexdigest()
            size, level = -(-size // ARITY), level_ + 1
        return self.nodes[(tree, level, 0)]

    def siblings(self, tree: int, idx: int) -> str:
        """All siblings from a leaf to the root, level by level, each run from left to right."""
        level, size = 0, self.sizes[tree]
        return self._from(tree, level, idx, size)

    def _from(self, tree: int, level: int, idx: int, size: int) -> str:
        if size <= 1:
            return "" if tree == TOP else self._from(TOP, 0, tree, self.sizes[TOP])
        key = (tree, level, idx)
        if level and key in self.beyond:
            return self.beyond[key]
        run = self._run(tree, level, idx // ARITY, size)
        del run[idx % ARITY]
        text = "".join(run) + self._from(tree, level + 1, idx // ARITY, -(-size // ARITY))
        if level or tree == TOP:
            self.beyond[key] = text
        return text

    def folded(self, digest: str, tree: int, idx: int) -> str:
        """The root that follows from a leaf's digest and the siblings of its place."""
        size, level = self.sizes[tree], 0
        while size > 1:
            run = self._run(tree, level, idx // ARITY, size)
            run[idx % ARITY] = digest
            digest = sha256("".join(run).encode()).hexdigest()
            idx, size, level = idx // ARITY, -(-size // ARITY), level + 1
        return digest if tree == TOP else self.folded(digest, TOP, tree)


def _requests(n_trees: int):
    def work(leaves: pa.Table) -> pa.Table:
        trees, idx, size = (leaves.column(c).to_numpy() for c in ("tree", "idx", "size"))
        coordinates = np.array(missing(trees, idx, size, n_trees), np.int64).reshape(-1, 3)
        part = np.full(len(coordinates), leaves.column("part")[0].as_py(), np.int64)
        return pa.table(
            [part, coordinates[:, 0], coordinates[:, 1].astype(np.int32), coordinates[:, 2]],
            names=["part", "tree", "level", "idx"],
        )

    return work


def _proved(n_trees: int, id_type: pa.DataType):
    def work(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        trees, idx, sizes = (leaves.column(c).to_numpy() for c in ("tree", "idx", "size"))
        digests, changed = (leaves.column(c).to_pylist() for c in ("digest", "changed"))
        keys = zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx")))
        proofs = Proofs(
            trees, idx, sizes, digests, dict(zip(keys, fetched.column("digest").to_pylist())), n_trees
        )
        proof, folded, subroot = [], [], []
        for tree, i, digest, other in zip(trees.tolist(), idx.tolist(), digests, changed):
            proof.append(sha256(proofs.siblings(tree, i).encode()).hexdigest())
            folded.append(proofs.folded(other or digest, tree, i))
            subroot.append(proofs.nodes[(TOP, 0, tree)])
        root = [proofs.root] * len(digests)
        columns = [
            leaves.column("id").cast(id_type).combine_chunks(),
            *[pa.array(c, pa.string()) for c in (digests, subroot, root, proof, folded)],
            pa.array([f == proofs.root for f in folded], pa.bool_()),
        ]
        return pa.table(columns, names=["id", *OWN])

    return work


def manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    source_col: str = "source",
    changed: Column | None = None,
) -> tuple[DataFrame, list[DataFrame], int]:
    """Leaves (id, digest, changed, tree, idx, size, part) of all rows, the nodes of all trees by
    level, and the number of trees.

    A leaf is the hash of a row's `fields`; `changed`, where given and not null, is the hash it has
    after something was done to the row. Each source has a tree over its leaves, ascending by id;
    the tree TOP stands over their roots, ordered by source, null first.
    """
    spark = docs.sparkSession
    hashed = docs.select(
        # Null comes before every name, the empty one included.
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.col(id_col).alias("id"),
        leaf_hash([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
        # Only parts rows that repeat an id and a hash between ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    hashed = written(hashed, "leaves")
    rows = hashed.count()
    placed = numbered(hashed, ["source", "id", "digest", "tie"], "ordered", rows).drop("tie")
    # One row for each source in each range, so that a large source meets its head in many tasks.
    met = placed.groupBy("range", "source").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    by_source = written(
        met.groupBy("source").agg(F.min("at").alias("head"), F.sum("n").alias("size")), "sources"
    )
    n_trees = by_source.count()
    trees = numbered(by_source, ["source"], "trees", n_trees).select(
        "source", "head", "size", F.col("at").alias("tree")
    )
    heads = met.select("range", "source").join(trees, "source")
    leaves = written(
        placed.join(heads, ["range", "source"]).select(
            "id",
            "digest",
            "changed",
            "tree",
            (F.col("at") - F.col("head")).alias("idx"),
            "size",
            F.floor(F.col("at") / PART_LEAVES).alias("part"),
        ),
        "placed",
    )
    largest = by_source.agg(F.max("size")).first()[0] or 0
    levels = node_levels(leaves, largest, "nodes")
    subroots = _stacked(levels).where("size = 1").select(
        F.lit(TOP).cast("long").alias("tree"),
        F.col("tree").alias("idx"),
        "digest",
        F.lit(n_trees).cast("long").alias("size"),
    )
    above = node_levels(written(subroots, "subroots"), n_trees, "top")
    return leaves, [*levels, *above], n_trees


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def prove(leaves: DataFrame, levels: list[DataFrame], n_trees: int) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for the given leaves, which
    may be any of a manifest.

    The leaves of a part ask for the union of the nodes that their proofs lack and cannot derive
    themselves; these are fetched by one join. The part then derives all shared inner nodes once,
    and every proof is expanded from them where the leaves are.
    """
    wanted = leaves.select("part", "tree", "idx", "size")
    asked = wanted.groupBy("part").applyInArrow(
        _requests(n_trees), "part long, tree long, level int, idx long"
    )
    nodes = _stacked([x.select("tree", "level", "idx", "digest") for x in levels])
    fetched = asked.join(nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    text = dict(leaves.dtypes)["id"] == "string"
    columns = leaves.select(
        "part", "tree", "idx", "size", "digest", "changed", F.col("id").cast("string" if text else "long")
    )
    return (
        columns.groupBy("part")
        .cogroup(fetched.groupBy("part"))
        .applyInArrow(
            _proved(n_trees, pa.string() if text else pa.int64()),
            f"id {'string' if text else 'long'}, leaf string, subroot string, root string, "
            "proof_sha256 string, folded_root string, verified boolean",
        )
    )


def tampered_leaf(fields: list[str], text_col: str, id_col: str, every: int = 5) -> Column:
    """The hash of a row whose text lost its upper case A-Z, for rows whose id's CRC-32 `every`
    divides; null for all others."""
    lowered = [ascii_lower(F.col(f)) if f == text_col else F.col(f) for f in fields]
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(chosen, leaf_hash(lowered))


def proved_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    every: int = 5,
) -> DataFrame:
    """The manifest's proof of every row, checked against rows that were tampered with: (id, leaf,
    subroot, root, proof_sha256, folded_root, verified).

    Hashes are lowercase hex SHA-256 of concatenated hex texts. Runs of 16 nodes have one parent.
    Rows without an id come first in their source and are not tampered with; rows that repeat an id
    are ordered by their hash, and equal rows have neighbouring places, one each. A null source is a
    source of its own, before all others. Tampering changes nothing in a text without A-Z, in an
    empty or a null one; such rows still verify. No rows give no rows. Further columns are neither
    hashed nor returned.
    """
    leaves, levels, n_trees = manifest(
        without(docs, [n for n in OWN if n not in fields]),
        list(fields),
        id_col,
        source_col,
        tampered_leaf(list(fields), text_col, id_col, every),
    )
    return prove(leaves, levels, n_trees).withColumnRenamed("id", id_col)
