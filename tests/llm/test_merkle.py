"""Merkle manifests and proofs against a tree that is built in one place."""

import hashlib
import zlib

import numpy as np
import pytest

from pipewright.llm import merkle
from tests.llm.small import LOWER, awkward, docs

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row.source, []).append((leaf_of(row, row.text), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, x[0]))
    trees = {s: levels([leaf for leaf, _ in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for i, (leaf, row) in enumerate(by[s]):
            digest, siblings = leaf, []
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0:
                digest = leaf_of(row, row.text and row.text.translate(LOWER))
            for tree, at in ((trees[s], i), (top, number)):
                for level in tree[:-1]:
                    run, k = level[at // 16 * 16 :][:16], at % 16
                    siblings += run[:k] + run[k + 1 :]
                    digest, at = H(*run[:k], digest, *run[k + 1 :]), at // 16
            root = top[-1][0]
            out.append((row.doc_id, leaf, trees[s][-1][0], root, H(*siblings), digest, digest == root))
    return out


def agree(frame):
    found = merkle.proved_manifest(frame)
    assert found.columns == list(COLUMNS)
    return sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute(frame.collect())))


def test_awkward_rows(spark):
    rows = awkward()
    assert agree(docs(spark, rows, extra="leaf root tree"))
    assert agree(docs(spark, [*rows, *rows, (None, "A"), (None, "A"), (7, "x")]))


def test_many_sources_and_levels(spark, monkeypatch):
    # Parts that do not end where runs or sources do, and ranges that split sources.
    monkeypatch.setattr(merkle, "PART_LEAVES", 37)
    rows = spark.range(900).selectExpr(
        "id AS doc_id", "concat('Text ', id) AS text", "if(id % 7 = 0, NULL, 'en') AS lang",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('s', id % 301) END AS source",
        "id AS n_chars",
    )
    assert agree(rows)


@pytest.mark.parametrize("rows", [[], [(5, "Only")]])
def test_hardly_any_rows(spark, rows):
    assert agree(docs(spark, rows))


def test_string_ids(spark):
    frame = docs(spark, [(i, f"Text {i}") for i in range(40)]).selectExpr(
        "concat('d', doc_id) AS doc_id", "text", "lang", "source", "n_chars"
    )
    found = merkle.proved_manifest(frame).collect()
    assert {r.doc_id for r in found} == {f"d{i}" for i in range(40)}


def test_union_of_missing_nodes_is_minimal():
    """Dropping any requested node leaves a proof open; with all of them the root follows."""
    nodes = levels([H(str(i)) for i in range(1000)])
    top = levels([nodes[-1][0]])
    idx = np.array([3, 4, 17, 400, 999])
    trees, sizes = np.zeros(5, np.int64), np.full(5, 1000)
    asked = merkle.missing(trees, idx, sizes, 1)
    assert len(asked) == len(set(asked))
    singly = sum(len(merkle.missing(trees[:1], idx[i : i + 1], sizes[:1], 1)) for i in range(5))
    assert len(asked) < singly
    fetched = {(t, level, i): nodes[level][i] for t, level, i in asked}
    digests = [nodes[0][i] for i in idx]
    assert merkle.Proofs(trees, idx, sizes, digests, fetched, 1).root == top[-1][0]
    for one in asked:
        rest = {k: v for k, v in fetched.items() if k != one}
        with pytest.raises(KeyError):
            merkle.Proofs(trees, idx, sizes, digests, rest, 1)


def test_some_leaves_of_a_manifest(spark):
    frame = docs(spark, [(i, f"Text {i}") for i in range(300)])
    leaves, nodes, n_trees = merkle.manifest(frame, ["doc_id", "text"])
    some = merkle.prove(leaves.where("id % 41 = 0"), nodes, n_trees).collect()
    assert len(some) == 8 and all(r.verified for r in some)
    assert len({r.root for r in merkle.prove(leaves, nodes, n_trees).collect()} | {some[0].root}) == 1
