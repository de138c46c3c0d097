"""Registered queries against their SQL, and those without SQL against brute force."""

import struct
import zlib

import pytest
import xxhash

import __spark_entry__ as registry
from pipewright.llm import queries
from tests.llm import test_jaccard_join as near_copies
from tests.llm import test_secrets as patterns
from tests.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert {*queries.queries(), "pipeline"} <= set(registry.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    assert compare(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) == []


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_jaccard_join(spark):
    found = queries.op10_ngram_jaccard_join(spark, FOLDER).collect()
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found)
    assert got == near_copies.brute(texts(spark))


def test_secret_scan(spark):
    found = {r.doc_id: r for r in queries.op7_secret_scan(spark, FOLDER).collect()}
    for i, t in texts(spark):
        hits = patterns.candidates(t)
        assert found[i].spans == ",".join(f"{c['kind']}:{c['start']}:{c['end']}" for c in hits)
        for kind in ("assign", "access", "hex"):
            assert found[i][f"n_{kind}"] == sum(c["kind"] == kind for c in hits)


def spark_hash(*values):
    """XXH64 of values one after the other, each with the hash before as its seed; nulls are skipped."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h


def whole(n):
    return struct.pack("<i", n)


def long(n):
    return None if n is None else struct.pack("<q", n)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def rows_of_documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def test_sharding(spark):
    """Every shard against a rendezvous over all shards, hashed outside of Spark."""
    found = {r.doc_id: r for r in queries.op2_sharding(spark, FOLDER).collect()}
    rows = rows_of_documents(spark)
    assert len(found) == len(rows)
    for r in rows:
        scores = [signed(spark_hash(whole(2024), whole(s), long(r.doc_id))) for s in range(25)]
        assert found[r.doc_id].shard == scores.index(max(scores[:24]))
        assert found[r.doc_id].grown_shard == scores.index(max(scores))
        raw = (r.text or "").encode()
        assert (found[r.doc_id].size, found[r.doc_id].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for shard in range(24):
        slots = sorted(r.slot for r in found.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def earliest_deadline_first(blocks, weights):
    """(source, block) by slot: in each slot the released block with the earliest deadline, with new
    windows whenever a source has used up its blocks."""
    order, used = [], dict.fromkeys(blocks, 0)
    while any(used[s] < blocks[s] for s in blocks):
        live = sorted(s for s in blocks if used[s] < blocks[s])
        total, start, done = sum(weights[s] for s in live), len(order), dict.fromkeys(live, 0)
        while all(used[s] < blocks[s] for s in live):
            t = len(order) - start
            due = [
                (-(-(done[s] + 1) * total // weights[s]), s)
                for s in live
                if done[s] * total // weights[s] <= t
            ]
            best = min(due)[1]
            order.append((best, used[best]))
            used[best] += 1
            done[best] += 1
    return order


def test_source_mixing(spark):
    """Every position of the query against the schedule, block by block and row by row."""
    found = {r.doc_id: r for r in queries.op8_source_mixing(spark, FOLDER).collect()}
    members = {}
    for r in rows_of_documents(spark):
        source = r.source if r.source in queries.WEIGHTS else "other"
        other = spark_hash(whole(9), long(r.doc_id), r.text, r.lang, r.source, long(r.n_chars))
        key = ((other >> 16) % 1024, signed(spark_hash(whole(8), long(r.doc_id))), signed(other))
        members.setdefault(source, []).append((key, r.doc_id))
    for own in members.values():
        own.sort()
    size = {s: -(-len(own) // 64) for s, own in members.items()}
    weights = {**queries.WEIGHTS, "other": queries.OTHER_WEIGHT}
    position, want = 0, {}
    for slot, (source, block) in enumerate(earliest_deadline_first(size, weights)):
        for _, doc_id in members[source][block * 64 : block * 64 + 64]:
            want[doc_id] = (source, block, slot, position)
            position += 1
    assert {i: (r.mix_source, r.block, r.slot, r.position) for i, r in found.items()} == want
