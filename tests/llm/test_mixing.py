from math import ceil

import pytest
from pyspark.sql import functions as F

from pipewright.llm import mixing, queries
from pipewright.llm.common import hashable
from pipewright.llm.mixing import in_order, mixed, pfair, schedule
from tests.llm.small import awkward, docs


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2}, {"a": 7, "b": 1, "c": 5}, {f"s{i}": 1 + i * i for i in range(9)}])
def test_every_block_meets_its_window(shares):
    slots, period = pfair(shares), sum(shares.values())
    assert len(slots) == period
    done = dict.fromkeys(shares, 0)
    for t, s in enumerate(slots):
        done[s] += 1
        release, due = (done[s] - 1) * period // shares[s], ceil(done[s] * period / shares[s])
        assert release <= t < due
        for x, share in shares.items():
            assert abs(done[x] - share * (t + 1) / period) < 1
    assert done == shares


def test_phases_use_up_every_source():
    rows, weights = {"a": 1000, "b": 90, "c": 333, "none": 0}, {"a": 2, "b": 5, "c": 4, "none": 3}
    runs = schedule(rows, weights, 10)
    slots = {}
    for r in runs:
        for k in range(r.end_block - r.first_block):
            slot = r.phase_slot + k // len(r.places) * r.period + r.places[k % len(r.places)]
            assert slot not in slots
            slots[slot] = (r.mix_source, r.first_block + k)
    assert sorted(slots) == list(range(100 + 9 + 34))
    order = [slots[s][0] for s in sorted(slots)]
    ends = max(i for i, s in enumerate(order) if s == "b") + 1
    for t in range(1, ends):
        for s in "abc":
            assert abs(order[:t].count(s) - weights[s] * t / 11) < 1


def check(frame, weights, block_rows):
    rows = mixed(frame, weights, block_rows=block_rows).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    blocks = {}
    for r in sorted(rows, key=lambda r: r.position):
        blocks.setdefault((r.mix_source, r.block), []).append(r)
    order = [b[0].slot for b in blocks.values()]
    assert order == list(range(len(order)))  # slots and positions agree, and slots are gapless
    for source in {s for s, _ in blocks}:
        own = [len(b) for (s, _), b in sorted(blocks.items()) if s == source]
        assert own[:-1] == [block_rows] * (len(own) - 1) and 0 < own[-1] <= block_rows
    return rows


def test_positions_follow_the_schedule(spark):
    frame = docs(spark, [(i, f"t{i}") for i in range(400)])
    rows = check(frame, {"src0": 3, "src1": 1, "unused": 4}, 7)
    assert {r.mix_source for r in rows} == {"src0", "src1", "other"}
    assert len(rows) == 400
    again = mixed(frame.repartition(5), {"src0": 3, "src1": 1, "unused": 4}, block_rows=7).collect()
    assert sorted(rows) == sorted(again)


def test_rows_in_order(spark):
    frame = docs(spark, [(i, f"t{i}") for i in range(100)])
    mix = mixed(frame, {"src0": 1, "src1": 1}, block_rows=4)
    expected = [r.doc_id for r in mix.orderBy("position").collect()]
    ordered = in_order(mix)
    assert ordered.columns == frame.columns
    assert [r.doc_id for r in ordered.collect()] == expected


def test_awkward_rows(spark):
    clashing = "SLOT Block period places first_block end_block phase_slot phase_row"
    assert len(check(docs(spark, awkward(), clashing), {"src0": 2}, 2)) == len(awkward())
    assert mixed(docs(spark, []), {"src0": 1}).collect() == []
    with pytest.raises(ValueError):
        mixed(docs(spark, []), {"src0": 0})


def test_query_places_every_document(spark):
    rows = queries.op8_source_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.position for r in rows) == list(range(len(rows))) and len(rows) >= 200


def test_rows_that_share_an_id_are_spread(spark, monkeypatch):
    """Rows without an id meet in many small buckets, not in one."""
    monkeypatch.setattr(mixing, "BUCKETS", 64)
    frame = docs(spark, [(None, f"t{i}") for i in range(1280)])
    rows = check(frame, {"src0": 3, "src1": 1}, 7)
    assert len(rows) == 1280
    hashed = frame.select(F.pmod(F.xxhash64(F.lit(9), *hashable(frame)), F.lit(64)).alias("b"))
    assert hashed.groupBy("b").count().agg(F.max("count")).first()[0] < 60
