import zlib
from collections import Counter, defaultdict

from pyspark.sql.functions import spark_partition_id

from pipewright.llm import queries
from pipewright.llm.common import written
from pipewright.llm.sharding import mixed_shards, shuffled_shards, write_shards
from tests.llm.small import awkward, docs


def many(spark, n=600):
    return docs(spark, [(i, f"text {i} " * (i % 7)) for i in range(n)])


def test_each_row_once_with_gapless_slots(spark):
    found = shuffled_shards(many(spark), shards=5, bucket_bytes=500).collect()
    assert sorted(r.doc_id for r in found) == list(range(600))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(80 < len(s) < 160 for s in slots.values())


def test_same_input_same_result_and_order_is_shuffled(spark):
    def run():
        rows = shuffled_shards(many(spark).repartition(7), shards=3, bucket_bytes=2_000).collect()
        return sorted((r.doc_id, r.shard, r.slot) for r in rows)

    first = run()
    assert first == run()
    by_slot = [d for d, s, _ in sorted(first, key=lambda r: r[1:]) if s == 0]
    rises = sum(a < b for a, b in zip(by_slot, by_slot[1:])) / len(by_slot)
    assert 0.35 < rises < 0.65


def test_one_more_shard_takes_rows_only_into_itself(spark):
    now = {r.doc_id: r for r in shuffled_shards(many(spark), shards=4).collect()}
    grown = {r.doc_id: r.shard for r in shuffled_shards(many(spark), shards=5).collect()}
    assert all(grown[i] == r.grown_shard for i, r in now.items())
    assert all(grown[i] in (r.shard, 4) for i, r in now.items())
    assert 60 < sum(s == 4 for s in grown.values()) < 180


def test_awkward_rows_and_clashing_columns(spark):
    frame = docs(spark, awkward(), "SHARD slot")
    rows = shuffled_shards(frame, shards=2, bucket_bytes=100).collect()
    assert len(rows) == len(awkward())
    assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "grown_shard"]
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shuffled_shards(docs(spark, [])).collect() == []


def test_written_shards_keep_the_order(spark, tmp_path):
    found = shuffled_shards(many(spark), shards=3)
    write_shards(found, str(tmp_path / "out"))
    for shard in range(3):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("part-*"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and slots


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.op2_sharding(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)


def test_no_bucket_holds_all_rows_without_an_id(spark):
    """Half of the rows have no id: their shard has as many buckets more, each in a task of its own."""
    rows = [(None if i % 2 else i, f"text {i:06d}" * 5) for i in range(4000)]
    frame = shuffled_shards(docs(spark, rows), shards=4, bucket_bytes=4_000)
    found = frame.select("doc_id", "shard", "slot", spark_partition_id().alias("task")).collect()
    tasks = Counter(r.task for r in found)
    assert len(tasks) > 60 and max(tasks.values()) < 110
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_a_mix_are_shuffled_inside_their_buckets(spark):
    frame = written(docs(spark, [(i, f"t{i}") for i in range(3000)]).coalesce(1), "t")
    found = mixed_shards(frame, shards=3, bucket_slots=100).collect()
    for shard in range(3):
        own = {r.slot: r.doc_id for r in found if r.shard == shard}
        assert sorted(own) == list(range(1000))
        for bucket in range(10):
            ids = [own[i] for i in range(bucket * 100, bucket * 100 + 100)]
            # The bucket holds its part of the order, and not in that order.
            assert sorted(ids) == [shard + 3 * i for i in range(bucket * 100, bucket * 100 + 100)]
            rises = sum(a < b for a, b in zip(ids, ids[1:]))
            assert 30 < rises < 70
    again = mixed_shards(frame, shards=3, bucket_slots=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
