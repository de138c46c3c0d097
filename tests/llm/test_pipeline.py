import random
import zlib
from collections import Counter

import corpus_pipeline
from pipewright.llm import language
from pipewright.llm.language import identify
from pipewright.llm.mixing import mixed
from pipewright.llm.queries import OTHER_WEIGHT, WEIGHTS
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.small import awkward, docs

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_each_stage_on_what_the_one_before_kept(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs_ = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    kept = corpus_pipeline.written(stages["language ID"](spark, docs_, FOLDER), "t")
    rejected = {r.doc_id for r in identify(docs_).collect() if r.rejected}
    assert {i for i, _ in rows_of(docs_)} - {i for i, _ in rows_of(kept)} == rejected

    single = corpus_pipeline.written(stages["n-gram Jaccard join"](spark, kept, FOLDER), "t")
    smallest = {g.split(", ")[-1].rstrip(")") for g in groups(rows_of(kept))}
    assert {str(i) for i, _ in rows_of(single)} == smallest

    clean = corpus_pipeline.written(stages["benchmark decontamination"](spark, single, FOLDER), "t")
    before, after = dict(rows_of(single)), dict(rows_of(clean))
    assert all(leaks(items, t, 10)[1] == 0 for t in after.values())
    dirty = {i for i, t in before.items() if leaks(items, t, 10)[1]}
    assert dirty and all(after[i] == t for i, t in before.items() if i not in dirty)
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mix = corpus_pipeline.written(stages["mixing sources to target weights"](spark, clean, FOLDER), "t")
    assert sorted(rows_of(mix)) == sorted(rows_of(clean))
    for frame in (kept, single, clean, mix):
        assert frame.columns == COLUMNS

    shards = stages["sharding"](spark, mix, FOLDER)
    assert sorted(rows_of(shards)) == sorted(rows_of(mix))
    assert shards.columns == [*COLUMNS, "shard", "slot"]


def test_run_returns_the_last_stage(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    slots = {}
    for r in found.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_removal_is_by_row(spark):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, "another text that has no copy at all"), (3, text), *[(None, text + " x")] * 2]
    kept = stage(spark, docs(spark, rows), FOLDER)
    assert sorted(rows_of(kept)) == [(3, text), (5, "another text that has no copy at all")]


def test_awkward_rows_and_no_rows(spark):
    for rows in (awkward(), []):
        frame = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.written(stage(spark, frame, FOLDER), "t")
        frame.collect()


def test_every_shard_follows_the_mix(spark):
    """The slots are those of the mix; without the mixing stage they would be others."""
    stages = dict(corpus_pipeline.STAGES)
    rows = [(i, f"text {i}", "en", "src0" if i % 3 else "src1", 6) for i in range(9_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = corpus_pipeline.written(stages["mixing sources to target weights"](spark, frame.repartition(5), FOLDER), "t")
    found = stages["sharding"](spark, mix, FOLDER).collect()
    position = {r.doc_id: r.position for r in mixed(frame, WEIGHTS, other=OTHER_WEIGHT).collect()}
    # A row has its shard by its place in the mix, and a slot in the bucket that the place falls into.
    assert {r.doc_id: (r.shard, r.slot // 256) for r in found} == {
        i: (p % 24, p // 24 // 256) for i, p in position.items()
    }
    assert sum(r.slot == position[r.doc_id] // 24 for r in found) < 200
    weight = WEIGHTS["src0"] / (WEIGHTS["src0"] + WEIGHTS["src1"])
    for shard in range(24):
        head = [r.source for r in found if r.shard == shard and r.slot < 260]
        assert len(head) == 260 and abs(head.count("src0") - weight * 260) <= 6
    plain = stages["sharding"](spark, corpus_pipeline.written(frame.repartition(5), "t"), FOLDER)
    assert {(r.doc_id, r.shard, r.slot) for r in plain.collect()} != {(r.doc_id, r.shard, r.slot) for r in found}


def test_limits_of_the_language_stage_come_from_all_training_rows(spark, monkeypatch):
    seen = []
    calibrate = language.calibrate

    def counted(model, labelled, lang_col):
        seen.append(labelled.where(labelled[lang_col].isNotNull()).count())
        calibrate(model, labelled, lang_col)

    monkeypatch.setattr(language, "calibrate", counted)
    rows = [(i, f"banana {'abcdefgh'[i % 8]}bandana", "aa", "s", 15) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["language ID"](spark, frame.repartition(4), FOLDER)
    assert kept.columns == COLUMNS and kept.count() == 9000
    assert seen == [frame.where(~language.is_held_out("doc_id")).count()] and seen[0] > 5000


def test_models_of_the_language_stage_come_from_all_rows_with_a_language(spark):
    """A language is known also where every id of its rows is held out elsewhere, or null."""
    rnd = random.Random(7)

    def text(words, n):
        return " ".join(rnd.choices(words.split(), k=n))

    often = "the of and house water under bridge never again small green river stone between"
    rare = "это дом вода под мост никогда снова маленький зелёный река камень между город"
    null = "το σπίτι νερό κάτω από γέφυρα ποτέ ξανά μικρό πράσινο ποτάμι πέτρα ανάμεσα πόλη"
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1][:9]
    rows = [(i, text(often, 40), "en", "s", 0) for i in range(400)]
    rows += [(i, text(rare, 40), "ru", "s", 0) for i in held]
    rows += [(None, text(null, 40), "el", "s", 0) for _ in range(9)]
    rows += [(2000, "日本語の文章です。" * 9, None, "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["language ID"](spark, frame.repartition(4), FOLDER).collect()
    assert Counter(r.lang for r in kept) == {"en": 400, "ru": 9, "el": 9}
    assert {r.doc_id for r in kept if r.lang == "ru"} == set(held)
