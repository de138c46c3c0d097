"""The hidden Markov model against sums over all paths, and its queries' counts against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipewright.llm import hmm
from tests.llm.small import LOWER, awkward, docs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def model():
    rnd = np.random.default_rng(3)
    draw = lambda *shape: (x := rnd.uniform(0.1, 1, shape)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(draw(3), draw(3, 3), draw(3, 6).T)


TEXTS = [np.array(t, np.int32) for t in ([2, 5, 0, 1], [4], [1, 1, 3], [5, 2])]


def paths(text, model):
    """(probability, states) of every path."""
    for states in itertools.product(range(3), repeat=len(text)):
        p = model.start[states[0]]
        for a, b in zip(states, states[1:]):
            p *= model.step[a, b]
        yield p * math.prod(model.emission[w, s] for w, s in zip(text, states)), states


def test_likelihood_is_the_sum_over_all_paths(model):
    want = [math.log10(sum(p for p, _ in paths(t, model))) for t in TEXTS]
    assert np.allclose(hmm.likelihoods(TEXTS, model), want, rtol=0, atol=1e-12)


def test_likelihoods_of_a_length_add_up_to_one(model):
    all_texts = [np.array(t, np.int32) for t in itertools.product(range(6), repeat=3)]
    assert math.isclose((10 ** hmm.likelihoods(all_texts, model)).sum(), 1, rel_tol=1e-12)


def test_expected_counts(model):
    start, step, classes = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for text in TEXTS:
        total = sum(p for p, _ in paths(text, model))
        for p, states in paths(text, model):
            start[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                step[a, b] += p / total
            for w, s in zip(text, states):
                classes[w, s] += p / total
    found = hmm.expected(TEXTS, model)
    for got, want in zip(found, (start, step, classes)):
        assert np.allclose(got, want, atol=1e-5)


def test_long_texts_do_not_underflow(model):
    text = np.random.default_rng(1).integers(0, 6, 50_000).astype(np.int32)
    halves = hmm.likelihoods([text, text[:25_000]], model)
    assert np.isfinite(halves).all() and halves[0] < halves[1] < 0


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def brute(rows):
    train = [words_of(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for words in train for w in words)
    n, v = count.total(), len(count)
    out = []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(words), sum(w in count for w in words), n, round(base, 6) + 0.0))
    return sorted(map(str, out))


def base_part(frame):
    found = hmm.score_texts(frame)
    assert found.columns == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    ]
    rows = found.collect()
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in rows)
    return sorted(str((*r[:5], round(r.base_score, 6) + 0.0)) for r in rows)


@pytest.mark.parametrize("rows", [awkward(), [], [(3, None)], [(i, "Same words") for i in range(30)]])
def test_base_scores(spark, rows):
    assert base_part(docs(spark, rows, extra="block word held")) == brute(rows)


def test_given_tables(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert base_part(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])


def test_nothing_to_learn_from(spark):
    rows = hmm.score_texts(docs(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in rows} == {(0, 0, 0.0, 0.0)}


def test_words_of_a_state_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 50)  # so that most words share classes
    frame = docs(spark, [(i, f"the cat sat on mat{i} and {'the ' * (i % 4)}") for i in range(80)])
    coded, v = hmm.coded_texts(frame, F.lit(False), "doc_id", "text")
    assert 0 < len(v.frequent) < 12
    m, _ = hmm.trained(coded, v, states=3, iterations=2)
    assert np.allclose(m.emission.sum(axis=0), 1) and np.allclose(m.step.sum(axis=1), 1)
    # All words of a class together: one over the class, so the sum over words is the sum over classes.
    count = Counter(w for i in range(80) for w in words_of(f"the cat sat on mat{i} and {'the ' * (i % 4)}"))
    assert v.tokens == count.total() and v.types == len(count)
    assert v.totals.sum() == count.total() + len(count)


def test_training_is_the_same_for_any_partitions(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = []
    for n in (1, 7):
        found = hmm.score_texts(frame.repartition(n), states=4, iterations=2).collect()
        scores.append({r.doc_id: r.score for r in found})
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-4) for i in scores[0])


def test_each_iteration_makes_the_texts_more_likely(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    coded, v = hmm.coded_texts(frame, hmm.residue("doc_id", 7) == 2, "doc_id", "text")
    _, course = hmm.trained(coded, v, iterations=4)
    assert all(b > a for a, b in zip(course, course[1:]))


def test_held_out_texts_are_likelier_than_under_unigrams(spark):
    found = hmm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = found.where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))
    )
    score, base, tokens, better = held.first()
    assert (score - base) / tokens > 0.2 and better > 0.95


def test_every_count_is_a_sum_over_all_training_texts(spark):
    """From the first iteration on: nothing but the texts together decides where training goes."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    coded, v = hmm.coded_texts(frame, hmm.residue("doc_id", 7) == 2, "doc_id", "text")
    rows = coded.where("not held").orderBy("id").toArrow()
    texts = hmm.unpacked(rows.column("classes").combine_chunks(), rows.column("tokens").to_numpy())
    model, course = hmm.first_model(v, 3, 12), []
    for _ in range(2):
        counts = hmm.expected(texts, model)
        course.append(counts.log10)
        model = hmm.maximised(counts, v)
    found, likelihoods = hmm.trained(coded, v, states=3, iterations=2)
    assert np.allclose(likelihoods, course, rtol=1e-5)
    assert np.allclose(found.emission, model.emission, rtol=0.01, atol=1e-6)
    assert np.allclose(found.step, model.step, atol=1e-3)
