import hashlib
import random
import re

import numpy as np
import pytest

from pipewright.llm.decontaminate import cut, decontaminated, without_benchmark
from pipewright.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from tests.llm.small import LOWER, awkward, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(items, text, window):
    own = words(text)
    hit, found = [False] * len(own), set()
    for item, phrase in items:
        w = words(phrase)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for p in range(len(own) - len(part) + 1):
                if own[p : p + len(part)] == part:
                    found.add(item)
                    hit[p : p + len(part)] = [True] * len(part)
    return len(own), sum(hit), sorted(str(i) for i in found if i is not None)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    rnd = np.random.default_rng(seed)
    largest = int(rnd.integers(1, 9))
    symbols = np.append(rnd.integers(0, largest + 1, 400), 0)
    symbols[50:150] = symbols[200:300]
    order = suffix_array(symbols)
    unique = [(-1, i) if s == 0 else (s, 0) for i, s in enumerate(symbols.tolist())]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: unique[i:])
    wavelet = WaveletMatrix(symbols, largest)
    every = np.arange(len(symbols) + 1)
    for s in range(largest + 1):
        expected = np.concatenate([[0], np.cumsum(symbols == s)])
        assert (wavelet.rank(np.full(len(every), s), every) == expected).all()
    for step in (1, 3, 16):
        index = FMIndex(symbols, largest, step)
        for length in (1, 2, 4):
            phrases = rnd.integers(1, largest + 1, (30, length))
            for phrase, low, high in zip(phrases.tolist(), *index.search(phrases)):
                expected = [
                    i for i in range(len(symbols) - length) if symbols[i : i + length].tolist() == phrase
                ]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == expected


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 100}, {"block_bytes": 60}])
def test_against_brute_force(spark, options):
    rnd = random.Random(5)
    vocabulary = ["Ab", "c", "É", "d9", "zz", "ß", "x", "w1", "w2"]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 5, 8, 12])] + [(3, text(4)), (None, text(4))]
    items += [(99, None), (98, "--")]
    rows = [(i, text(rnd.choice([0, 1, 5, 60])) + rnd.choice(["", ". "])) for i in range(40)] + awkward()
    frame = docs(spark, rows, "SPANS n_hit")
    found = decontaminated(frame, bench(spark, items), window=3, **options).collect()
    got = sorted(str((r.doc_id, r.text, r.n_words, r.n_hit, r["items"])) for r in found)
    expected = sorted(str((i, t, *brute(items, t, 3))) for i, t in rows)
    assert got == expected
    for r in found:
        covered = [w for s in r.spans for w in words(r.text[s.start : s.end])]
        assert len(covered) == r.n_hit


def test_empty_tables(spark):
    none = bench(spark, [])
    assert [r.n_hit for r in decontaminated(docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontaminated(docs(spark, []), bench(spark, [(1, "a b")])).collect() == []


def test_spans_are_code_points_and_cut():
    assert cut("é one two ß three", [(3, 10)]) == "é   ß three"


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20}])
def test_cuts_leave_no_window(spark, options):
    items = [(1, "a b c d e"), (2, "v w x y z")]
    rows = [
        (1, "keep a b c d e this"),
        (2, "A, b, c, d, e."),
        (3, "a b a b c d e c d e tail"),
        (4, "v w v w a b c d e x y z x y z end"),
        (5, "clean text"),
        (6, None),
        (7, ""),
    ]
    left = {r.doc_id: r.text for r in without_benchmark(docs(spark, rows), bench(spark, items), **options).collect()}
    assert set(left) == {1, 3, 4, 5, 6, 7}
    assert words(left[1]) == ["keep", "this"] and words(left[3]) == ["tail"] and words(left[4]) == ["end"]
    assert left[5] == "clean text" and left[6] is None and left[7] == ""


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
