import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pipewright.llm import language, queries
from pipewright.llm.language import Grams, grams, identify, learn
from tests.llm.small import awkward, docs

ORDER = language.ORDER


def symbols(text):
    """Pads, then letters with single spaces between, then a space; and where scoring starts."""
    out = []
    for c in f" {text.lower()} ":
        c = c if c.isalpha() else " "
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return ["^"] * (ORDER - 1) + out if any(c != " " for c in out) else []


def windows(text):
    s = symbols(text)
    return [tuple(s[i - ORDER + 1 : i + 1]) for i in range(ORDER, len(s))]


def kneser_ney(texts, vocabulary):
    """Interpolated Kneser-Ney as the formula has it, for one language."""
    level = Counter(w for t in texts for w in windows(t))
    levels = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        level = Counter(g[1:] for g in level)
        levels[n] = level
    discount, total, types = {}, {}, {}
    for n, counts in levels.items():
        by = Counter(counts.values())
        discount[n] = by[1] / (by[1] + 2 * by[2]) if by[1] else 0.5
        total[n], types[n] = defaultdict(int), defaultdict(int)
        for g, c in counts.items():
            total[n][g[:-1]] += c
            types[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / vocabulary
        context = gram[:-1]
        if not total[n][context]:
            return p(gram[1:])
        d = discount[n]
        direct = max(levels[n][gram] - d, 0) / total[n][context]
        return direct + d * types[n][context] / total[n][context] * p(gram[1:])

    return p, {g[0] for g in levels[1]}


def test_model_is_interpolated_kneser_ney(spark):
    texts = {
        "aa": ["Banana bandana, cabana!", "ananas banana", "abba"],
        "bb": ["xylo zylo xy", "zz top xylo", "öl Öl zyx"],
    }
    rows = [(t, lang) for lang, own in texts.items() for t in own]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["aa", "bb"]
    plain = {lang: kneser_ney(own, 1) for lang, own in texts.items()}
    vocabulary = len(set().union(*(v for _, v in plain.values()))) + 1
    exact = {lang: kneser_ney(own, vocabulary)[0] for lang, own in texts.items()}
    for text in ("banana", "xylophone", "Öl ana", "quite other words 日本"):
        own = grams([text])
        found = model.log_p(own.keys)
        for row, window in zip(found, windows(text), strict=True):
            for value, lang in zip(row, model.langs):
                assert value == pytest.approx(math.log(exact[lang](window)), abs=1e-4)


def test_probabilities_of_a_context_add_up_to_one(spark):
    rows = [("abc abd abe acd bca", "x")]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    own = grams(["abc"]).keys
    letters = np.array([ord(c) for c in "abcde "] + [0x4E00], np.uint64)
    for key in own:
        keys = (key >> np.uint64(16) << np.uint64(16)) | letters
        assert np.exp(model.log_p(keys)).sum() == pytest.approx(1, abs=1e-3)


def test_grams_of_awkward_texts():
    own = grams([None, "", "1 2 3", "a", " a ", "É1é", "\0a\0", "😀"])
    assert isinstance(own, Grams)
    assert own.counts.tolist() == [0, 0, 0, 2, 2, 4, 2, 0]


def test_held_out_accuracy_and_columns(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, folder).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.99
    assert sum(r.rejected for r in rows) <= 2


def test_foreign_text_is_rejected_and_mixed_text_is_not(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {r.lang: r.text for r in frame.collect() if len(r.text) > 1500}
    foreign = "Прочие условия договора были согласованы сторонами заранее. " * 20
    half = known["en"][:1200] + known["fr"][:500]
    more = spark.createDataFrame(
        [(-1, foreign, None, "s", 0), (-2, half, None, "s", 0), (-3, "日本語の文章です。" * 9, None, "s", 0)],
        frame.schema,
    )
    found = {r.doc_id: r for r in identify(frame.union(more)).collect() if r.doc_id < 0}
    assert found[-1].rejected and found[-3].rejected and not found[-2].rejected
    assert found[-2].lang_pred == "en"


def test_awkward_rows_and_nothing_to_learn(spark):
    rows = identify(docs(spark, awkward(), "SCORE lang_PRED")).collect()
    assert len(rows) == len(awkward())
    assert {r.lang_pred for r in rows if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert all(r.lang_pred in ("en", "de") for r in rows if any(c.isalpha() for c in r.text or ""))
    assert identify(docs(spark, [])).collect() == []
    (row,) = identify(docs(spark, [(None, "some text")])).collect()
    assert (row.lang_pred, row.score, row.rejected, row.held_out) == ("und", 0.0, True, False)


def test_small_shards_change_nothing(spark, monkeypatch):
    """Also where one language has most rows, no n-gram of another one is left out."""
    rows = [(i, f"banana bandana {'abcdefgh'[i % 8]}{'xyz'[i % 3]} cabana ananas", "aa", "s", 0) for i in range(60)]
    rows += [(100 + i, f"xylo zylo xy {'öüä'[i % 3]}zz top", "bb", "s", 0) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def found():
        fields = "doc_id", "lang_pred", "entropy", "runner_up", "rejected"
        return sorted((tuple(r[f] for f in fields) for r in identify(frame).collect()))

    whole = found()
    assert {(i >= 100, lang) for i, lang, *_ in whole} == {(False, "aa"), (True, "bb")}
    monkeypatch.setattr(language, "CAPACITY", 16)
    for a, b in zip(whole, found(), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6)


def test_probabilities_add_up_to_one_in_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "CAPACITY", 4)
    rows = [("abc abd abe acd bca " * 9, "x"), ("edc eca", "y")]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    letters = np.array([ord(c) for c in "abcde "] + [0x4E00], np.uint64)
    keys = (grams(["ec"]).keys[:, None] >> np.uint64(16) << np.uint64(16)) | letters
    sums = np.exp(model.log_p(keys.ravel())).reshape(*keys.shape, 2).sum(axis=1)
    assert sums == pytest.approx(np.ones_like(sums), abs=1e-3)


def test_a_rare_language_has_limits_and_short_foreign_texts_are_rejected(spark):
    """Limits come from a sample within each language, however many rows the others have."""
    rnd = np.random.default_rng(5)

    def text(words, n):
        return " ".join(rnd.choice(words.split(), n))

    often = "the of and house water under bridge never again small green river stone between"
    rare = "это дом вода под мост никогда снова маленький зелёный река камень между город"
    rows = [(i, text(often, 40), "en") for i in range(400)] + [(1000 + i, text(rare, 40), "ru") for i in range(9)]
    rows += [(2000, "щъщ ыфй ъэюх жщщ фхц ыыъ " * 4, None), (2001, "日本語の文章", None)]
    rows += [(2002, "щъщыф ъэюхжщ", None), (2003, text(rare, 3), None), (2004, text(often, 3), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in identify(frame, calibration_docs=20).collect()}
    assert found[2000].lang_pred == found[2002].lang_pred == "ru"
    assert [i for i, r in sorted(found.items()) if r.rejected] == [2000, 2001, 2002]


def test_a_language_without_recognised_texts_gets_pooled_limits(spark):
    rows = [("abc abd", "x"), ("xyz zyx", "y"), ("ööö", "z")]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    judged = [("x", "x", 1.0, 5.0, 9), ("y", "y", 2.0, 7.0, 9), ("x", "z", 4.0, 6.0, 9)]
    fields = "lang_pred string, lang string, entropy double, runner_up double, n_symbols long"
    language.calibrate(model, spark.createDataFrame(judged, fields))
    assert set(model.limits) == {"x", "y", "z"}
    assert model.limits["z"][:2] == (1.5, 6.0)


def test_limits_come_from_all_training_rows(spark, monkeypatch):
    """A few odd texts among thousands move the limits, wherever they stand."""
    models = []
    calibrate = language.calibrate
    monkeypatch.setattr(language, "calibrate", lambda model, *rest: (models.append(model), calibrate(model, *rest)))
    rows = [(i, f"banana {'abcdefgh'[i % 8]}bandana {'xyz' * (i % 5)}", "aa") for i in range(9000)]
    rows += [(10_000 + i, f"xylo zy{'öüä'[i % 3]}lo", "bb") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = identify(frame).where("not held_out").collect()
    assert sum(r.lang == "aa" for r in found) > 5000
    for lang in ("aa", "bb"):
        own = [r for r in found if r.lang == r.lang_pred == lang]
        symbols_ = sum(r.n_symbols for r in own)
        mean = sum(r.entropy * r.n_symbols for r in own) / symbols_
        foreign = sum(r.runner_up * r.n_symbols for r in own) / symbols_
        within = sum((r.entropy - mean) ** 2 * r.n_symbols for r in own) / len(own)
        assert models[0].limits[lang] == pytest.approx((mean, foreign, 0.01, within), rel=1e-9)


def test_the_text_can_be_left_out(spark):
    frame = spark.createDataFrame([(i, "abc abd", "x") for i in range(9)], "doc_id long, text string, lang string")
    whole, bare = identify(frame), identify(frame, with_text=False)
    assert bare.columns == whole.drop("text").columns
    assert sorted(bare.collect()) == sorted(whole.drop("text").collect())
