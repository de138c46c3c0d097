"""Language ID: interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm.common import append_columns, bound_batches, without, written

ORDER = 4  # 16 bits a symbol: an n-gram is one 64-bit number
CAPACITY = 1 << 22  # log-probabilities in one shard of a model; a larger model has more shards
TAIL = 8.0  # standard deviations beyond which a cross-entropy is rejected
HELD = 4 << 20  # n-grams counted at a time
CHUNK = 1 << 18  # code points scored at a time
UNKNOWN = "und"

ADDED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("runner_up", T.DoubleType()),
        T.StructField("n_symbols", T.LongType()),
    ]
)
_PAD, _SPACE = 1, 32
_U = np.uint64
_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Letters as 16 bits (those beyond the first plane folded), everything else as a space."""
    if not _symbols:
        points = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
        folded = np.where(points < 0x10000, points, 0xE000 + points % 0x1900)
        table = np.where(letter, folded, _SPACE).astype(np.uint64)
        table[0] = _PAD
        _symbols.append(table)
    return _symbols[0]


class Grams(NamedTuple):
    """The n-grams of some texts, each as its last symbol after ORDER - 1 others, and how many each
    text has; a text without a letter has none."""

    keys: np.ndarray
    counts: np.ndarray


def grams(texts: list[str | None]) -> Grams:
    """Texts in lower case, letters only: whatever stands between letters is one space. A text
    starts after pads and ends with a space."""
    parts = [(t or "").replace("\0", " ").lower() for t in texts]
    joined = "".join(f"{chr(0) * (ORDER - 1)} {p} " for p in parts)
    codes = _symbol_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    sizes = np.array([len(p) + ORDER + 1 for p in parts], np.int64)
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    text = np.repeat(np.arange(len(parts)), sizes)[keep]
    codes = codes[keep]
    keys = codes.copy()
    for back in range(1, ORDER):
        keys[back:] |= codes[:-back] << _U(16 * back)
    pads = codes == _PAD
    first = np.zeros(len(codes), bool)
    first[1:] = pads[:-1] & ~pads[1:]
    real = ~pads & ~first
    letters = np.bincount(text[real & (codes != _SPACE)], minlength=len(parts))
    real &= letters[text] > 0
    return Grams(keys[real], np.bincount(text[real], minlength=len(parts)))


def is_held_out(id_col: str) -> Column:
    """A third of all ids, by their checksum, is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _texts_in(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Whole texts, some at a time, and the place of the first."""
    texts, first, size = [], 0, 0
    for i, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= chunk:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, key, n), added up within a task as far as memory allows; texts that are not to be
    learned from have no language."""
    held: dict[str | None, list[np.ndarray]] = {}
    size = 0

    def added_up():
        for lang, keys in held.items():
            distinct, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(distinct.view(np.int64)), pa.array(n)],
                names=["lang", "key", "n"],
            )

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in _texts_in(batch.column(1)):
            own = grams(texts)
            of = np.repeat(np.arange(len(texts)), own.counts)
            names = np.array(langs[first : first + len(texts)], object)
            for lang in set(names):
                keys = own.keys[(names == lang)[of]]
                held.setdefault(lang, []).append(keys)
                size += len(keys)
            if size >= HELD:
                yield from added_up()
                held, size = {}, 0
    yield from added_up()


class Level(NamedTuple):
    """One order as written tables: (key, counts) and (context, totals, types), each a map by the
    number of the language; and the discount of each language."""

    counts: DataFrame
    contexts: DataFrame
    discounts: list[float]


class Shard(NamedTuple):
    """Some n-grams, sorted, with their log-probability in each language."""

    keys: np.ndarray
    log_p: np.ndarray


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Model:
    """All languages together, every n-gram and context in written tables; limits of rejection are
    added by calibration."""

    def __init__(self, spark: SparkSession, langs: list[str], levels: list[Level], vocabulary: int):
        self.spark, self.langs, self.levels = spark, langs, levels
        self.limits: dict[str, tuple[float, float, float, float]] = {}
        self.floor = 1.0 / max(2, vocabulary + 1)

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(key, p) for distinct keys of the highest order: the probability of each key's last symbol
        in each language. Order by order from the lowest, which is even below, keys meet their counts,
        their contexts and the probability without their first symbol."""
        n = len(self.langs)
        lower = None
        for order, level in enumerate(self.levels, 1):
            keys = wanted
            if order < ORDER:
                suffix = F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))
                keys = wanted.select(suffix.alias("key")).distinct()
            keys = keys.withColumn("context", F.shiftrightunsigned("key", 16))
            if lower is None:
                keys = keys.withColumn("lower", F.array_repeat(F.lit(self.floor), n))
            else:
                rest = F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
                below = lower.select(F.col("key").alias("rest"), F.col("p").alias("lower"))
                keys = keys.withColumn("rest", rest).join(below, "rest")
            found = keys.join(level.counts, "key", "left").join(level.contexts, "context", "left")
            d = F.array(*[F.lit(float(x)) for x in level.discounts])

            def p(lang):
                less = F.get(d, lang)
                below = F.get("lower", lang)
                total = F.try_element_at("totals", lang)
                c = F.coalesce(F.try_element_at("counts", lang), F.lit(0))
                types = F.try_element_at("types", lang)
                direct = F.greatest(c - less, F.lit(0.0))
                return F.when(total.isNotNull(), (direct + less * types * below) / total).otherwise(below)

            lower = written(
                found.select("key", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), p).alias("p")), "p"
            )
        return lower

    def shards(self, wanted: DataFrame) -> Iterator[Shard]:
        """The log-probabilities of distinct keys, by a hash of the key in shards of about CAPACITY of
        them, one after the other."""
        logs = F.transform("p", lambda p: F.log(p).cast("float")).alias("log_p")
        # Without a language there are no probabilities.
        if not self.langs:
            return
        found = self.probabilities(wanted)
        n = max(1, ceil(found.count() * len(self.langs) / CAPACITY))
        for i in range(n):
            own = found.where(F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(n)) == i)
            rows = own.select("key", logs).toArrow()
            keys = rows.column("key").to_numpy().view(np.uint64)
            by = np.argsort(keys)
            log_p = rows.column("log_p").combine_chunks().flatten().to_numpy()
            yield Shard(keys[by], log_p.reshape(len(keys), len(self.langs))[by])

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Natural log-probability of each n-gram's last symbol in each language."""
        wanted = self.spark.createDataFrame(pd.DataFrame({"key": np.unique(keys).view(np.int64)}))
        out = np.zeros((len(keys), len(self.langs)))
        for shard in self.shards(wanted):
            at, known = _lookup(shard.keys, keys)
            out[known] = shard.log_p[at[known]]
        return out


def entropies(shards: list[Broadcast], own: Grams, n_langs: int) -> np.ndarray:
    """Mean negative log-probability of each text under each language; 0 without n-grams. Every
    n-gram is in one of the shards; of several, one at a time is held."""
    out = np.zeros((len(own.counts), n_langs))
    text = np.repeat(np.arange(len(own.counts)), own.counts)
    for of in shards:
        shard = of.value
        at, known = _lookup(shard.keys, own.keys)
        at, texts = at[known], text[known]
        for lang in range(n_langs):
            out[:, lang] -= np.bincount(texts, shard.log_p[at, lang], len(out))
        if len(shards) > 1:
            del shard, of._value  # read again from the worker's disk when it is needed
    return out / np.maximum(own.counts, 1)[:, None]


def _predict(shards: list[Broadcast], langs: list[str], at: int):
    def columns(texts: pa.Array):
        names, scores, best, second, sizes = [], [], [], [], []
        for _, part in _texts_in(texts, CHUNK if len(shards) == 1 else 4 * CHUNK):
            own = grams(part)
            some = (own.counts > 0) & bool(langs)
            if langs:
                h = entropies(shards, own, len(langs))
                low = h.argmin(axis=1)
                # Symbols of a text depend on each other, so a long one counts as 32 at most.
                weight = np.exp(-(h - h.min(axis=1, keepdims=True)) * np.minimum(own.counts, 32)[:, None])
                score = 1 / weight.sum(axis=1)
                names += [langs[i] if ok else UNKNOWN for i, ok in zip(low, some)]
                scores.append(np.where(some, score, 0.0))
                ranked = np.sort(h, axis=1)
                best.append(np.where(some, ranked[:, 0], np.nan))
                second.append(np.where(some, ranked[:, min(1, len(langs) - 1)], np.nan))
            else:
                names += [UNKNOWN] * len(part)
                scores.append(np.zeros(len(part)))
                best.append(np.full(len(part), np.nan))
                second.append(np.full(len(part), np.nan))
            sizes.append(own.counts)
        entropy, other = (np.concatenate(v) if v else np.zeros(0) for v in (best, second))
        return [
            pa.array(names, pa.string()),
            pa.array(np.concatenate(scores) if scores else np.zeros(0)),
            pa.array(entropy, mask=np.isnan(entropy)),
            pa.array(other, mask=np.isnan(other)),
            pa.array(np.concatenate(sizes) if sizes else np.zeros(0), pa.int64()),
        ]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, columns(batch.column(at))

    return work


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages from all rows with a language."""
    rows = training.where(F.col(lang_col).isNotNull())
    return _learned(_counted(rows, F.col(lang_col).cast("string"), text_col))


def _counted(docs: DataFrame, lang: Column, text_col: str) -> DataFrame:
    """Written rows (lang, key, c): how often each n-gram of the highest order occurs in each language,
    and in texts without one. Counted within tasks and added up by Spark."""
    bound_batches(docs.sparkSession)
    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    return written(
        rows.mapInArrow(_count, "lang string, key long, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("c")),
        "grams",
    )


def _by_lang(value: str):
    return F.map_from_entries(F.collect_list(F.struct("number", value)))


def _learned(counted: DataFrame) -> Model:
    """Models of all n-grams that have a language. The continuation counts of lower orders and the
    totals of contexts are grouped aggregates of the written counts; all of them are kept, in written
    tables. The driver receives two numbers for each language and order."""
    spark = counted.sparkSession
    level = counted.where(F.col("lang").isNotNull())
    langs = sorted(r.lang for r in level.select("lang").distinct().collect())
    number = spark.createDataFrame(list(enumerate(langs)), "number int, lang string")
    level = level.join(F.broadcast(number), "lang").select("number", "key", "c")
    distinct = level.count()
    levels = []
    for order in range(ORDER, 0, -1):
        once = level.groupBy("number").agg(
            F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")
        )
        found = {i: one / (one + 2 * two) if one else 0.5 for i, one, two in once.collect()}
        above = level.groupBy("number", F.shiftrightunsigned("key", 16).alias("context")).agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("type")
        )
        contexts = above.groupBy("context").agg(
            _by_lang("total").alias("totals"), _by_lang("type").alias("types")
        )
        levels.insert(
            0,
            Level(
                written(level.groupBy("key").agg(_by_lang("c").alias("counts")), "counts", distinct),
                written(contexts, "contexts", distinct),
                [found[i] for i in range(len(langs))],
            ),
        )
        if order > 1:
            lower = F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            level = written(
                level.groupBy("number", lower.alias("key")).agg(F.count(F.lit(1)).alias("c")),
                "grams",
                distinct,
            )
    return Model(spark, langs, levels, levels[0].counts.count())


def calibrate(model: Model, labelled: DataFrame, lang_col: str = "lang") -> None:
    """Sets, per language, what texts known to be in it show: their mean cross-entropy, its variance
    between long texts, the variance that a single symbol adds in short ones, and the mean
    cross-entropy under the next best language, which is what foreign text looks like. A language of
    which no text was recognised gets the means of the others."""
    right = labelled.where((F.col("lang_pred") == F.col(lang_col)) & F.col("entropy").isNotNull())
    weight = F.col("n_symbols")
    centre = right.groupBy("lang_pred").agg(
        (F.sum(F.col("entropy") * weight) / F.sum(weight)).alias("mean"),
        (F.sum(F.col("runner_up") * weight) / F.sum(weight)).alias("foreign"),
    )
    off = (F.col("entropy") - F.col("mean")) ** 2
    long_ = weight >= 256
    spread = (
        right.join(F.broadcast(centre), "lang_pred")  # a row for each language
        .groupBy("lang_pred", "mean", "foreign")
        .agg(
            F.coalesce(F.avg(F.when(long_, off)), F.lit(0.01)).alias("between"),
            F.coalesce(F.avg(F.when(~long_, off * weight)), F.lit(4.0)).alias("within"),
        )
    )
    for lang, mean, foreign, between, within in spread.collect():
        model.limits[lang] = (mean, foreign, between, within)
    if model.limits:
        pooled = tuple(float(x) for x in np.mean(list(model.limits.values()), axis=0))
        for lang in model.langs:
            model.limits.setdefault(lang, pooled)


def rejected(model: Model) -> Column:
    """Whether a prediction's cross-entropy is both far above what its language and length let expect
    and nearer to that of foreign text, or there is no prediction."""
    out = F.col("lang_pred") == UNKNOWN
    for lang, (mean, foreign, between, within) in model.limits.items():
        sd = F.sqrt(F.lit(between) + F.lit(within) / F.col("n_symbols"))
        limit = mean + F.greatest(TAIL * sd, F.lit((foreign - mean) / 2))
        out |= (F.col("lang_pred") == lang) & (F.col("entropy") > limit)
    return F.coalesce(out, F.lit(True))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    calibration_docs: int | None = None, with_text: bool = True, learn_all: bool = False,
) -> DataFrame:
    """All rows with `lang_pred`, `score` (0 to 1), `entropy` (nats a symbol, of the chosen language),
    `runner_up` (of the next best), `n_symbols`, `held_out` and `rejected`.

    The models learn from texts and languages of rows that are not held out (`is_held_out`), all of
    them, and keep every n-gram; a prediction looks at the text alone. The n-grams of all texts are
    given their log-probabilities by joins with the models, and reach executors in shards of a fixed
    size, as many as there are. The language with the lowest cross-entropy per symbol
    wins, ties go to the first by name. `rejected` is set where that cross-entropy is TAIL standard
    deviations above the mean of its language at this length and nearer to that of foreign text, as
    learned from all rows that the models learn from. A caller who wants limits from fewer rows gives
    `calibration_docs`: about so many of each language, by a hash of the id.

    With `learn_all` the models learn from every row with a language, whatever its id, also null;
    limits then come from all of these rows whose ids are not held out.

    Texts are scored once: rows are written with their predictions, from which the limits follow by
    grouped aggregates. `with_text` False leaves the text out of what is written and returned.

    Null texts and texts without a letter are `und`, score 0, rejected; so is every row if there is
    nothing to learn from. Rows with a null id are not learned from without `learn_all`. Repeated rows
    count as often as they occur. Input columns named like the new ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    lang = F.col(lang_col).cast("string")
    fit = F.when(~is_held_out(id_col) & (F.lit(learn_all) | F.col(id_col).isNotNull()), lang)
    counted = _counted(docs, lang if learn_all else fit, text_col)
    model = _learned(counted)
    shards = [context.broadcast(shard) for shard in model.shards(counted.select("key").distinct())]
    langs = model.langs

    rows = without(docs.withColumn("__lang", fit), [f.name for f in ADDED])
    if calibration_docs is not None:
        rows = _drawn(rows, id_col, calibration_docs)
    scored = append_columns(rows, ADDED, _predict(shards, langs, rows.columns.index(text_col)))
    scored = written(scored if with_text else scored.drop(text_col), "predictions")
    calibrate(model, scored, "__lang")
    out = scored.drop("__lang")
    return out.withColumn("held_out", is_held_out(id_col)).withColumn("rejected", rejected(model))


def _drawn(rows: DataFrame, id_col: str, wanted: int) -> DataFrame:
    """The rows with `__lang` kept on about so many of each language, by a hash of the id."""
    counts = rows.where("__lang is not null").groupBy("__lang").count()
    share = (F.least(F.lit(1.0), wanted / F.col("count")) * (1 << 20)).cast("int")
    shares = counts.select(F.col("__lang").alias("__drawn"), share.alias("__share"))
    draw = F.pmod(F.xxhash64(F.lit("calibration"), id_col), F.lit(1 << 20))
    # A row for each language.
    met = rows.join(F.broadcast(shares), F.col("__lang") == F.col("__drawn"), "left")
    return met.withColumn("__lang", F.when(draw < F.col("__share"), F.col("__lang"))).drop(
        "__drawn", "__share"
    )
