"""Scoring texts by a hidden Markov language model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.blocks import (
    BATCH_BYTES,
    id_kind,
    nullable_batch,
    numbered_keys,
    residue,
    sums_by,
    text_blocks,
    with_values,
)
from pipewright.llm.common import bound_batches
from pipewright.llm.words import SPACED, chunks, mix, text_bytes
from pipewright.sources.scratch import remove, scratch_path

STATES, ITERATIONS = 8, 4
STAY = 0.95  # share of steps that stay in their state where training starts from
FREQUENT = 1 << 20  # a word is a class of its own if it makes up one of so many tokens
SUFFIXES = 4096  # classes of all other words, by their last three bytes
PRIOR = 100.0  # tokens that the base distribution counts for in each state
TOKENS = 3 << 19  # whose forward and backward values are held at a time
PIECE = 4096  # classes whose counts travel in one row

_U = np.uint64
END = _U(1)  # stands for the end of a text


def packed(values: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """The 32-bit values of each text, compressed: a corpus of them travels and is kept."""
    data, ends = values.astype(np.int32).tobytes(), (np.cumsum(tokens) * 4).tolist()
    return pa.array(
        [pa.compress(data[i:j], codec="zstd", asbytes=True) for i, j in zip([0, *ends], ends)],
        pa.binary(),
    )


def unpacked(column, tokens: np.ndarray) -> list[np.ndarray]:
    return [
        np.frombuffer(pa.decompress(x.as_buffer(), 4 * n, codec="zstd"), np.int32)
        for x, n in zip(column, tokens.tolist())
    ]


class Vocabulary(NamedTuple):
    """Which class a word belongs to. Class 0 are words that were never met in training, then come
    the frequent words (hashes, ascending), then the suffix classes. `totals` are the counts of a
    class's words, one added for each of them."""

    tokens: int
    types: int
    frequent: np.ndarray
    totals: np.ndarray

    def unseen(self) -> float:
        return 1.0 / (self.tokens + self.types + 1)


class Model(NamedTuple):
    """Probabilities of the first state, of each next one, and of each class in each state."""

    start: np.ndarray
    step: np.ndarray
    emission: np.ndarray


class Counts(NamedTuple):
    """What Baum-Welch expects of some texts: first states, steps, and classes by state."""

    start: np.ndarray
    step: np.ndarray
    classes: np.ndarray
    log10: float


def suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix class of each word, from its last three bytes in lower case."""
    code = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        own = at >= starts
        code[own] |= SPACED[data[at[own]]].astype(np.uint64) << _U(8 * back)
    return (mix(code) % _U(SUFFIXES)).astype(np.int32)


def _scan(id_type: pa.DataType):
    """Rows of documents (block, id, held, tokens, codes) and rows (block, number, word, suffix, n) of
    the words of a block, with what training documents hold of them."""
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("id", id_type),
            ("held", pa.bool_()),
            ("tokens", pa.int64()),
            ("codes", pa.binary()),
            ("number", pa.int32()),
            ("word", pa.int64()),
            ("suffix", pa.int32()),
            ("n", pa.int64()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in text_blocks(batches, "text"):
            ids, texts, held = (rows.pop(c) for c in ("id", "text", "held"))
            data, _ = text_bytes(texts)
            words, kinds, counts = [], [], []
            for part in chunks(texts, SPACED):
                words.append(part.hashes)
                kinds.append(suffixes(data, part.starts, part.ends))
                counts.append(part.counts)
            tokens = np.concatenate(counts) + 1
            ended = np.zeros(int(tokens.sum()), bool)
            ended[np.cumsum(tokens) - 1] = True
            all_words, suffix = np.full(len(ended), END), np.zeros(len(ended), np.int32)
            all_words[~ended], suffix[~ended] = np.concatenate(words), np.concatenate(kinds)
            del words, kinds, ended, texts, data
            known, first, code = numbered_keys(all_words)
            del all_words
            trained = np.repeat(~held.to_numpy(zero_copy_only=False), tokens)
            n = np.bincount(code, weights=trained, minlength=len(known)).astype(np.int64)
            # Frequent words get small numbers, which take little room on their way.
            order = np.argsort(-np.bincount(code, minlength=len(known)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            yield nullable_batch(
                [
                    {
                        "block": pa.array(np.full(len(ids), block)),
                        "id": ids,
                        "held": held,
                        "tokens": pa.array(tokens),
                        "codes": packed(rank[code], tokens),
                    },
                    {
                        "block": pa.array(np.full(len(order), block)),
                        "number": pa.array(np.arange(len(order), dtype=np.int32)),
                        "word": pa.array(known[order].view(np.int64)),
                        "suffix": pa.array(suffix[first][order]),
                        "n": pa.array(n[order]),
                    },
                ],
                schema,
            )

    return work


def _coded(vocabulary):
    """Rows of a block with classes instead of numbers, and what does not depend on states: known
    tokens, the base score, and the score of words within their classes."""

    def work(rows: pa.Table, values: pa.Table) -> pa.Table:
        v = vocabulary.value
        number, value, word = (values.column(c).to_numpy() for c in ("number", "value", "word"))
        by = np.argsort(number)
        value, word = value[by], word[by].astype(np.int64)
        count, suffix = value // SUFFIXES, value % SUFFIXES
        # Only the words of classes of their own come with their hashes.
        frequent = np.searchsorted(v.frequent, word.view(np.uint64))
        kind = np.where(word != 0, 1 + frequent, 1 + len(v.frequent) + suffix)
        kind = np.where(count > 0, kind, 0).astype(np.int32)
        base = np.log10((count + 1) * v.unseen())
        within = np.zeros(len(count))
        known = count > 0
        within[known] = np.log10((count[known] + 1) / v.totals[kind[known]])
        # Texts of like lengths side by side make short work of the recursions.
        tokens = rows.column("tokens").to_numpy()
        order = np.argsort(-tokens, kind="stable")
        rows, tokens = rows.take(pa.array(order)), tokens[order]
        flat = np.concatenate(unpacked(rows.column("codes"), tokens))
        return pa.table(
            [
                rows.column("id"),
                rows.column("held"),
                rows.column("tokens"),
                sums_by(known[flat].astype(np.int64), tokens),
                sums_by(base[flat], tokens),
                sums_by(within[flat], tokens),
                packed(kind[flat], tokens),
            ],
            names=["id", "held", "tokens", "known", "base", "within", "classes"],
        )

    return work


class Sequences(NamedTuple):
    """Texts side by side, longest first: the tokens of all texts at one place follow each other.
    `order` has the texts, `active` how many reach each place, `heads` where a place begins."""

    order: np.ndarray
    active: np.ndarray
    heads: np.ndarray
    text: np.ndarray
    classes: np.ndarray


def side_by_side(texts: list[np.ndarray]) -> Sequences:
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    heads = np.cumsum(active) - active
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    at = heads[place] + text
    classes, owner = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
    classes[at] = np.concatenate([texts[i] for i in order])
    owner[at] = text
    return Sequences(order, active, heads, owner, classes)


def forward(s: Sequences, model: Model, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities given the text so far, for every token, and the scale of each token: the
    product of a text's scales is its likelihood."""
    emission, step = model.emission.astype(kind), model.step.astype(kind)
    alpha = np.empty((len(s.classes), step.shape[0]), kind)
    scale = np.empty(len(s.classes), kind)
    now = None
    for m, head in zip(s.active.tolist(), s.heads.tolist()):
        seen = emission[s.classes[head : head + m]]
        now = seen * (model.start.astype(kind) if now is None else now[:m] @ step)
        c = now.sum(axis=1)
        now /= c[:, None]
        alpha[head : head + m] = now
        scale[head : head + m] = c
    return alpha, scale


def likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each sequence of classes, by the scaled forward recursion."""
    s = side_by_side(texts)
    _, scale = forward(s, model)
    out = np.empty(len(texts))
    out[s.order] = np.bincount(s.text, weights=np.log10(scale), minlength=len(texts))
    return out


def expected(texts: list[np.ndarray], model: Model) -> Counts:
    """Baum-Welch counts of some texts: forward, then backward under the same scales."""
    s, kind = side_by_side(texts), np.float32
    alpha, scale = forward(s, model, kind)
    log10 = float(np.log10(scale.astype(np.float64)).sum())
    emission, step = model.emission.astype(kind), model.step.astype(kind)
    states = len(model.start)
    back = np.ascontiguousarray(step.T)
    steps = np.zeros((states, states))
    beta = np.ones((int(s.active[0]), states), kind)
    for t in range(len(s.active) - 1, 0, -1):
        m, head, before = int(s.active[t]), int(s.heads[t]), int(s.heads[t - 1])
        own = slice(head, head + m)
        ahead = emission[s.classes[own]] * beta[:m] / scale[own][:, None]
        alpha[own] *= beta[:m]
        steps += alpha[before : before + m].T @ ahead
        beta[:m] = ahead @ back
    first = slice(0, int(s.active[0]))
    alpha[first] *= beta
    classes = np.stack(
        [np.bincount(s.classes, weights=alpha[:, k], minlength=len(emission)) for k in range(states)], 1
    )
    return Counts(alpha[first].sum(axis=0, dtype=np.float64), steps * model.step, classes, log10)


def maximised(counts: Counts, v: Vocabulary) -> Model:
    """The model that the counts make most likely; each state's classes start from PRIOR tokens of
    the base distribution. The never met words keep the base probability in every state."""
    states = len(counts.start)
    start = counts.start + 1.0 / states
    step = counts.step + 1.0 / states
    met = counts.classes.copy()
    met[0] = 0
    base = v.totals / max(v.totals.sum(), 1.0)
    emission = (met + PRIOR * base[:, None]) / (met.sum(axis=0) + PRIOR)
    emission *= 1.0 - v.unseen()
    emission[0] = v.unseen()
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emission)


def first_model(v: Vocabulary, states: int, seed: int) -> Model:
    """States that keep to themselves and tell classes apart at random."""
    noise = np.random.default_rng(seed).uniform(0.5, 1.5, (len(v.totals), states))
    step = STAY * np.eye(states) + (1 - STAY) / states
    counts = Counts(np.ones(states), step * 1e6, v.totals[:, None] * noise, 0.0)
    return maximised(counts, v)


def _groups(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for text in unpacked(batch.column("classes"), batch.column("tokens").to_numpy()):
            held.append(text)
            size += len(text)
            if size >= tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows_of(counts: Counts) -> pa.RecordBatch:
    """Counts as rows (piece, sums); piece -1 holds all but the classes."""
    rest = np.concatenate([counts.start, counts.step.ravel(), [counts.log10]])
    pieces, sums = [-1], [rest.tobytes()]
    for i in range(0, len(counts.classes), PIECE):
        if (own := counts.classes[i : i + PIECE]).any():
            pieces.append(i // PIECE)
            sums.append(own.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(pieces, pa.int32()), pa.array(sums, pa.binary())], names=["piece", "sums"]
    )


def _expectations(model, tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for texts in _groups(batches, tokens):
            own = expected(texts, model.value)
            total = own if total is None else Counts(*[a + b for a, b in zip(total, own)])
        if total is not None:
            yield _rows_of(total)

    return work


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in rows.column("sums").to_pylist())
    return pa.table([rows.column("piece").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["piece", "sums"])


def _gathered(rows, classes: int, states: int) -> Counts:
    """The sum over all tasks; its size follows from FREQUENT, SUFFIXES and the states."""
    found = {r.piece: np.frombuffer(bytes(r.sums)) for r in rows}
    rest = found.get(-1, np.zeros(states + states * states + 1))
    table = np.zeros((classes, states))
    for piece, sums in found.items():
        if piece >= 0:
            table[piece * PIECE : (piece + 1) * PIECE] = sums.reshape(-1, states)
    return Counts(rest[:states], rest[states:-1].reshape(states, states), table, float(rest[-1]))


def _scored(model, tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpacked(batch.column("classes"), batch.column("tokens").to_numpy())
            out, low, size = [np.zeros(0)], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= tokens or i == len(texts) - 1:
                    out.append(likelihoods(texts[low : i + 1], model.value))
                    low, size = i + 1, 0
            kept = [batch.column(c) for c in ("id", "held", "tokens", "known", "base")]
            score = np.concatenate(out) + batch.column("within").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(score)], names=["id", "held", "tokens", "known", "base", "score"]
            )

    return work


def coded_texts(docs: DataFrame, held_out: Column, id_col: str, text_col: str):
    """Documents (id, held, tokens, known, base, within, classes), and the vocabulary of those not
    held out."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES)
    kind, arrow_id = id_kind(docs, id_col)
    rows = docs.select(
        F.col(id_col).cast(kind).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
    )
    scanned, tokens_path = _kept(
        rows.mapInArrow(
            _scan(arrow_id),
            f"block long, id {kind}, held boolean, tokens long, codes binary, number int, word long,"
            " suffix int, n long",
        ),
        "tokens",
    )
    words = scanned.where("number is not null").select("block", "number", "word", "suffix", "n")
    tokens = words.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("count") >= max(1, -(-tokens // FREQUENT))
    same = Window.partitionBy("word")
    counted, words_path = _kept(
        words.select(
            "block",
            "number",
            "word",
            "suffix",
            F.sum("n").over(same).alias("count"),
            (F.row_number().over(same.orderBy("block")) == 1).alias("head"),
        ).select(
            "block",
            "number",
            (F.col("count") * SUFFIXES + F.col("suffix")).alias("value"),
            "head",
            F.when(frequent, F.col("word")).otherwise(0).alias("word"),
        ),
        "words",
    )
    count, suffix = F.expr(f"value div {SUFFIXES}"), (F.col("value") % SUFFIXES).cast("int")
    heads = counted.where(F.col("head") & (F.col("value") >= SUFFIXES))
    types = heads.count()
    common = heads.where("word <> 0").select("word", count.alias("count")).toArrow()
    rare = heads.where("word = 0").groupBy(suffix).agg(F.sum(count + 1)).collect()
    hashes, counts = common.column("word").to_numpy().view(np.uint64), common.column("count").to_numpy()
    by = np.argsort(hashes)
    totals = np.zeros(1 + len(hashes) + SUFFIXES)
    totals[1 : 1 + len(hashes)] = counts[by] + 1
    for suffix, total in rare:
        totals[1 + len(hashes) + suffix] = total
    v = Vocabulary(tokens, types, hashes[by], totals)
    coded = with_values(
        scanned.where("number is null").select("block", "id", "held", "tokens", "codes"),
        counted.select("block", "number", "value", "word"),
        _coded(spark.sparkContext.broadcast(v)),
        f"id {kind}, held boolean, tokens long, known long, base double, within double, classes binary",
    )
    coded, _ = _kept(coded, "coded")
    # What the classes were made from is read no more.
    for path in (tokens_path, words_path):
        remove(spark, path)
    return coded, v


def _kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The frame written to the shared folder, and where."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def trained(
    coded: DataFrame,
    v: Vocabulary,
    states: int = STATES,
    iterations: int = ITERATIONS,
    seed: int = 12,
) -> tuple[Model, list[float]]:
    """The model after some iterations of Baum-Welch over all training texts, and log10 of their
    likelihood before each iteration.

    It starts from the counts of all words and a random share of each state in every class; every
    count of every iteration is a sum over all training texts.
    """
    spark = coded.sparkSession
    texts = coded.where("not held").select("tokens", "classes")
    shape = (len(v.totals), states)
    model = first_model(v, states, seed)
    course = []
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(model)
        sums = texts.mapInArrow(_expectations(sent, TOKENS), "piece int, sums binary")
        added = sums.groupBy("piece").applyInArrow(_added, "piece int, sums binary").collect()
        counts = _gathered(added, *shape)
        course.append(counts.log10)
        model = maximised(counts, v)
        sent.unpersist()
    return model, course


def score_texts(
    docs: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    iterations: int = ITERATIONS,
    seed: int = 12,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row: log10 of the
    probability of its text under unigrams with one added, and under a hidden Markov model.

    Tokens are the words between white space, A-Z as a-z, and one end. Both models give
    probabilities to the words met in training and to one place for all others; that place has the
    base probability in every state. A state emits a class of words: a word that makes up a millionth
    (2^-20) of all tokens is a class of its own, all others share the classes of their last three
    bytes, and a word has its part of a class by its count. So the tables of a model have a bound,
    while every count of every word takes part.

    Tokens of a block of texts are numbered; the block's words meet the counts of all blocks by one
    shuffle and return to it by another. Baum-Welch then runs over classes where they are: tasks
    send sums by class and state, which are added up. Scaled forward recursion gives the likelihood
    of whole texts; a text needs about 40 bytes a token in a task.

    `held_out` tells rows that take no part in training; null counts as not held out. A null or
    empty text is its end. Rows that repeat an id or a text count each. Without training rows every
    token has probability 1. No rows give no rows. Words are known by 64 bits.
    """
    if held_out is None:
        held_out = residue(id_col, 7) == 2
    coded, v = coded_texts(docs, held_out, id_col, text_col)
    model, _ = trained(coded, v, states, iterations, seed)
    kind = dict(coded.dtypes)["id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return (
        coded.mapInArrow(
            _scored(sent, TOKENS),
            f"id {kind}, held boolean, tokens long, known long, base double, score double",
        )
        .select(
            F.col("id").alias(id_col),
            F.col("held").alias("held_out"),
            F.col("tokens").alias("n_tokens"),
            F.col("known").alias("n_known"),
            F.lit(v.tokens).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"),
            "score",
        )
    )
