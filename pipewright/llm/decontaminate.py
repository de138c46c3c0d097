"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark windows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm.common import append_columns, without, written
from pipewright.llm.fm_index import FMIndex
from pipewright.llm.words import ALNUM, chunks, text_bytes

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
SHARD_BYTES = 4 << 20  # of the texts of one index
BLOCK_BYTES = 32 << 20  # of benchmark texts that one pass sends to the executors

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("cut_text", T.StringType()),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """Distinct windows of benchmark items as symbols, by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        column = pa.array([text for _, text in items], pa.large_string())
        words, counts = [], []
        for chunk in chunks(column, ALNUM):
            words.append(chunk.hashes)
            counts.append(chunk.counts)
        hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        windows: dict[tuple[int, ...], set[str | None]] = {}
        end = 0
        for (item, _), n in zip(items, np.concatenate(counts) if counts else []):
            row, end = symbols[end : end + n] + 1, end + int(n)
            for i in range(max(1, n - window + 1) if n else 0):
                windows.setdefault(tuple(row[i : i + window].tolist()), set()).add(item)
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for length in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == length]
            ids = [sorted(i for i in windows[w] if i is not None) for w in own]
            self.by_length.append((np.array(own, np.int64).reshape(len(own), length), ids))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """Documents in order, reduced to the words that items have; other words between them become
    one break."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.words = 0
        self.counts: list[np.ndarray] = []

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        symbols = self.phrases.symbols(hashes)
        opens = np.zeros(len(symbols) + 1, bool)
        opens[(np.cumsum(counts) - counts)] = True  # the first word of a text follows a break
        known = np.flatnonzero(symbols)
        if len(known):
            after = np.ones(len(known), bool)
            after[1:] = (np.diff(known) > 1) | opens[known[1:]]
            at = np.arange(len(known)) + np.cumsum(after)
            reduced = np.zeros(int(at[-1]) + 1, np.int64)
            origin = np.zeros(len(reduced), np.int64)
            reduced[at], origin[at] = symbols[known], known + self.words
            self.parts.append((reduced, origin))
            self.size += len(reduced)
        self.words += len(hashes)
        self.counts.append(counts)

    def hits(self) -> tuple[np.ndarray, list[set[str]]]:
        """Whether each word is inside an occurrence, and the items found in each document."""
        counts = np.concatenate(self.counts)
        found: list[set[str]] = [set() for _ in counts]
        marks = np.zeros(self.words + 1, np.int64)
        if self.parts:
            symbols = np.concatenate([*(p for p, _ in self.parts), [0]])
            origin = np.concatenate([*(o for _, o in self.parts), [0]])
            index = FMIndex(symbols, len(self.phrases.vocabulary))
            ends = np.cumsum(counts)
            for matrix, items in self.phrases.by_length:
                low, high = index.search(matrix)
                which = np.flatnonzero(high > low)
                sizes = high[which] - low[which]
                heads = np.cumsum(sizes) - sizes
                rows = np.arange(sizes.sum()) - np.repeat(heads - low[which], sizes)
                start = origin[index.locate(rows)]
                np.add.at(marks, start, 1)
                np.add.at(marks, start + matrix.shape[1], -1)
                docs = np.searchsorted(ends, start, "right")
                pairs = np.unique(np.stack([docs, np.repeat(which, sizes)]), axis=1)
                for d, w in pairs.T.tolist():
                    found[d].update(items[w])
        return np.cumsum(marks[:-1]) > 0, found


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def find(phrases: Phrases, texts: pa.Array, before: list | None = None) -> list[tuple]:
    """Per text: its words, the words hit, merged spans in bytes, and the items. `before` has spans
    and items that earlier passes found."""
    shard = Shard(phrases)
    parts = list(chunks(texts, ALNUM))
    for c in parts:
        shard.add(c.hashes, c.counts)
    if not parts:
        return []
    hit, items = shard.hits()
    starts = np.concatenate([c.starts for c in parts])
    ends = np.concatenate([c.ends for c in parts])
    _, at = text_bytes(texts)
    out, end = [], 0
    for i, n in enumerate(np.concatenate(shard.counts).tolist()):
        begin, end = end, end + n
        mask = hit[begin:end]
        for span in before[i][0] if before else ():
            a, b = np.searchsorted(starts[begin:end] - at[i], [span["start"], span["end"]])
            mask[a:b] = True
        spans = []
        if mask.any():
            first, last = _runs(mask)
            spans = list(
                zip((starts[begin + first] - at[i]).tolist(), (ends[begin + last - 1] - at[i]).tolist())
            )
        out.append((n, int(mask.sum()), spans, items[i].union(before[i][1] if before else ())))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans (bytes); a space stays in place of each."""
    raw, kept, at = text.encode(), [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b" ".join([*kept, raw[at:]]).decode()


def _search(phrases_of, at: int, before_at: int | None, cutting: bool, shard_bytes: int):
    def finish(phrases, held):
        texts = pa.concat_arrays([b.column(at).cast(pa.large_string()) for b in held])
        before = None
        if before_at is not None:
            spans, items = (
                [v for b in held for v in b.column(before_at + i).to_pylist()] for i in (0, 1)
            )
            before = list(zip(spans, items))
        found = find(phrases, texts, before)
        clean: list[str | None] = texts.to_pylist() if cutting else [None] * len(found)
        pending = {i: f[2] for i, f in enumerate(found) if cutting and f[2]}
        while pending:  # what a cut brings together is looked at again
            for i, spans in pending.items():
                clean[i] = cut(clean[i], spans)
            again = find(phrases, pa.array([clean[i] for i in pending], pa.large_string()))
            pending = {i: f[2] for i, f in zip(list(pending), again) if f[2]}
        columns = [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in f[2]] for f in found], _SPANS),
            pa.array([sorted(f[3]) for f in found], pa.list_(pa.string())),
            pa.array(clean, pa.string()),
        ]
        start = 0
        for b in held:
            yield b, [c.slice(start, b.num_rows) for c in columns]
            start += b.num_rows

    def work(batches: Iterator[pa.RecordBatch]):
        phrases = phrases_of.value
        held, size = [], 0
        for batch in batches:
            for piece in _pieces(batch, at, shard_bytes):
                held.append(piece)
                size += _bytes(piece.column(at))
                if size >= shard_bytes:
                    yield from finish(phrases, held)
                    held, size = [], 0
        if held:
            yield from finish(phrases, held)

    return work


def _bytes(column: pa.Array) -> int:
    at = text_bytes(column)[1]
    return int(at[-1] - at[0])


def _pieces(batch: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about so many bytes of text."""
    ends = text_bytes(batch.column(at))[1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    cutting: bool = False,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows with `n_words`, `n_hit` (words inside an occurrence of a benchmark window), `spans`
    (merged occurrences as code points, end exclusive), `items` (ids, sorted as strings) and, if
    `cutting`, `cut_text` (the text without them, looked at again until nothing is left).

    Words are letters and digits, A-Z in lower case, anything beyond ASCII counting as a letter. A
    window is `window` consecutive words of an item, or the whole item if it has fewer. Each task
    turns its documents into shards of about `shard_bytes`, builds an FM-index of each,
    searches all windows backwards and locates them by sampled suffixes. Words that no item has
    cannot be part of a window, so between others they become one break. Nothing is shuffled.

    Items reach the executors in blocks of at most `block_bytes` of text (a longer item is a block
    by itself), a pass over the documents for each block; the marks of all passes are merged.

    Null texts have no words; null or wordless items match nothing; items with a null id mark words
    but are not listed; items that share an id count as one. Repeated documents each get their own
    result. Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    rows = without(docs, [f.name for f in ADDED])
    result = rows
    pool, blocks = _pool(benchmark, item_col, item_text_col, block_bytes)
    for block in range(blocks):
        own = pool.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        items = [tuple(r) for r in own.collect()]
        phrases = spark.sparkContext.broadcast(Phrases(items, window))
        before = None
        if block:
            marks = [F.col(c).alias(f"__{c}") for c in ("spans", "items")]
            result = written(result, "marks").select(*rows.columns, *marks)
            before = len(rows.columns)
        work = _search(phrases, rows.columns.index(text_col), before, cutting, shard_bytes)
        result = append_columns(result, ADDED, work)

    def chars(place):
        return F.char_length(F.substring(F.col(text_col).cast("binary"), F.lit(1), place).cast("string"))

    def in_chars(span):
        ends = [chars(span[e].cast("int")).cast("long").alias(e) for e in ("start", "end")]
        return F.struct(*ends)

    return result.select(
        *rows.columns,
        "n_words",
        "n_hit",
        F.transform("spans", in_chars).alias("spans"),
        "items",
        *(["cut_text"] if cutting else []),
    )


def _pool(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> tuple[DataFrame, int]:
    """The items with a text, and the number of blocks of about so many bytes."""
    pool = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    total = pool.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return pool, max(1, ceil(total / size))


def without_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    **options,
) -> DataFrame:
    """The documents with every occurrence of a benchmark window cut from their texts. Documents
    without a word left after a cut go; all others keep their row. Cuts are repeated until no
    window is left: within the tasks, and over all blocks of items if there are several."""
    names = docs.columns
    several = _pool(benchmark, item_col, item_text_col, block_bytes)[1] > 1
    while True:
        marked = decontaminated(
            docs, benchmark, text_col, item_col, item_text_col,
            cutting=True, block_bytes=block_bytes, **options,
        )
        if several:
            marked = written(marked, "cut")
        hit = F.col("n_hit") > 0
        text = F.when(hit, F.col("cut_text")).otherwise(F.col(text_col)).alias(text_col)
        docs = marked.where(~hit | F.col("cut_text").rlike(WORD)).select(
            *[text if c == text_col else F.col(c) for c in names]
        )
        if not several or marked.where(hit).isEmpty():
            return docs
