"""Alignment of two tokenizers: a byte-level one and one of pieces with byte fallback."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipewright.llm.blocks import (
    BATCH_BYTES,
    id_kind,
    nullable_batch,
    numbered_keys,
    ragged,
    span_hashes,
    sums_by,
    text_blocks,
    with_values,
)
from pipewright.llm.common import bound_batches, written
from pipewright.llm.words import text_bytes

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
JOINED_BYTES = 64 << 10  # of spans that are encoded in one call
SPANS_AT_ONCE = 1 << 17  # of documents whose links are counted together
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"  # how a piece writes a space


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, all others from code point 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tools(NamedTuple):
    """Both tokenizers, the bytes and printed forms of their tokens, and whether texts may be cut
    before a space that follows a character other than white space."""

    a: Tokenizer
    b: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    parts: bool


@lru_cache(maxsize=1)
def tools(byte_level: bytes, pieces: bytes) -> Tools:
    a = Tokenizer.from_str(byte_level.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    letters = byte_alphabet()
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        known = all(c in letters for c in token)
        a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode()
        for i, p in enumerate(names)
    ]
    sizes = [np.array([len(t) for t in t_], np.int64) for t_ in (a_bytes, b_bytes)]
    # A text may be cut before a space if the first tokenizer cuts there itself, and no piece of the
    # second goes on after a space inside it.
    rule = json.loads(byte_level).get("pre_tokenizer") or {}
    level = rule.get("type") == "ByteLevel" and rule.get("use_regex", True)
    whole = not json.loads(byte_level).get("normalizer") and not rule.get("add_prefix_space")
    inside = any(SPACE in p.lstrip(SPACE) for p in names)
    kept = b.encode("a  b") == b.encode("a") + b.encode(" b")
    return Tools(a, b, a_bytes, b_bytes, *sizes, level and whole and not inside and kept)


def cuts(data: np.ndarray, at: np.ndarray, parts: bool) -> np.ndarray:
    """Where the spans of texts with these edges begin: at the texts' first bytes, and before each
    space after a character that is surely no white space. A space that ends a text stays with what
    is before it, since the second tokenizer adds none to nothing."""
    if not parts:
        return at[:-1]
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    b1, b2, b3 = padded[2:-1], padded[1:-2], padded[:-3]  # the bytes before each byte
    plain = (b1 > 0x20) & (b1 < 0x7F)
    # Blocks of characters that hold a white space beyond ASCII count as white space.
    blank = (b2 == 0xC2) | ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE3) & (b2 == 0x80))
    blank |= (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))
    before = plain | ((b1 >= 0x80) & ~blank)
    found = (data == 0x20) & before
    found[at[1:] - 1] = False
    return np.union1d(np.flatnonzero(found), at[:-1])


class Spans(NamedTuple):
    """What became of some spans: tokens and groups of each, whether its bytes came out again, its
    printed groups, each ended by `;`, and its linked pairs (a << 32 | b), one after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    whole: np.ndarray
    printed: list[str]
    pairs: np.ndarray


def byte_ends(ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, chars: np.ndarray):
    """Where tokens end in bytes, or None if they cannot have made the text.

    Character offsets are the coarse cuts. A token that ends inside a character, as part of a
    multibyte one or as a byte of its fallback, is placed by the bytes it decodes to.
    """
    coarse = chars[np.minimum(ends, len(chars) - 1)]
    decoded = np.cumsum(sizes[ids])
    inside = coarse != decoded
    if (np.abs(coarse - decoded)[inside] > 3).any() or (len(ids) and decoded[-1] != chars[-1]):
        return None
    return np.where(inside, decoded, coarse)


def encoded(t: Tools, text: bytes):
    """(ids, byte ends) of both tokenizers for a text that begins with a space; None where the bytes
    of the tokens are not the text."""
    try:
        known = text.decode()
    except UnicodeDecodeError:
        return None
    data = np.frombuffer(text, np.uint8)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    a = t.a.encode(known, add_special_tokens=False)
    a_ids = np.array(a.ids, np.int64)
    a_ends = byte_ends(np.array(a.offsets, np.int64).reshape(-1, 2)[:, 1], a_ids, t.a_sizes, chars)
    b = t.b.encode(known[1:], return_type="offset_mapping", num_threads=1)
    b_ids = np.array(b["ids"], np.int64)
    # The second tokenizer adds the space by itself, its offsets do not count it.
    b_ends = byte_ends(np.array(b["offsets"], np.int64).reshape(-1, 2)[:, 1] + 1, b_ids, t.b_sizes, chars)
    if a_ends is None or b_ends is None:
        return None
    for names, ids in ((t.a_bytes, a.ids), (t.b_bytes, b["ids"])):
        if b"".join([names[i] for i in ids]) != text:
            return None
    return a_ids, a_ends, b_ids, b_ends


def printed_groups(a_ids, a_group, b_ids, b_group) -> tuple[str, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` for all groups, and where each token's text ends in it, by group."""
    group = np.concatenate([a_group, b_group])
    side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    by = np.argsort(group * 2 + side, kind="stable")
    key = (group * 2 + side)[by]
    last = np.append(key[1:] != key[:-1], True)
    mark = np.where(last, np.where(side[by] == 0, "|", ";"), ",")
    names = np.char.add(np.concatenate([a_ids, b_ids])[by].astype("U7"), mark)
    ends = np.cumsum(np.char.str_len(names))
    return "".join(names.tolist()), ends[last & (side[by] == 1)]


def aligned(t: Tools, spans: list[bytes]) -> Spans:
    """Spans encoded together. Where that does not give back the bytes of each, they are encoded one
    by one."""
    text = b"".join(spans)
    found = encoded(t, text)
    edges = np.cumsum([len(s) for s in spans])
    if found is not None:
        a_ids, a_ends, b_ids, b_ends = found
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if len(np.setdiff1d(edges, shared)) == 0:
            last = np.searchsorted(shared, edges, "right")
            groups = np.diff(np.concatenate([[0], last]))
            string, ends = printed_groups(
                a_ids, np.searchsorted(shared, a_ends), b_ids, np.searchsorted(shared, b_ends)
            )
            stops = [0, *ends[last - 1].tolist()]
            pairs = a_ids[np.searchsorted(a_ends, shared)] << 32 | b_ids[np.searchsorted(b_ends, shared)]
            return Spans(
                np.diff(np.concatenate([[0], np.searchsorted(a_ends, edges, "right")])),
                np.diff(np.concatenate([[0], np.searchsorted(b_ends, edges, "right")])),
                groups,
                np.ones(len(spans), bool),
                [string[i:j] for i, j in zip(stops, stops[1:])],
                pairs,
            )
    if len(spans) > 1:
        return _together([aligned(t, [s]) for s in spans])
    none = np.zeros(1, np.int64)
    return Spans(none, none, none, np.zeros(1, bool), [""], none[:0])


def _together(parts: list[Spans]) -> Spans:
    columns = list(zip(*parts))
    arrays = [np.concatenate(c) for c in columns[:4]]
    return Spans(*arrays, [s for p in columns[4] for s in p], np.concatenate(columns[5]))


def distinct_spans(t: Tools, spans: list[bytes], joins: np.ndarray) -> Spans:
    """Each span aligned once. Those that end before white space may not stand before others."""
    order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
    parts, held, size = [], [], 0
    for i in order.tolist():
        alone = not joins[i]
        if held and (alone or size >= JOINED_BYTES):
            parts.append(aligned(t, held))
            held, size = [], 0
        held.append(spans[i])
        size += len(spans[i])
    if held:
        parts.append(aligned(t, held))
    found = _together(parts)
    back = np.argsort(order)
    starts = np.cumsum(found.n_groups) - found.n_groups
    return Spans(
        found.n_a[back],
        found.n_b[back],
        found.n_groups[back],
        found.whole[back],
        [found.printed[i] for i in back.tolist()],
        found.pairs[ragged(starts[back], found.n_groups[back])],
    )


def linked_pairs(
    spans: np.ndarray, heads: np.ndarray, code: np.ndarray, groups: np.ndarray, pair_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many pairs each document links, their numbers and how often, document by document.
    Document i has the spans code[heads[i] : heads[i] + spans[i]]; the pairs of a span stand in
    `pair_of`, as many as it has groups. Some whole documents are worked on at a time."""
    starts = np.cumsum(groups) - groups
    counts, numbers, times = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    width, first = int(pair_of.max(initial=0)) + 1, 0
    total = np.cumsum(spans)
    while first < len(spans):
        done = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + SPANS_AT_ONCE, "right")))
        own = code[ragged(heads[first:last], spans[first:last])]
        doc = np.repeat(np.repeat(np.arange(last - first), spans[first:last]), groups[own])
        keys, n = np.unique(doc * width + pair_of[ragged(starts[own], groups[own])], return_counts=True)
        counts.append(np.bincount(keys // width, minlength=last - first))
        numbers.append((keys % width).astype(np.int32))
        times.append(n.astype(np.int32))
        first = last
    return np.concatenate(counts), np.concatenate(numbers), np.concatenate(times)


def _scan(byte_level: bytes, pieces: bytes, id_type: pa.DataType):
    """Rows of documents (block, id, counts, hash, numbers and times of their linked pairs) and rows
    (block, number, a, b, n) of the pairs of a block."""
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("id", id_type),
            *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
            ("groups_sha256", pa.string()),
            ("pairs", pa.list_(pa.int32())),
            ("times", pa.list_(pa.int32())),
            *[(c, pa.int32()) for c in ("number", "a", "b")],
            ("n", pa.int64()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tools(byte_level, pieces)
        for number, rows in text_blocks(batches, "text"):
            ids = rows.pop("id")
            texts = pc.fill_null(rows.pop("text").cast(pa.large_string()), "")
            texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            data, at = text_bytes(texts)
            n_docs = len(ids)
            some = np.diff(at) > 1  # more than the space before it
            data = data[at[0] : at[-1]]
            at = at - at[0]
            starts = cuts(data, at, t.parts)
            edges = np.append(starts, at[-1])
            per_doc = np.diff(np.searchsorted(starts, at))
            hashes = span_hashes(data, edges)
            _, first, code = numbered_keys(hashes)
            raw = memoryview(data)
            spans = [bytes(raw[i:j]) for i, j in zip(edges[first].tolist(), edges[first + 1].tolist())]
            # A span before another one ends where a cut is, the last of a text anywhere.
            inner = np.ones(len(starts), bool)
            inner[np.cumsum(per_doc) - 1] = False
            joins = np.zeros(len(first), bool)
            joins[code[inner]] = True
            found = distinct_spans(t, spans, joins)
            del raw, spans, hashes, first, inner, starts, edges, data, texts
            good = some & (sums_by((~found.whole)[code].astype(np.int64), per_doc) == 0)
            n_a, n_b, n_groups = (
                np.where(good, sums_by(x[code], per_doc), 0) for x in (found.n_a, found.n_b, found.n_groups)
            )
            printed, names, head = found.printed, [], 0
            for n, kept in zip(per_doc.tolist(), good.tolist()):
                if kept:
                    line = "".join([printed[c] for c in code[head : head + n].tolist()])
                    names.append(sha256(line[:-1].encode()).hexdigest())
                else:
                    names.append("")
                head += n
            pairs, pair_of = np.unique(found.pairs, return_inverse=True)
            per_doc_pairs, linked, times = linked_pairs(
                np.where(good, per_doc, 0), np.cumsum(per_doc) - per_doc, code, found.n_groups, pair_of
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc_pairs)]).astype(np.int32))
            n = np.bincount(linked, weights=times, minlength=len(pairs)).astype(np.int64)
            met = np.flatnonzero(n)
            yield nullable_batch(
                [
                    {
                        "block": pa.array(np.full(n_docs, number)),
                        "id": ids,
                        "n_a": pa.array(n_a),
                        "n_b": pa.array(n_b),
                        "n_groups": pa.array(n_groups),
                        "n_links": pa.array(n_groups),
                        "groups_sha256": pa.array(names, pa.string()),
                        "pairs": pa.ListArray.from_arrays(offsets, pa.array(linked.astype(np.int32))),
                        "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    },
                    {
                        "block": pa.array(np.full(len(met), number)),
                        "number": pa.array(met.astype(np.int32)),
                        "a": pa.array((pairs[met] >> 32).astype(np.int32)),
                        "b": pa.array((pairs[met] & 0xFFFFFFFF).astype(np.int32)),
                        "n": pa.array(n[met]),
                    },
                ],
                schema,
            )

    return work


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _weighed(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The rows of a block with the counts of their links."""
    numbers = values.column("number").to_numpy()
    size = int(numbers.max()) + 1 if len(numbers) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    count[numbers] = values.column("count").to_numpy()
    best[numbers] = values.column("best").to_numpy()
    pairs, times = (rows.column(c).combine_chunks() for c in ("pairs", "times"))
    per_doc = pc.list_value_length(pairs).to_numpy()
    own, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    return pa.table(
        [
            rows.column("id"),
            *[rows.column(c) for c in COUNTS],
            sums_by(best[own] * n, per_doc),
            sums_by(count[own] * n, per_doc),
            rows.column("groups_sha256"),
        ],
        names=["id", *COUNTS, "n_best", "count_sum", "groups_sha256"],
    )


def token_alignment(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = FOLDER,
    byte_level: str = BYTE_LEVEL,
    pieces: str = PIECES,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row: how the
    tokens of two tokenizers lie over each other.

    The byte-level tokenizer A encodes a space and the text; the piece tokenizer B adds the space
    itself. Places where tokens of both end cut them into groups; the two tokens that end there are
    a link. A pair of ids counts as often as all documents link it. `n_best` are the links whose
    pair counts most for their B id, ties included; `count_sum` adds up the counts of all links.

    Texts are cut into spans before spaces where both tokenizers cut anyway (shown from their
    rules; else a span is a whole text), and a span that a block of texts repeats is encoded once.
    Character offsets are the coarse places of tokens; those that end inside a character are placed
    by the bytes they decode to.

    A null or empty text, one that is not UTF-8, and one whose tokens do not give back its bytes has
    no tokens: zeros, an empty `groups_sha256`, and no part in any count. Every row counts, also one
    that repeats an id or a text. Spans of a block are told apart by 64 bits. No rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES)
    kind, arrow_id = id_kind(docs, id_col)
    # The driver reads both vocabularies; files of a known size, which travel with the tasks.
    files = []
    for name in (byte_level, pieces):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))
    scanned = written(
        rows.mapInArrow(
            _scan(*files, arrow_id),
            f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long,"
            " groups_sha256 string, pairs array<int>, times array<int>, number int, a int, b int,"
            " n long",
        ),
        "alignments",
    )
    pairs = scanned.where("number is not null").select("block", "number", "a", "b", "n")
    counted = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    best = F.max("count").over(Window.partitionBy("b"))
    counted = counted.withColumn("best", F.col("count") == best)
    values = pairs.join(counted, ["a", "b"]).select("block", "number", "count", "best")
    each = scanned.where("number is null").select(
        "block", "id", *COUNTS, "groups_sha256", "pairs", "times"
    )
    return with_values(
        each,
        values,
        _weighed,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
        " groups_sha256 string",
    ).withColumnRenamed("id", id_col)
