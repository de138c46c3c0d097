"""Alignment against whole texts encoded at once, tokens placed by their bytes alone."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pipewright.llm import align
from tests.llm.small import awkward, docs

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def latin(n: int) -> str:
    """How a byte is written in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(n) if n in shown else chr(256 + [b for b in range(256) if b not in shown].index(n))


LETTERS = {latin(n): n for n in range(256)}


def tokens(coders, text):
    a, b = coders
    ours = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    theirs = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not all(b"".join(t for _, t in side) == (" " + text).encode() for side in (ours, theirs)):
        return [], []
    return ours, theirs


def ended(side):
    out, at = [], 0
    for i, t in side:
        at += len(t)
        out.append((at, i))
    return out


def brute(coders, rows):
    sides = [tuple(map(ended, tokens(coders, t))) if t else ([], []) for _, t in rows]
    links = []
    for a, b in sides:
        there = dict(b)  # every token has a byte, so a place has one token of each side
        links.append([(i, there[at]) for at, i in a if at in there])
    count = Counter(pair for own in links for pair in own)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (doc_id, _), (a, b), own in zip(rows, sides, links):
        places = sorted({at for at, _ in a} & {at for at, _ in b})
        groups = linear(a, b, places)
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(places), len(own), sum(count[p] == best[p[1]] for p in own),
                    sum(count[p] for p in own), hashed))
    return sorted(map(str, out))


def linear(a, b, places):
    out, i, j = [], 0, 0
    for high in places:
        x, y = [], []
        while i < len(a) and a[i][0] <= high:
            x.append(str(a[i][1]))
            i += 1
        while j < len(b) and b[j][0] <= high:
            y.append(str(b[j][1]))
            j += 1
        out.append(f"{','.join(x)}|{','.join(y)}")
    return out


def agree(coders, frame):
    found = align.token_alignment(frame)
    assert found.columns == list(COLUMNS)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    return sorted(map(str, map(tuple, found.collect()))) == brute(coders, rows)


HARD = [
    "café naïve \U0001f600\U0001f468‍\U0001f469 日本語 नमस्ते",
    "<|endoftext|> </s> <s> <unk> <0x41> [a]",
    "tab\t end \n\n  two  spaces   three \r\n x",
    " leading", "trailing ", " ", "\n", "  nbsp  　 wide  em   line \u0085 nel",
    "one ▁ block", "a\x00b \x1c c \x7f d", "don't we'll I'M 12345 3.14e-10 snake_case CamelCase",
    "é combining ́ alone", "﻿bom �", "a ", "ab  ", "x" * 5000, "中" * 3000, "ab " * 4000,
]


def test_hard_texts(spark, coders):
    assert agree(coders, docs(spark, list(enumerate(HARD)), extra="pairs block n_a number"))


def test_awkward_rows(spark, coders):
    assert agree(coders, docs(spark, awkward()))


def test_random_texts_in_small_blocks(spark, coders, monkeypatch):
    rnd = random.Random(4)
    parts = ["the", "résumé", "\U0001f9ea", "12", "\t", "\n", "  ", ",", "日", " ", "qzx", "<s>", "'s"]
    rows = [(i, "".join(rnd.choice([*parts, " ", " "]) for _ in range(rnd.randint(1, 80)))) for i in range(400)]
    whole = agree(coders, docs(spark, rows))
    monkeypatch.setattr(align, "JOINED_BYTES", 50)
    assert whole and agree(coders, docs(spark, rows).repartition(5))


def test_whole_texts_where_cuts_are_not_sure(coders):
    t = align.tools(*[open(public_tokenizers.path(n), "rb").read() for n in (align.BYTE_LEVEL, align.PIECES)])
    assert t.parts
    for text in HARD[:4]:
        both = [align.distinct_spans(t._replace(parts=p), *spans_of(" " + text, p)) for p in (True, False)]
        assert "".join(both[0].printed) == "".join(both[1].printed)


def spans_of(text, parts):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    edges = [*align.cuts(data, np.array([0, len(data)]), parts).tolist(), len(data)]
    spans = [text.encode()[i:j] for i, j in zip(edges, edges[1:])]
    return spans, np.array([True] * (len(spans) - 1) + [False])


def test_no_rows(spark):
    assert align.token_alignment(docs(spark, [])).collect() == []
