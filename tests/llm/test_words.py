import re

import numpy as np
import pyarrow as pa

from pipewright.llm import words
from tests.llm.small import LOWER, awkward

PATTERNS = {
    "alnum": (words.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")),
    "spaced": (words.SPACED, re.compile(r"[^\x20\x09-\x0D]+")),
}


def test_words_are_those_of_the_pattern(monkeypatch):
    texts = [t for _, t in awkward()] + ["a" * 500, "x", "", "Tail word"]
    for size in (1, 64, 1 << 19):
        monkeypatch.setattr(words, "CHUNK_BYTES", size)
        for table, pattern in PATTERNS.values():
            expected = [pattern.findall((t or "").translate(LOWER)) for t in texts]
            for kind in (pa.string(), pa.large_string()):
                column = pa.concat_arrays([pa.array(["skipped"], kind), pa.array(texts, kind)])[1:]
                found = list(words.chunks(column, table))
                counts = np.concatenate([c.counts for c in found])
                assert counts.tolist() == [len(w) for w in expected]
                data = words.text_bytes(column)[0]
                flat = [
                    bytes(data[a:b]).decode().translate(LOWER)
                    for c in found
                    for a, b in zip(c.starts, c.ends)
                ]
                assert flat == [w for ws in expected for w in ws]
                hashes = np.concatenate([c.hashes for c in found]).tolist()
                assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_no_texts():
    assert list(words.chunks(pa.array([], pa.string()), words.ALNUM)) == []
