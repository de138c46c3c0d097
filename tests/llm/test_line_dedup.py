import random
from collections import defaultdict

from pipewright.llm.line_dedup import drop_repeated_lines
from tests.llm.small import LOWER, awkward, docs

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            l
            for l in lines
            if i is None or len(h := holders.get(key(l), ())) < min_docs or max(h) == i
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(frame, **options):
    rows = drop_repeated_lines(frame, **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    shared = [f"Shared line number {i} that is LONG enough to count, É" for i in range(6)] + ["short"]
    rows = [
        (i, "\n".join(rnd.choice([rnd.choice(shared), f" {rnd.choice(shared)}\t", f"own {i}"]) for _ in range(6)))
        for i in range(40)
    ]
    assert found(docs(spark, rows)) == brute(rows)
    assert any(r[2] for r in brute(rows))


def test_awkward_rows(spark):
    line = "This line is long enough to be counted as a repeated one"
    edge = "x" * 39
    rows = [*awkward(), *[(i, f"{line}\n{edge}\n{line.upper()}\r\n") for i in (20, 21, 22, 23, 24)]]
    rows += [(20, line), (None, line), (30, f"{line}\n\n"), (31, "É" * 40), (32, "é" * 40)]
    assert found(docs(spark, rows, "KEPT n_lines")) == brute(rows)
    assert found(docs(spark, [])) == []


def test_four_documents_are_too_few_and_repeated_rows_are_one(spark):
    line = "y" * 40
    rows = [(1, line)] * 9 + [(2, line), (3, line), (4, line)]
    assert found(docs(spark, rows)) == brute(rows)
    assert all(r[2] == 0 for r in brute(rows))
