import re

from pipewright.llm import queries
from pipewright.llm.licenses import TEMPLATES, license_scan
from tests.llm.small import awkward, docs


def grams(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


def brute(text, threshold=0.8):
    best = {}
    units = {*(text or "").split("\n"), *re.split(r"\n\s*\n", text or ""), text or ""}
    for unit in units:
        for name, template in TEMPLATES:
            a, b = grams(unit), grams(template)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= threshold:
                best[name] = max(best.get(name, 0), dice)
    top = min(((-d, n) for n, d in best.items()), default=(None, None))
    return sorted(best), top[1], -top[0] if best else None


def test_against_brute_force(spark):
    notices = [t for _, t in TEMPLATES]
    texts = [f"Some text.\n{n}\nMore text." for n in notices]
    texts += [n.upper().replace(" ", "  ") for n in notices] + [n.replace("the", "teh") for n in notices]
    texts += ["\n".join(n.split(". ")) for n in notices] + [" ".join(n.split()[:-2]) for n in notices]
    texts += ["All rights reserved. " * 50, "rights", "MIT", notices[0] + "\n\n" + notices[2]]
    texts += [n.replace(" ", "\n", 3) for n in notices]
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.licenses, r.license, r.dice) for r in license_scan(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        names, name, dice = brute(t)
        assert found[i][:2] == (names, name), t
        assert (found[i][2] is None) == (dice is None) and abs((found[i][2] or 0) - (dice or 0)) < 1e-12


def test_awkward_rows(spark):
    rows = [*awkward(), (None, TEMPLATES[0][1]), (60, TEMPLATES[0][1]), (60, "nothing")]
    found = license_scan(docs(spark, rows, "LICENSE Dice")).collect()
    assert len(found) == len(rows)
    assert [r.license for r in found if r.doc_id == 60] == ["Apache-2.0"] * 2
    assert {r.license for r in found if r.doc_id is None} == {None}
    assert license_scan(docs(spark, [])).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op3_license_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    assert all((r.licenses, r.license) == (",".join((b := brute(texts[r.doc_id]))[0]), b[1]) for r in rows)
    assert any(r.license for r in rows)
