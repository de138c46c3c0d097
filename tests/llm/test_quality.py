import random

import pytest
from pyspark.sql import functions as F

from pipewright.llm import queries
from pipewright.llm.quality import classify, shrunk, site_of
from tests.llm.small import awkward, docs


def test_shrinking_follows_the_formula(spark):
    rnd = random.Random(3)
    rows = []
    for host, rate, n in [("a", 0.9, 400), ("b", 0.2, 300), ("c", 0.9, 2), ("d", 0.5, 60)]:
        for path in ("x", "y"):
            rows += [(host, path, min(0.99, max(0.01, rnd.gauss(rate, 0.1)))) for _ in range(n)]
    found = {
        (r.host, r.path): r for r in shrunk(spark.createDataFrame(rows, "host string, path string, p double"), "p").collect()
    }

    def moments(groups):
        means = [sum(v) / len(v) for v in groups]
        noise = [
            max(sum(x * x for x in v) / len(v) - m * m, 0) / len(v) for v, m in zip(groups, means)
        ]
        k = len(means)
        overall = sum(map(sum, groups)) / sum(map(len, groups))
        between = max(sum(m * m for m in means) / k - (sum(means) / k) ** 2 - sum(noise) / k, 1e-6)
        return overall, max(overall * (1 - overall) / between - 1, 1.0)

    def of(*key):
        return [p for h, q, p in rows if (h, q)[: len(key)] == key]

    overall, host_strength = moments([of(h) for h in "abcd"])
    # Paths differ from the mean path of their own host; two paths have one degree of freedom.
    spread = noise = 0.0
    for h in "abcd":
        groups = [of(h, q) for q in "xy"]
        means = [sum(v) / len(v) for v in groups]
        spread += sum((m - sum(means) / 2) ** 2 for m in means)
        noise += sum((sum(x * x for x in v) / len(v) - m * m) / len(v) for v, m in zip(groups, means))
    between = max(spread / 4 - noise / 8, 1e-6)
    path_strength = max(overall * (1 - overall) / between - 1, 1.0)
    for (host, path), r in found.items():
        own = of(host)
        assert (r.n, r.s) == (len(of(host, path)), pytest.approx(sum(of(host, path))))
        assert r.prior == pytest.approx((sum(own) + overall * host_strength) / (len(own) + host_strength))
        assert (r.strength, r.overall) == (pytest.approx(path_strength), pytest.approx(overall))
    assert abs(found["c", "x"].prior - overall) < abs(found["a", "x"].prior - overall)


def test_like_paths_in_unlike_hosts_have_a_strong_prior(spark):
    """Hosts say all there is to say: a path with few rows stays with its host."""
    rnd = random.Random(8)
    rows = [
        (host, f"p{path}", min(0.99, max(0.01, rnd.gauss(rate, 0.05))))
        for host, rate in (("a", 0.1), ("b", 0.4), ("c", 0.7), ("d", 0.95))
        for path in range(20)
        for _ in range(40)
    ]
    rows += [("a", "odd", 0.99), ("a", "odd", 0.99)]
    found = shrunk(spark.createDataFrame(rows, "host string, path string, p double"), "p").collect()
    # The one odd path counts as spread too; without it the prior would be stronger yet.
    assert found[0].strength > 15
    odd = next(r for r in found if r.path == "odd")
    assert (odd.s + odd.prior * odd.strength) / (odd.n + odd.strength) < 0.2


def test_unlike_paths_have_a_weak_one(spark):
    rows = [("a", f"p{p}", 0.05 + 0.9 * (p % 2)) for p in range(20) for _ in range(40)]
    found = shrunk(spark.createDataFrame(rows, "host string, path string, p double"), "p").collect()
    assert found[0].strength == 1.0


def corpus(n):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"word{rnd.randint(0, 80)}" for _ in range(60)]
        text = " ".join([words[0]] * 30 + ["scum"] if bad else words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def test_documents_and_their_sites(spark):
    rows, labels = corpus(400)
    labels = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in classify(docs(spark, rows), labels, ["quality", "toxic"]).collect()}
    assert len(found) == 400
    assert all((found[i].quality < 0.5) == (i % 4 == 0) == (found[i].toxic > 0.5) for i in range(200, 400))
    # Every fourth row is bad, and sources repeat every four rows: src0 has all of them.
    assert found[201].quality_site > 0.9 > 0.1 > found[200].quality_site
    assert found[200].host == "src0"


def test_awkward_rows(spark):
    rows, labels = corpus(80)
    labels = [*labels, (None, 1, 0), (1, None, None), (5, 0, 1), (99_999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = docs(spark, [*rows, *((i and i + 1000, t) for i, t in awkward())], "HOST Odds_0 quality")
    found = classify(frame, table, ["quality", "toxic"]).collect()
    assert len(found) == 80 + len(awkward())
    assert all(0 < r.quality < 1 and 0 < r.toxic < 1 for r in found)
    assert classify(docs(spark, []), table, ["quality"]).collect() == []
    even = classify(docs(spark, rows), table.limit(0), ["quality"]).collect()
    assert {round(r.quality, 9) for r in even} == {0.5}


def test_url_parts(spark):
    urls = ["http://a.Example.net/fr/25930", "https://u:p@b.example.com:8080/en/x?q#top", "http://c.d", "junk", None]
    host, section = site_of(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host, section).collect()
    assert [tuple(r) for r in rows] == [
        ("a.example.net", "fr"), ("b.example.com", "en"), ("c.d", ""), ("", ""), (None, None),
    ]


def test_query_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op1_quality(spark, folder)
    assert found.count() == 1000
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("clean", F.expr("quality = 1 and toxic = 0"))
    right = found.join(labels.select("doc_id", "clean"), "doc_id").agg(F.avg(F.expr("int(keep = clean)"))).first()[0]
    assert right > 0.95
