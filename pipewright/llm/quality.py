"""Quality classifier: document evidence combined with host and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm.common import append_columns, bound_batches, written
from pipewright.llm.words import ALNUM, chunks, text_bytes

TRAINING_DOCS = 20_000  # about so many labelled rows, taken by hash, fit the document classifier
WORD_BUCKETS = 1 << 16
WORST = 8
FEATURES = 8 + 2


class Evidence:
    """Log-odds of a label from a document alone: a logistic model over figures of its text and over
    what its distinct words say."""

    def __init__(self, words: np.ndarray):
        self.words = words  # the log-odds of each bucket of words
        self.centre = self.scale = self.weights = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge-penalised maximum likelihood by Newton's method."""
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 1.0
        ridge[-1, -1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(
                z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w
            )
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])
        return np.clip(z @ self.weights, -15, 15)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64) % WORD_BUCKETS


def figures(texts: pa.Array, words: np.ndarray | None) -> np.ndarray:
    """A row of FEATURES for each text; what words say is 0 without their log-odds."""
    data, at = text_bytes(texts)
    out = np.zeros((len(texts), FEATURES))
    for chunk in chunks(texts, ALNUM):
        end = 0
        for i, n in enumerate(chunk.counts.tolist(), chunk.first):
            start, end = end, end + n
            size = int(at[i + 1] - at[i])
            raw = data[at[i] : at[i + 1]]
            own = chunk.hashes[start:end]
            distinct = np.unique(own)
            lengths = (chunk.ends - chunk.starts)[start:end]
            lines = raw == 10
            out[i, :8] = (
                np.log1p(n),
                len(distinct) / n if n else 0,
                (own[1:] == own[:-1]).mean() if n > 1 else 0,
                lengths.mean() if n else 0,
                ((raw >= 48) & (raw <= 57)).mean() if size else 0,
                ((raw >= 33) & (raw <= 47) | (raw >= 58) & (raw <= 64) | (raw >= 91) & (raw <= 96) | (raw >= 123) & (raw < 128)).mean() if size else 0,
                ((raw >= 65) & (raw <= 90)).mean() if size else 0,
                lines.mean() if size else 0,
            )
            if words is not None and n:
                said = np.sort(words[buckets(distinct)])
                out[i, 8:] = said.mean(), said[:WORST].sum()
    return out


def _label_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, good, all): in how many texts a bucket of words occurs, added up by task."""
    counts = np.zeros((2, WORD_BUCKETS), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(0), ALNUM):
            end = 0
            for i, n in enumerate(chunk.counts.tolist(), chunk.first):
                start, end = end, end + n
                own = np.unique(buckets(chunk.hashes[start:end]))
                counts[1, own] += 1
                counts[0, own] += int(label[i])
    some = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])],
        names=["bucket", "good", "total"],
    )


def _figures(words_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = figures(batch.column(0), words_of.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"]
            )

    return run


def fit_evidence(labelled: DataFrame) -> Evidence | None:
    """The document classifier for rows (text, label 0 or 1); None without both labels."""
    spark = labelled.sparkSession
    rows = written(labelled, "labelled")
    n, good = rows.agg(F.count("label"), F.sum("label")).first()
    if not n or not good or good == n:
        return None
    counted = (
        rows.mapInArrow(_label_words, "bucket long, good long, total long")
        .groupBy("bucket")
        .agg(F.sum("good"), F.sum("total"))
        .collect()  # at most WORD_BUCKETS rows
    )
    words = np.zeros(WORD_BUCKETS)
    rate = good / n
    for bucket, with_label, total in counted:
        # Shrunk to the overall rate as if ten more texts had the word.
        p = (with_label + 10 * rate) / (total + 10)
        words[bucket] = np.log(p / (1 - p)) - np.log(rate / (1 - rate))
    evidence = Evidence(words)
    sample = rows.mapInArrow(
        _figures(spark.sparkContext.broadcast(words)), "x array<double>, label long"
    ).toPandas()
    evidence.fit(np.stack(sample["x"]), sample["label"].to_numpy(np.float64))
    return evidence


def _score(evidence_of, at: int):
    def work(batches: Iterator[pa.RecordBatch]):
        models = evidence_of.value
        for batch in batches:
            columns = []
            for model in models:
                odds = np.zeros(batch.num_rows)
                if model is not None:
                    odds = model.log_odds(figures(batch.column(at), model.words))
                columns.append(pa.array(odds))
            yield batch, columns

    return work


def shrunk(scored: DataFrame, p: str) -> DataFrame:
    """(host, path, n, s, prior): per path its rows, the sum of probabilities `p`, and the mean that
    its host leads to expect, with the strengths of the priors.

    Rows are reduced to paths, paths to hosts and hosts to one row, each step combined on the map
    side. The strength of a prior (in rows) follows from how much the means below it differ beyond
    what the variance within them explains: the method of moments. Few or equal sites mean a strong
    prior, and a sparse site stays close to it.
    """
    paths = written(
        scored.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("ss")
        ),
        "paths",
    )
    hosts = written(
        paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")),
        "hosts",
    )

    mean = F.col("s") / F.col("n")
    inner = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")
    k, n, s, m1, m2, noise = hosts.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("s"), F.avg(mean), F.avg(mean * mean), F.avg(inner)
    ).first()
    overall = min(max(s / n, 1e-6), 1 - 1e-6) if k else 0.5

    def strength(between: float) -> float:
        return max(overall * (1 - overall) / max(between, 1e-6) - 1, 1.0)

    host_strength = strength(m2 - m1 * m1 - noise) if k else 1.0
    # Squared distances of paths from the mean path of their host, one degree of freedom less each.
    spread, free, noise = (
        paths.groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.avg(mean).alias("m1"),
            F.avg(mean * mean).alias("m2"),
            F.sum(inner).alias("noise"),
        )
        .agg(
            F.sum(F.col("k") * (F.col("m2") - F.col("m1") * F.col("m1"))),
            F.sum(F.col("k") - 1),
            F.sum("noise") / F.sum("k"),
        )
        .first()
    )
    path_strength = strength(spread / free - noise if free else 0.0) if k else 1.0
    expected = (F.col("s") + overall * host_strength) / (F.col("n") + host_strength)
    return (
        paths.join(hosts.select("host", expected.alias("prior")), "host")
        .select("host", "path", "n", "s", "prior")
        .withColumn("strength", F.lit(path_strength))
        .withColumn("overall", F.lit(overall))
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    targets: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    training_docs: int = TRAINING_DOCS,
) -> DataFrame:
    """(id, host, path) of every row and, for each target (a 0/1 column of `labels`), its posterior
    probability under the target's name and the posterior of its path as `<target>_site`.

    The evidence of a document is the log-odds of a classifier fitted on about `training_docs`
    labelled rows, taken by a hash of the id (all, if there are fewer). Probabilities of all rows
    give the posterior of each path, shrunk to its host's, and of each host, shrunk to the overall
    mean (`shrunk`). A row's own part is taken out of its path before the two are combined, so that
    nothing counts twice: log-odds = evidence + site - overall.

    Null hosts or paths are a site of their own. Null or empty texts are judged like any text
    without words. Rows with a null id are judged but never learned from; repeated rows count each.
    Without labels of both kinds the evidence is even. Labels that are null are left out; an id with
    several labels is learned from with each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.col(text_col).alias("text"),
    )
    n = labels.count()
    share = F.pmod(F.xxhash64(F.lit("training"), id_col), F.lit(1 << 20))
    some = labels.where(share < F.lit(min(1.0, training_docs / max(n, 1)) * (1 << 20)))
    few = F.broadcast(some.withColumnRenamed(id_col, "id"))  # about training_docs rows
    known = rows.select("id", "text").join(few, "id")
    models = [
        fit_evidence(known.where(F.col(t).isNotNull()).select("text", F.col(t).cast("long").alias("label")))
        for t in targets
    ]
    odds = [f"odds_{i}" for i in range(len(targets))]
    added = T.StructType([T.StructField(c, T.DoubleType()) for c in odds])
    scored = written(
        append_columns(rows, added, _score(spark.sparkContext.broadcast(models), 3)).drop("text"),
        "evidence",
    )
    out = scored
    for c, target in zip(odds, targets):
        p = 1 / (1 + F.exp(-F.col(c)))
        sites = written(shrunk(scored.withColumn("p", p), "p"), "sites")
        others = (F.col("s") - p + F.col("prior") * F.col("strength")) / (
            F.col("n") - 1 + F.col("strength")
        )
        site = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))

        def logit(q):
            return F.log(q / (1 - q))

        out = (
            out.join(sites, ["host", "path"])
            .withColumn(f"{target}_site", site)
            .withColumn(target, 1 / (1 + F.exp(-(F.col(c) + logit(site) - logit(F.col("overall"))))))
            .drop("n", "s", "prior", "strength", "overall")
        )
    return out.drop(*odds).withColumnRenamed("id", id_col)


def site_of(url):
    """Host and path section of a URL, as two columns: the host in lower case without its port, and
    the first part of the path."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    section = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return host, section
