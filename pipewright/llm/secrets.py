"""Secret scans: who else holds a credential tells a leak from an example."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm.common import append_columns, without, written

KINDS = ("assign", "access", "hex")
# What a candidate looks like, and how long it must be.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

FOUND = T.StructType(
    [
        T.StructField(
            "found",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("secret", T.StringType()),
                    ]
                )
            ),
        )
    ]
)
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]
    )
)


def candidates(text: str | None) -> list[dict]:
    """Every candidate of a text by start and kind; places are code points. The secret itself leaves
    as a hash only."""
    text = text or ""
    hits = [
        (m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS
    ]
    hits += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    hits += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [
        {
            "kind": KINDS[kind],
            "start": start,
            "end": end,
            "secret": hashlib.sha256(secret.encode()).hexdigest(),
        }
        for start, kind, end, secret in sorted(hits)
    ]


def _scan(at: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hits = [candidates(v.as_py()) for v in batch.column(at)]
            yield batch, [pa.array(hits, _ARROW)]

    return work


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "lang",
    copied_owners: int = 3,
) -> DataFrame:
    """Per row the id and `found`: kind, start, end, secret (its hash), repositories, owners and
    verdict of every candidate.

    A secret that `copied_owners` or more distinct owners hold is `copied`: an example that was
    pasted around. Anything rarer is `live`: it looks like a credential of its owner. A repository
    is known by its owner and its own name; null owners or names count as one of their own.

    Texts are scanned once and leave as hashes. Hashes are counted per (hash, owner, repository),
    then per (hash, owner), then per hash, each step combined on the map side, so that a secret that
    a third of all rows hold is never gathered. Null or empty texts have no candidates. Rows that
    share an id each keep their own candidates. Other columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).alias("owner"),
        F.col(repository_col).alias("repository"),
        F.col(text_col).alias("text"),
    )
    scanned = written(
        append_columns(rows, FOUND, _scan(rows.columns.index("text"))).drop("text"), "secrets"
    )
    each = scanned.select("id", "owner", "repository", F.explode("found.secret").alias("secret"))
    owned = (
        each.groupBy("secret", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("secret", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("secret")
        .agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    )
    # Written, so that both sides of the join are plain shuffles and a hot secret can be split.
    known = written(owned, "secret-owners")
    of_rows = (
        each.select("id", "secret")
        .distinct()
        .join(known, "secret")
        .groupBy("id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("secret", F.struct("repositories", "owners")))
            ).alias("__known")
        )
        .withColumnRenamed("id", "__id")
    )

    def judged(hit):
        seen = F.element_at("__known", hit["secret"])
        return F.struct(
            hit["kind"].alias("kind"),
            hit["start"].alias("start"),
            hit["end"].alias("end"),
            hit["secret"].alias("secret"),
            seen["repositories"].alias("repositories"),
            seen["owners"].alias("owners"),
            F.when(seen["owners"] >= copied_owners, "copied").otherwise("live").alias("verdict"),
        )

    return scanned.join(of_rows, scanned["id"].eqNullSafe(of_rows["__id"]), "left").select(
        F.col("id").alias(id_col), F.transform("found", judged).alias("found")
    )


def digest(scan: DataFrame) -> DataFrame:
    """Counts and spans of a scan as plain columns."""
    (id_col,) = without(scan, ["found"]).columns

    def count(kind: str):
        return F.size(F.filter("found", lambda h: h["kind"] == kind)).cast("long")

    def verdicts(verdict: str):
        return F.size(F.filter("found", lambda h: h["verdict"] == verdict)).cast("long")

    spans = F.array_join(
        F.transform(
            "found",
            lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string")),
        ),
        ",",
    )
    return scan.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("copied").alias("n_copied"),
    )
