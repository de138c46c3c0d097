"""Ground truth: questions, the SQL that answers them, and the answers as Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.functions.text import as_title, clean_text
from pipewright.operators.digest import ordered_digest
from pipewright.operators.lookups import stacked
from pipewright.sources.literal import INT, TEXT, literal_table
from pipewright.tables import Tables


@dataclass(frozen=True)
class Seed:
    """A curated test case: one question and the statements that answer it.

    A statement names the tables it reads in braces. `part_by` is a column that all its statements
    return; an answer is then split into a table for each of its values.
    """

    question: str
    statements: tuple[str, ...]
    titles: tuple[str | None, ...] = ()
    part_by: str | None = None


def cell(field: T.StructField) -> Column:
    """A value as Markdown: two decimals for doubles, nothing for NULL, one line per cell."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.format_string("%.2f", col)
        text = F.when(col.isNotNull(), text)
    elif isinstance(field.dataType, T.BooleanType):
        text = F.when(col, "True").when(~col, "False")
    else:
        text = col.cast("string")
    text = F.replace(F.regexp_replace(text, "\r\n?|\n", "<br>"), F.lit("|"), F.lit("\\|"))
    return F.coalesce(text, F.lit(""))


def header(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{':-|' * len(columns)}"


def lines_of(df: DataFrame, columns: list[str]) -> Column:
    """A row as a line of a Markdown table."""
    cells = [cell(f) for f in df.schema.fields if f.name in columns]
    return clean_text(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def markdown_render(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    title: str | None = None,
    parts: tuple[str, ...] = (),
) -> DataFrame:
    """One Markdown table per group of `keys` and value of `parts`, rows in the given order.

    The columns of `keys` and `title` head the table and are not repeated inside. `title` must be
    the same on all rows of a group.
    """
    heading = [title] if title else []
    fields = [c for c in df.columns if c not in {*keys, *heading}]
    grouping = list(dict.fromkeys([*keys, *heading]))
    lines = df.select(
        *dict.fromkeys([*grouping, *parts, *order]), lines_of(df, fields).alias("_line")
    )
    body = ordered_digest(lines, grouping, order, "_line", "\n", "_body", parts)
    table = F.concat(F.lit(clean_text_literal(header(fields)) + "\n"), "_body")
    if title:
        table = F.concat(clean_text(as_title(F.col(title))), F.lit("\n\n"), table)
    return body.select(*keys, *parts, table.alias("markdown"))


def clean_text_literal(text: str) -> str:
    """`clean_text` for a constant known to the driver, such as a header or a question."""
    return " ".join(
        piece for piece in text.replace("\t", " ").replace('"', '\\"').split(" ") if piece
    ).strip()


def _headed(title: str | None, table: str) -> str:
    if not title:
        return clean_text_literal(table)
    title = title if title.endswith(":") else title + ":"
    return clean_text_literal(f"{title}\n\n{table}")


def _answer(answer: DataFrame, title: str | None, part_by: str | None) -> DataFrame:
    """(part, _text): an answer as Markdown, rows sorted by their columns from left to right."""
    part = F.col(part_by).cast("string") if part_by else F.lit("all")
    rows = answer.select(
        part.alias("part"),
        F.struct(*answer.columns).alias("_order"),
        lines_of(answer, answer.columns).alias("_line"),
    )
    # Without values to sort by, the head comes first.
    head = answer.sparkSession.range(1).select(
        F.lit("head" if part_by else "all").alias("part"),
        F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"),
        F.lit(_headed(title, header(answer.columns))).alias("_line"),
    )
    return ordered_digest(head.union(rows), ["part"], ["_order"], "_line", "\n", "_text")


def ground_truth(t: Tables, seeds: list[Seed]) -> DataFrame:
    """The answer of every seed over the given tables: (question, sql, part, result).

    Several tables of one question are joined by a blank line. A seed without `part_by` has one row
    with the part `all`. One with `part_by` has a row for each value, and one with the part `head`,
    which holds the head of the table; so an empty answer has a row as well. Nothing runs before the
    result is used.
    """
    texts = []
    for number, seed in enumerate(seeds):
        titles = seed.titles or (None,) * len(seed.statements)
        if len(titles) != len(seed.statements):
            raise ValueError("give one title per statement, or none")
        for position, (statement, title) in enumerate(zip(seed.statements, titles)):
            frames = {n: getattr(t, n) for n in t.names() if f"{{{n}}}" in statement}
            text = _answer(t.spark.sql(statement, **frames), title, seed.part_by)
            texts.append(
                text.select(F.lit(number).alias("_seed"), F.lit(position).alias("position"), "*")
            )
    # As many texts per question and part as it has statements.
    joined = stacked(texts).groupBy("_seed", "part").agg(
        F.sort_array(F.collect_list(F.struct("position", "_text"))).alias("_texts")
    )
    questions = literal_table(
        t.spark,
        [("_seed", INT), ("question", TEXT), ("sql", TEXT)],
        [
            (
                i,
                clean_text_literal(s.question),
                clean_text_literal(";\n".join(s.statements).replace("{", "").replace("}", "")),
            )
            for i, s in enumerate(seeds)
        ],
    )
    result = F.concat_ws("\n\n", F.transform("_texts", lambda e: e["_text"]))
    return questions.join(joined, "_seed").select("question", "sql", "part", result.alias("result"))


def question_variants(
    seeds: DataFrame, variants: DataFrame, phrasings: DataFrame
) -> DataFrame:
    """Test questions from seeds, their manual variations and their phrasings.

    `seeds(seed_id)`, `variants(seed_id, kind, value)` and `phrasings(seed_id, phrasing_no,
    template)` meet on the seed; `{value}` in a template is replaced by the varied parameter, which
    also travels with the row.
    """
    return (
        seeds.select("seed_id")
        .join(variants, "seed_id")
        .join(phrasings, "seed_id")
        .select(
            "seed_id",
            "kind",
            "value",
            "phrasing_no",
            clean_text(F.replace("template", F.lit("{value}"), F.col("value"))).alias("question"),
        )
    )
