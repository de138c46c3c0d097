"""Seller notes: digest per opportunity, and tag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.functions.text import tag_list
from pipewright.operators.digest import ordered_digest, whole_digest
from pipewright.tables import Tables

SEPARATOR = ";\n\n"


def dated(at: str, text: Column) -> Column:
    return F.concat(F.date_format(F.col(at), "M/d/yyyy"), F.lit(": "), text)


def note_texts(t: Tables, only: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(opp_id, notes_month, opp_notes): the notes of each opportunity and calendar month, oldest
    first. Months in order give all notes. `only` restricts the work to some opportunities. With
    `whole` an opportunity has one text with all its notes, and no month."""
    lines = t.opportunity_notes.select(
        "opp_id",
        "note_at",
        F.trunc("note_at", "month").alias("notes_month"),
        dated("note_at", F.col("note_text")).alias("line"),
    )
    if whole:
        return whole_digest(
            lines, ["opp_id"], ["note_at", "line"], "line", SEPARATOR, "opp_notes", only
        )
    return ordered_digest(
        lines,
        keys=["opp_id"],
        order=["note_at", "line"],
        line="line",
        separator=SEPARATOR,
        out="opp_notes",
        parts=("notes_month",),
        only=only,
    )


def last_signals(t: Tables) -> DataFrame:
    """The type of each opportunity's latest note; notes of a day are told apart by id."""
    latest = F.max_by("note_type", F.struct("note_at", "note_id"))
    return t.opportunity_notes.groupBy("opp_id").agg(latest.alias("last_signal"))


def note_digest(t: Tables, whole: bool = False) -> DataFrame:
    """`note_texts` and the last signal of all opportunities that have notes."""
    return note_texts(t, whole=whole).join(last_signals(t), "opp_id")


def tag_counts(t: Tables) -> DataFrame:
    """Number of notes per tag and note type."""
    return (
        t.opportunity_notes.select(F.explode(tag_list(F.col("tags"))).alias("tag"), "note_type")
        .groupBy("tag", "note_type")
        .agg(F.count("*").alias("num_notes"))
    )
