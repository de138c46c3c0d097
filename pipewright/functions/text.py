"""Text and vocabulary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(text: Column) -> Column:
    """Make a text safe for tab-terminated records: no tabs, quotes escaped, single spaces, stripped."""
    t = F.replace(text, F.lit("\t"), F.lit(" "))
    t = F.replace(t, F.lit('"'), F.lit('\\"'))
    t = F.regexp_replace(t, " {2,}", " ")
    return F.btrim(t, F.lit(BLANKS))


def as_title(text: Column) -> Column:
    """A heading always ends with a colon."""
    return F.when(F.endswith(text, F.lit(":")), text).otherwise(F.concat(text, F.lit(":")))


def vocabulary_form(text: Column) -> Column:
    """Spelling-insensitive form of an enum value: `BestCase`, `best_case` and `best case` agree."""
    return F.lower(F.regexp_replace(text, "[_ ]", ""))


def tag_list(tags: Column) -> Column:
    return F.split(tags, ";")


def mentions_risk(note_type: Column, tags: Column, exact_tag: str | None = None) -> Column:
    """A note signals delivery risk by its type or by its tags.

    By default any tag text containing `risk` counts, also inside a longer word. With `exact_tag`
    only that whole tag counts. NULL tags or types never match on their own.
    """
    tagged = (
        F.contains(tags, F.lit("risk"))
        if exact_tag is None
        else F.array_contains(tag_list(tags), exact_tag)
    )
    return F.coalesce(tagged, F.lit(False)) | F.coalesce(note_type == "risk", F.lit(False))


def joined_reasons(*named_flags: tuple[str, Column]) -> Column:
    """Names of the raised flags, in the given order, joined with `; `."""
    return F.concat_ws("; ", *[F.when(flag == 1, F.lit(name)) for name, flag in named_flags])


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def row_fingerprint(columns: list[str]) -> list[Column]:
    """128 bits that stand for a whole row, as `_high` and `_low`.

    The hash functions skip NULLs, so their positions are hashed as well.
    """
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return [
        F.xxhash64(F.lit(1), *values).alias("_high"),
        F.xxhash64(F.lit(2), *values).alias("_low"),
    ]
