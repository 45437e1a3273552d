"""Column expressions that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words for benchmark matching, after A-Z were lower-cased.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is many times faster than ``translate`` and does the same to a
    string of ASCII characters only.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UP, _LOW))


def alnum_words(c: Column) -> Column:
    """Lower-cased words for benchmark matching; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), ALNUM_GAP), "")


def word_count(c: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def key128(c: Column) -> Column:
    """Two independently seeded 64-bit hashes of a string."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each underscored until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
