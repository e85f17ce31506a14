"""Column expressions over texts and words; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words once letters are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order: runs of lower-cased letters, digits and non-ASCII characters. Null gives none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def folded_words(text: Column) -> Column:
    """As many words at the same places, with non-ASCII letters lower-cased too; cheaper, for candidates.

    Words equal by :func:`words` stay equal: folding maps letter by letter once the one letter
    whose small form depends on its place has been replaced.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3")))
    return F.array_remove(F.split(low, BETWEEN), "")


def once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and ``value``, computed once a row: a generator, so that no later use repeats the expression."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def positions(n: Column) -> Column:
    """0 .. n-1, or an empty array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int) -> Column:
    """The hash of every k words from each position."""
    return F.transform(positions(F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i + 1, k)))


def grams(w: Column, k: int) -> Column:
    """Every k words from each position, joined by a blank."""
    return F.transform(positions(F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(w, i + 1, k)))
