"""Word rules and small column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; every other code point belongs to a word.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; null, empty and blank texts have none."""
    none = F.array().cast("array<string>")
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE_RUN, -1)),
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def packed(df: DataFrame, *own: Column) -> DataFrame:
    """The whole input row as one struct ``doc`` beside an operator's own columns.

    Input columns then can't clash with the operator's, whatever their names are.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *own)


def unpacked(df: DataFrame, schema) -> DataFrame:
    """The input columns back out of :func:`packed`, in their order."""
    return df.select(*[F.col("doc").getField(f.name).alias(f.name) for f in schema.fields])


#: Rows of a key beyond which it is met by broadcast, and the most such keys.
HOT, FEW = 1000, 10_000


def meet(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows``, ``total`` of them, with ``keyed``: one row a key, ``n`` being the key's number of rows.

    The rows of a hot key would all be dealt to one task. Keys with more than total / FEW rows are fewer than
    FEW, so these are broadcast and their rows stay where they are. Both inputs are read twice.
    """
    hot = F.col("n") > max(HOT, total // FEW)
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(few.select(key), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(keyed.where(~hot), key))
