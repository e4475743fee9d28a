"""Helpers that the training-data operators share.

Words are maximal runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is exactly what
``bytes.split()`` gives on UTF-8, and only A-Z are lower-cased, which is exactly what ``bytes.lower()`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import HOT, configured, deal, listed, slot_of, slots_of, table  # noqa: F401
from ..sources.tables import cut as written  # noqa: F401

#: ASCII white space, as characters and as a class for regular expressions.
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, GAP))).otherwise(0).cast("long")


def text_key(text: Column) -> Column:
    """With doc_id it names a row: rows alike in both get the same result anyway."""
    return F.xxhash64(text)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(rows: DataFrame, keys: DataFrame, on: list[str], count: str, by: list[str], parts: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """rows, keys and the columns to join them on, so that no task gets a hot key's rows.

    keys has a row a key and in ``count`` at least how many rows it meets; a hot key is one with more than a HOTth of all of
    them, so there are fewer than HOT, which are listed in the plan. A hot key's rows go to one of ``parts`` tasks by
    the columns ``by``, and the key stands there so many times. keys should be a written table: it is read thrice."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = listed(keys.where(F.col(count) * HOT > total), on)
    return rows.withColumn("_slot", slot_of(hot, by, parts)), keys.withColumn("_slot", slots_of(hot, parts)), [*on, "_slot"]
