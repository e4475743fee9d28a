"""Sinks that replace whole months at once: staged, checked, renamed; closed months are frozen."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Frozen(RuntimeError):
    """A closed month was to be overwritten without force."""


class Rejected(RuntimeError):
    """A check found rows that must not be written."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """Brings a table to a whole state after a commit that was cut off: a month whose new files are not in place gets its old
    ones back; staged and replaced files go. Called before each commit; harmless when nothing is amiss."""
    at, fs = _fs(spark, path)
    if not fs.exists(at(path)):
        return
    for one in fs.listStatus(at(path)):
        name = one.getPath().getName()
        if name.startswith(".old-"):
            month = name.split("~", 1)[1]
            if fs.exists(at(f"{path}/{month}")):
                fs.delete(one.getPath(), True)
            elif not fs.rename(one.getPath(), at(f"{path}/{month}")):
                raise OSError(f"cannot bring back {month} of {path}")
        elif name.startswith(".staged-"):
            fs.delete(one.getPath(), True)


def write_months(df: DataFrame, path: str, month: str, open_from: str, force: bool = False, checks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> list[str]:
    """Replaces the months (values of the column ``month``) of the table at path that df has, and gives their names.

    A month before ``open_from`` is closed: if the table has it already, nothing at all is written and Frozen names it, unless
    force says so. Everything is staged by one job beside the table first; checks (name: rows that must not be) look at the
    staged rows, and any such row means Rejected. Only then do months change, each by two renames, so a job that fails, is
    refused or is rejected leaves every month as it was, and a commit that is cut off between them is mended by the next
    ``recover``. One writer at a time, as with any table of files. A null month is an error."""
    spark = df.sparkSession
    at, fs = _fs(spark, path)
    recover(spark, path)
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(month).parquet(staged)
        names = sorted(x.getPath().getName() for x in fs.listStatus(at(staged)) if x.isDirectory() and "=" in x.getPath().getName())
        if f"{month}=__HIVE_DEFAULT_PARTITION__" in names:
            raise Rejected(f"rows without {month}")
        closed = [n for n in names if n.split("=", 1)[1] < open_from and fs.exists(at(f"{path}/{n}"))]
        if closed and not force:
            raise Frozen(f"closed: {', '.join(closed)}")
        for check, bad in (checks or {}).items():
            if names and not bad(spark.read.schema(df.schema).parquet(staged)).isEmpty():
                raise Rejected(check)
        for n in names:
            old = f"{path}/.old-{uuid.uuid4().hex}~{n}"
            if fs.exists(at(f"{path}/{n}")) and not fs.rename(at(f"{path}/{n}"), at(old)):
                raise OSError(f"cannot put {n} of {path} aside")
            if not fs.rename(at(f"{staged}/{n}"), at(f"{path}/{n}")):
                raise OSError(f"cannot put {n} of {path} in place")
            fs.delete(at(old), True)
        return [n.split("=", 1)[1] for n in names]
    finally:
        recover(spark, path)


def read_months(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that write_months keeps; one without months yet is empty. Staged and replaced files are hidden from readers."""
    at, fs = _fs(spark, path)
    if not fs.exists(at(path)) or not any("=" in x.getPath().getName() and not x.getPath().getName().startswith(".") for x in fs.listStatus(at(path))):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def month_of(day: str):
    return F.date_format(day, "yyyy-MM")
