"""Sources and sinks: delimited statements, JSON event logs, upserts into Parquet tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where it names none, one of our own in local mode (tests); on a
    cluster that is an error, as a folder of the driver's machine would scatter tables over the executors' disks."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not known:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that go when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; afterwards they are as before."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """df as a compressed table in the shared folder, read again, so that loops don't pile up their lineage. It goes when
    the session ends; instead_of (a table that cut gave before) goes as soon as df is written, as do the shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    old = getattr(instead_of, "_cut_at", None)
    if old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


#: At most so many keys are hot, each with more than one in HOT of all rows.
HOT = 500


def deal(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str], total: int | None = None, parts: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """rows, keys and the columns to join them on, so that no task gets a hot key's rows.

    A key with more than a HOTth of all rows is hot: there are fewer than HOT, so they are listed in the plan, and neither side meets
    a table of them. A hot key's rows go to one of ``parts`` tasks by the columns ``by``, and it stands so many times in keys. rows
    should be a written table (it is read twice, and counted where no total is given)."""
    total = rows.count() if total is None else total
    hot = listed(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT > total), on)
    return rows.withColumn("_slot", slot_of(hot, by, parts)), keys.withColumn("_slot", slots_of(hot, parts)), [*on, "_slot"]


def listed(keys: DataFrame, on: list[str]) -> Column:
    """Whether a row's key is one of keys, fewer than HOT rows. Nulls are no key."""
    known = [r for r in keys.select(*on).collect() if None not in r]
    if len(on) == 1:
        return F.coalesce(F.col(on[0]).isin([r[0] for r in known]), F.lit(False)) if known else F.lit(False)
    out = F.lit(False)
    for r in known:
        out = out | F.coalesce(reduce(and_, (F.col(c) == v for c, v in zip(on, r))), F.lit(False))
    return out


def slot_of(hot: Column, by: list[str], parts: int) -> Column:
    return F.when(hot, F.pmod(F.xxhash64(*by), F.lit(parts))).otherwise(F.lit(0)).cast("int")


def slots_of(hot: Column, parts: int) -> Column:
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A ledger with a header; a missing path is an empty relation."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding=encoding, mode="PERMISSIVE").withColumn("_source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows of the same key replaced and others added; the last of equal keys in rows wins by column order."""
    fresh = rows.groupBy(*key).agg(*(F.max_by(c, F.struct(*rows.columns)).alias(c) for c in rows.columns if c not in key)).select(*rows.columns)
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)
