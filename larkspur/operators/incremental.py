"""Results kept up to date: only what changed since the last run, and what depends on it, is computed anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Pairs = Callable[[DataFrame], DataFrame]


@dataclass
class Refreshed:
    """run: which one it was, from 1. full: why all was computed ('first', 'version', 'scheduled'), or None. results, dirty
    (id): tables of this run."""

    run: int
    full: str | None
    results: DataFrame
    dirty: DataFrame


def stamped(items: DataFrame, id: str) -> DataFrame:
    """(id, stamp): a hash of all other columns, nulls and empty texts apart. Ids are unique."""
    return items.select(F.col(id).alias("id"), F.sha2(F.to_json(F.struct(*(c for c in sorted(items.columns) if c != id)), {"ignoreNullFields": "false"}), 256).alias("stamp"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, change) of what was added, changed or removed between two tables of stamps."""
    both = now.select("id", F.col("stamp").alias("a")).join(before.select("id", F.col("stamp").alias("b")), "id", "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("id", kind.alias("change")).where("change is not null")


def refresh(items: DataFrame, id: str, path: str, compute: Callable[[DataFrame, DataFrame], DataFrame], keys: Pairs, needs: Pairs, version: str = "1", full_every: int = 10) -> Refreshed:
    """Brings the results at path up to date with items.

    compute(items, ids): the results (with a column ``id``) of the items whose ids are in ids (id). keys(items): (id, key), what
    other items may refer to; needs(items): (id, key), what an item's result depends on. An item is dirty if it was added or
    changed, or needs a key that an added, changed or removed item has or had; results of others are kept as they are.

    The state (stamps, keys, results) of a run is one folder, put in place by one rename when all of it is written, so a run
    that fails leaves the one before it. The first run, one with another version, and every full_every-th one compute all.
    The last two runs are kept."""
    spark = items.sparkSession
    last = _runs(spark, path)
    run = last[-1][0] + 1 if last else 1
    full = "first" if not last else "version" if last[-1][1] != version else "scheduled" if run % full_every == 0 else None
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    put = lambda df, name: (df.write.parquet(f"{staged}/{name}"), spark.read.schema(df.schema).parquet(f"{staged}/{name}"))[1]
    stamps, has = put(stamped(items, id), "stamps"), put(keys(items).select("id", "key").distinct(), "keys")
    if full:
        dirty = put(stamps.select("id"), "dirty")
        put(compute(items, dirty), "results")
    else:
        old = lambda name: spark.read.parquet(f"{path}/run-{last[-1][0]:09d}-{last[-1][1]}/{name}")
        moved = put(changes(stamps, old("stamps")), "changes")
        touched = has.join(moved, "id", "left_semi").select("key").union(old("keys").join(moved, "id", "left_semi").select("key")).distinct()
        dirty = put(moved.where("change <> 'removed'").select("id").union(needs(items).join(touched, "key", "left_semi").select("id")).distinct(), "dirty")
        kept = old("results").join(moved.select("id"), "id", "left_anti").join(dirty, "id", "left_anti")
        put(kept.unionByName(compute(items, dirty)), "results")
    at, fs = _fs(spark, path)
    done = f"{path}/run-{run:09d}-{version}"
    if not fs.rename(at(staged), at(done)):
        raise OSError(f"cannot put run {run} of {path} in place")
    for number, v in last[:-1]:
        fs.delete(at(f"{path}/run-{number:09d}-{v}"), True)
    return Refreshed(run, full, spark.read.parquet(f"{done}/results"), spark.read.parquet(f"{done}/dirty"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the runs in place; what was staged and not put in place goes."""
    at, fs = _fs(spark, path)
    out = []
    for one in fs.listStatus(at(path)) if fs.exists(at(path)) else []:
        name = one.getPath().getName()
        if name.startswith(".staged-"):
            fs.delete(one.getPath(), True)
        elif name.startswith("run-"):
            out.append((int(name[4:13]), name[14:]))
    return sorted(out)
