"""Global order without one task that holds everything, and dependency order inside runs of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .graph import waves


def dense_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """df with ``name``: its rows' places in order, 0, 1, 2 and so on, without gaps. Ties are put in order of the other columns
    (rows alike in all are interchangeable; columns must be such as can be sorted).

    Rows are dealt by ranges of the order, sorted where they are and numbered within their partition; the partitions' counts,
    a row each, give what is to be added. The numbered rows are a written table, so that both steps see the same partitions."""
    rest = [c for c in df.columns if c not in order]
    ranked = df.repartitionByRange(*order, *rest).sortWithinPartitions(*order, *rest)
    here = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # its place in the partition
    placed = cut(ranked.select("*", F.spark_partition_id().alias("_part"), here.alias("_at")), "dense")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    return placed.join(counts, "_part").select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def first_seen(df: DataFrame, key: str, order: list[str], name: str = "index") -> DataFrame:
    """(key, index): each key once, numbered from 0 in the order in which keys are first seen."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_f")).select(key, *(F.col(f"_f.{c}").alias(f"_o{i}") for i, c in enumerate(order)))
    return dense_index(firsts, [f"_o{i}" for i in range(len(order))], name).select(key, name)


def islands(items: DataFrame, by: str, at: str, adjacent: str) -> DataFrame:
    """items with ``run``: neighbours in order of ``at`` within ``by`` are of one run while ``adjacent`` is true of the later one."""
    w = Window.partitionBy(by).orderBy(at)
    return items.withColumn("run", F.sum(F.when(F.col(adjacent), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sorted_runs(items: DataFrame, deps: DataFrame) -> DataFrame:
    """(file, run, id, before, after, cyclic): each run of adjacent items in dependency order.

    items: (file, at, id, done, adjacent: nothing but blanks since the item before it); ids are unique in a file and may be
    null. deps: (file, id, needs). A run is ordered in waves: items all of whose needs are placed come next, in the order in
    which they stood; only needs that are open items of the same run count. Items in or behind a cycle stay, as they stood, at
    the end and are named cyclic. before and after: places in the run, from 0."""
    runs = islands(items, "file", "at", "adjacent")
    node = F.concat_ws("\x01", "file", F.col("run").cast("string"), F.col("at").cast("string"))
    named = cut(runs.select("*", node.alias("node")), "runs")
    inside = (
        deps.join(named.select("file", "id", "run", F.col("node").alias("node")), ["file", "id"])
        .join(named.where("not done").select("file", F.col("id").alias("needs"), F.col("run").alias("r"), F.col("node").alias("on")), ["file", "needs"])
        .where("run = r").select(F.col("node").alias("id"), F.col("on").alias("needs"))
    )
    order = waves(named.select(F.col("node").alias("id")), inside).select(F.col("id").alias("node"), "wave")
    run = Window.partitionBy("file", "run")
    return named.join(order, "node").select(
        "file", "run", "id", (F.row_number().over(run.orderBy("at")) - 1).alias("before"),
        (F.row_number().over(run.orderBy(F.asc_nulls_last("wave"), "at")) - 1).alias("after"), F.col("wave").isNull().alias("cyclic"))
