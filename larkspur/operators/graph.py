"""Dependency graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, deal


def waves(nodes: DataFrame, deps: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes (id) by the wave in which all they depend on (id, needs) is done; those in or behind a cycle, or behind an
    unknown node, have none. Each round is a join and an aggregate over the edges still open; rounds end when no node is
    ready, so there are as many as waves; more than a stated most raise."""
    done = None
    left = cut(nodes.select("id").distinct())
    edges = cut(deps.select("id", "needs").distinct())
    for wave in count():
        open_ = edges.join(left, "id").select("id").distinct()
        ready = cut(left.join(open_, "id", "left_anti").withColumn("wave", F.lit(wave).cast("long")))
        if ready.isEmpty():
            break
        if wave == most:
            raise RuntimeError("waves did not settle")
        done = ready if done is None else done.unionByName(ready)
        if wave % 50 == 49:
            done = cut(done)
        left = cut(left.join(ready.select("id"), "id", "left_anti"), "waves", left)
        edges = cut(edges.join(ready.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", "needs"), "waves", edges)
    rest = left.withColumn("wave", F.lit(None).cast("long"))
    return rest if done is None else done.unionByName(rest)


def ready_set(nodes: DataFrame, deps: DataFrame, finished: DataFrame) -> DataFrame:
    """Unfinished nodes whose dependencies are all finished."""
    unmet = deps.join(finished.select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct()
    return nodes.select("id").join(finished, "id", "left_anti").join(unmet, "id", "left_anti")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (u, v), by alternating large-star and small-star
    until nothing changes. Where a hot node's edges meet its minimum they are dealt over many tasks."""
    ordered = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(ordered(edges.select("u", "v")), "components")
    state, n = None, now.count()
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        many, few, on = deal(both, low, ["u"], ["v"], 2 * n)
        large = many.join(few, on).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        many, few, on = deal(large, low, ["u"], ["v"], 2 * n)
        small = many.join(few, on).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(ordered(small.unionByName(low.select("u", F.col("m").alias("v")))), "components", now)
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, n = new, new[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cycles(deps: DataFrame) -> DataFrame:
    """Nodes of edges (id, needs) that lie on a cycle or between two: what peeling from both ends leaves. A round takes one
    node off both ends of every path, so there are half as many as the longest has."""
    edges = cut(deps.select("id", "needs").distinct())
    n = edges.count()
    while True:
        left = cut(edges.join(edges.select(F.col("id").alias("needs")).distinct(), "needs", "left_semi").join(edges.select(F.col("needs").alias("id")).distinct(), "id", "left_semi").select("id", "needs"), "cycles", edges)
        m = left.count()
        if m == n:
            return left.select("id").distinct()
        edges, n = left, m
