"""Operator 9, mixing sources to target weights, by entropy balancing.

Each document gets a rate r = min(cap, exp(lambda_s * size / mean size)), the solution of

    min sum r ln r - r   subject to   sum over source s of size * r = target_s,  0 <= r <= cap,

whose convex dual splits by source. Newton steps for all sources at once are sums that Spark takes over the table of
cells (source, size); the driver holds one row per source. Within a source, rates are rounded into whole copies cell
by cell from the largest size down, what a cell is off by being carried to the next, so that a source misses its
target by about its smallest documents. Which documents of a cell get the extra copy is ranked by a hash of doc_id
inside 256 slices of the cell, so a size that a third of all rows share is no single task's work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, text_key, unused, written


def water_fill(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Targets that share the sum of all sizes by weight, none over most times its source's size; the excess is
    shared again by weight among those below. Sources by code point, null last; weights repeat along them."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    free, left = list(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = most * float(sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def solve_dual(cells: DataFrame, targets: dict[str, float], totals: dict[str, float], mean: dict[str, float], cap: float, steps: int = 60, close: float = 1e-7) -> dict[str, float]:
    """lambda by source key. Newton on the dual's gradient, kept inside a bracket; one Spark aggregate a step. A dual that
    is not solved after so many steps is an error, never a result."""
    spark = cells.sparkSession
    lam = {s: 0.0 for s in targets}
    low, high = {s: -math.inf for s in targets}, {s: math.inf for s in targets}
    open_ = {s for s in targets if totals[s] > 0 and abs(targets[s] - totals[s]) > close * targets[s]}
    for s in [s for s in open_ if targets[s] >= cap * totals[s] * (1 - 1e-9)]:
        lam[s] = math.inf
        open_.discard(s)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], mean[s]) for s in sorted(open_)], "sk string, lam double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(now, "sk")
            .groupBy("sk").agg(F.sum(words * F.least(rate, F.lit(cap))).alias("f"), F.sum(F.when(rate < cap, words * x * rate).otherwise(0.0)).alias("d"))
            .collect()
        )
        for r in sums:
            s, off = r["sk"], r["f"] - targets[r["sk"]]
            if abs(off) <= close * targets[s]:
                open_.discard(s)
                continue
            (high if off > 0 else low)[s] = lam[s]
            step = lam[s] - off / r["d"] if r["d"] > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else 2 * lam[s] + (1 if off < 0 else -1)
            lam[s] = step
    if open_:
        raise RuntimeError(f"the dual did not settle for {len(open_)} sources")
    return lam


def _rounded(cap: int):
    def one_source(cells):
        """Copies of each cell of one source: (source, size) cells, as many as the source has distinct sizes."""
        import numpy as np

        cells = cells.sort_values("size", ascending=False, kind="stable")
        carry, out = 0.0, []
        for size, n, rate in zip(cells["size"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy()):
            got = int(min(max(np.floor(n * rate + carry / size + 0.5), 0), cap * n))
            carry += (n * rate - got) * size
            out.append(got)
        return cells.assign(copies=out)[["sk", "size", "n", "copies"]]

    return one_source


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text), source, size, source_size, target, copies.

    Null texts have size 0 and take part with 0 words. The null source is a source, last in order. Ties between equal
    documents are broken by hashes of doc_id and text; rows alike in both are interchangeable. A source of empty texts
    has target 0. An empty table gives an empty one. Extra columns do not matter. Reruns agree."""
    sized = written(docs.select(
        F.col("doc_id"), text_key(F.col("text")).alias("th"), n_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("sk"),
    ), "mix-sizes")
    cells = written(sized.where("size > 0").groupBy("sk", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    spark = docs.sparkSession
    per_source = sized.groupBy("sk").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("sq"), F.first("source").alias("source")).collect()
    sizes = {r["source"]: r["size"] for r in per_source}
    filled = water_fill(sizes, weights, cap)
    totals = {r["sk"]: float(r["size"]) for r in per_source}
    targets = {r["sk"]: filled[r["source"]] for r in per_source}
    mean = {r["sk"]: (float(r["sq"]) / r["size"] if r["size"] else 1.0) for r in per_source}  # of the words' documents
    lam = solve_dual(cells, targets, totals, mean, float(cap))
    rows = [(s, int(totals[s]), float(targets[s]), mean[s], min(lam[s], 1e300)) for s in sorted(targets)]
    sources = spark.createDataFrame(rows, "sk string, source_size long, target double, mean double, lam double")
    rate = F.when(F.col("lam") >= 1e300, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean")))))
    share = (
        cells.join(sources, "sk").select("sk", "size", "n", rate.alias("rate"))
        .groupBy("sk").applyInPandas(_rounded(cap), "sk string, size long, n long, copies long")
        .withColumn("base", F.floor(F.col("copies") / F.col("n")).cast("long")).withColumn("more", F.col("copies") - F.col("base") * F.col("n"))
    )
    keyed = sized.withColumn("u", F.xxhash64("doc_id", "th", F.lit(17))).withColumn("slice", F.pmod("u", F.lit(256)))
    before = Window.partitionBy("sk", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        keyed.where("size > 0").groupBy("sk", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    )
    plan = slices.join(share, ["sk", "size"]).select("sk", "size", "slice", "base", (F.col("more") - F.col("before")).alias("extra"))
    inside = Window.partitionBy("sk", "size", "slice").orderBy("u", "doc_id", "th")
    return (
        keyed.withColumn("k", F.row_number().over(inside))
        .join(plan, ["sk", "size", "slice"], "left").join(sources.select("sk", "source_size", "target"), "sk")
        .select("doc_id", "th", "source", "size", "source_size", "target",
                F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)).cast("long").alias("copies"))
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs with a column ``copies`` (0 to cap; the name gets underscores where docs has it already).

    Rows alike in doc_id, text and source share what they get evenly, rounded."""
    name = unused(docs, "copies")
    got = (
        mixed(docs, weights, cap).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("source").alias("_s"))
        .agg(F.round(F.avg("copies")).cast("long").alias("_c"))
    )
    mine = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("t"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")) & F.col("row.source").cast("string").eqNullSafe(F.col("_s"))
    return mine.join(got, same).select("row.*", F.col("_c").alias(name))


def op9_mixing(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
