"""Operator 12, exact top-k search: exhaustive term-at-a-time accumulation of sparse query rows over postings.

A vector's dimensions are its terms. A block of candidates is turned into postings (rows and weights of each dimension); a
block's queries then add weight times weight into dense arrays of scores, one term at a time, and the best of every array
are found by partition selection. Blocks' winners are merged per query. Every query meets every candidate; nothing is
pruned, so the results are exact.

Layout: candidates stand in blocks by a hash, queries in waves of at most ``WAVE`` rows. A wave is one job: it sends its
queries to all blocks, each block is one task's work of bounded size, and its winners are written, so disk use does not grow
with the number of waves and a lost executor costs a block. The work is queries times rows, as the exhaustive search asks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates (at most as many as are expected of a hash, at least LEAST), blocks aimed at, queries of a wave.
BLOCK, LEAST, BLOCKS, WAVE = 65_536, 4_096, 64, 16_384
#: Queries whose scores are held at once.
AT_ONCE = 64
HITS = "query_id long, qkey binary, copies long, vec_id long, n long, score long, own boolean"


def whole_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, w: floor(scale * x) of every component, n: rows alike in both). Rows whose vector is null, or holds a null
    or a component that is not finite when scaled, are left out; components beyond a long count as the nearest one."""
    w = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = F.col("w").isNotNull() & ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high = float(-(1 << 63)), float((1 << 63) - 1024)
    return (
        rows.select(F.col(id).cast("long").alias("vec_id"), w.alias("w")).where(usable)
        .withColumn("w", F.transform("w", lambda x: F.floor(F.greatest(F.least(x, F.lit(high)), F.lit(low)))))
        .groupBy("vec_id", "w").agg(F.count(F.lit(1)).alias("n"))
    )


def _dense(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, short rows filled with zeros, which add nothing to any product."""
    lists = column.combine_chunks()
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out, sizes


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest kind of number in which no inner product of rows of a and b overflows; Python's own where none does."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    most = top(a) * top(b) * max(min(a.shape[1], b.shape[1]), 1)
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, the first of equal ones, by partition selection."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _score_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one block for each query: term at a time into dense score arrays."""
    ids = candidates["vec_id"].combine_chunks()
    order = pa.compute.sort_indices(ids, null_placement="at_end")  # the first of equal scores is the one with the smallest id
    candidates = candidates.take(order)
    rows, sizes = _dense(candidates["w"])
    asked, lengths = _dense(queries["w"])
    kind, width = _kind(rows, asked), min(rows.shape[1], asked.shape[1])
    postings = [(j, at, rows[at, j].astype(kind)[:, None]) for j in range(width) if len(at := np.flatnonzero(rows[:, j]))]
    picked, said, values = [], [], []
    for start in range(0, len(asked), AT_ONCE):
        some = asked[start : start + AT_ONCE].astype(kind)
        scores = np.zeros((len(rows), len(some)), dtype=kind)
        for j, at, weights in postings:
            terms = np.flatnonzero(some[:, j])
            if len(at) == len(rows):
                scores[:, terms] += weights * some[terms, j]
            else:
                scores[np.ix_(at, terms)] += weights * some[terms, j]
        if kind is object:  # scores beyond a long count as the nearest one
            scores = np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1).astype(np.int64)
        for q, line in enumerate(np.ascontiguousarray(scores.T)):
            best = _best(line, k)
            picked.append(best)
            said.append(np.full(len(best), start + q))
            values.append(line[best])
    picked, said, values = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (picked, said, values))
    hits, of = candidates.take(pa.array(picked)), queries.take(pa.array(said))
    same = pa.compute.fill_null(pa.compute.equal(hits["vec_id"], of["vec_id"]), False).to_numpy() & (sizes[picked] == lengths[said])
    if same.any():
        same[same] = (rows[picked[same], :width] == asked[said[same], :width]).all(axis=1)
    return pa.table({"query_id": of["vec_id"], "qkey": of["qkey"], "copies": of["n"], "vec_id": hits["vec_id"], "n": hits["n"], "score": pa.array(values.astype(np.int64)), "own": pa.array(same)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest inner products with all rows but itself, ties to the
    smaller vec_id (null ids last), all of them if there are fewer.

    vectors and queries: tables of ``whole_vectors``, written ones best; queries are rows of vectors. Vectors of different
    lengths meet in the dimensions that both have. Rows alike in id and vector are searched once and count each; of a query's
    own ones, one goes if it is among its k + 1 best. Scores beyond a long count as the nearest one. No queries or no other rows give no rows."""
    spark, m = vectors.sparkSession, k + 1
    n_rows, n_queries = vectors.count(), queries.count()
    blocks = max(1, math.ceil(n_rows / min(max(math.ceil(n_rows / BLOCKS), LEAST), BLOCK)))
    waves = max(1, math.ceil(n_queries / WAVE))
    text = F.array_join(F.transform("w", lambda x: x.cast("string")), ",")
    asked = queries.withColumn("qkey", F.unhex(F.md5(text)))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "w"), F.lit(blocks)))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    score = lambda left, right: _score_block(left, right, m)
    found = None
    for wave in range(waves):
        sent = asked.where(F.pmod(F.xxhash64("vec_id", "qkey"), F.lit(waves)) == wave).withColumn("block", everywhere)
        hits = placed.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(score, HITS)
        first = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        best = hits.withColumn("r", F.row_number().over(first)).where(F.col("r") <= m).drop("r")  # rows alike are one here
        best = written(best, "topk") if waves > 1 else best
        found = best if found is None else found.unionByName(best)
    each = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(m)).cast("int"))))
    query = Window.partitionBy("query_id", "qkey")
    own = F.min(F.when(F.col("own"), F.col("r"))).over(query)
    ranked = (
        each.withColumn("r", F.row_number().over(query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
        .withColumn("self", own).where(F.col("self").isNull() | (F.col("r") != F.col("self")))
        .withColumn("rank", F.col("r") - F.when(F.col("r") > F.col("self"), 1).otherwise(0)).where(F.col("rank") <= k)
    )
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_k(embeddings: DataFrame) -> DataFrame:
    vectors = written(whole_vectors(embeddings), "vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP12_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as w, row_number() over () as r
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and q.r <> c.r),
t as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s)
select query_id, rank::int as rank, vec_id, score from t where rank <= 5
"""
