"""Retrieval, links, duplicates and page checks over document tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import tokens, url_key

#: Up to so many terms of queries are broadcast.
FEW = 200_000
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "to")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best k documents (id, text) for each query (qid, text): qid, id, score (larger is better), ties by id.

    Only the queries' terms are counted in the documents; document lengths and frequencies cover all of them. The texts are shuffled
    once, by id, and then stay: words are counted and scores summed where the text is (FEW terms at most are broadcast)."""
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    small = F.broadcast if terms.count() <= FEW else lambda d: d
    words = docs.select("id", "text").repartition("id").select("id", tokens(F.col("text")).alias("ts"))
    size = words.select("id", F.size("ts").alias("len"))
    total = size.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg"))
    tf = words.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(small(wanted), "term").groupBy("term", "id", "len").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = (
        tf.join(small(df.crossJoin(F.broadcast(total)).withColumn("idf", idf)), "term").join(small(terms), "term")
        .groupBy("qid", "id").agg(F.round(F.sum(F.col("idf") * weight), 6).alias("score"))
    )
    return top_k(scored, "qid", k)


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of highest score per key, ties by id. Each task keeps the k best of its own before the shuffle (Spark's limit of
    window groups), so no task sorts all rows of a key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _six(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark rounds: halves of the shortest decimal form go up."""
    at, back = np.unique(x, return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if np.isfinite(v) else v for v in at.tolist()])[back]


def _best(v: pd.DataFrame, q: pd.DataFrame, k: int) -> Iterator[tuple]:
    """(qid, id, score) of a block's k best for each query. Products of matrices find who may be among them, to 1e-9; their scores
    are then summed component by component. A vector that is null, holds nulls or has another length scores null, below all."""
    ids, found = v["id"].to_numpy(), [np.array([np.nan] if x is None else x, np.float64) for x in v["v"]]
    lengths = np.array([len(x) for x in found])
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    for n in {len(x) if x is not None else 1 for x in q["q"]}:
        mine = q[[(len(x) if x is not None else 1) == n for x in q["q"]]]
        fit = np.flatnonzero(lengths == n)
        m = np.stack([found[i] for i in fit]) if len(fit) else np.empty((0, n))
        norm = np.sqrt(_summed(m, m))
        step = max(1, (1 << 22) // max(1, len(ids)))
        for i in range(0, len(mine), step):
            some = mine.iloc[i : i + step]
            w = np.stack([np.full(n, np.nan) if x is None else np.array(x, np.float64) for x in some["q"]])
            long = np.sqrt(_summed(w, w))
            rough = np.full((len(w), len(ids)), -np.inf)
            with np.errstate(all="ignore"):
                rough[:, fit] = np.nan_to_num((w @ m.T) / (long[:, None] * norm), nan=-np.inf)
            for j, qid in enumerate(some["qid"]):
                r = rough[j]
                least = np.partition(r, len(r) - k)[len(r) - k] - 2e-6 if len(r) > k else -np.inf
                at = np.flatnonzero(r >= least)
                s = np.full(len(at), -np.inf)
                known = r[at] > -np.inf
                if known.any():
                    x = np.searchsorted(fit, at[known])
                    s[known] = _six(_summed(m[x], w[j]) / (norm[x] * long[j]))
                for y in np.lexsort((place[at], -s))[:k]:
                    yield qid, ids[at[y]], s[y] if s[y] > -np.inf else None


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * (b[i] if b.ndim == 1 else b[:, i])
    return out


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 50, blocks: int = 64) -> DataFrame:
    """Exact best k of vectors (id, v) for each of a stated set of queries (qid, v) by cosine. Vectors stand in blocks by a hash,
    and the queries go to each block, so neither side is ever held as a whole; only k rows a query leave a block."""
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    v = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    q = queries.select("qid", F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(blocks, "block")

    def met(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_best(v, q, k)) if len(v) and len(q) else [], columns=["qid", "id", "score"])

    return top_k(v.groupBy("block").cogroup(q.groupBy("block")).applyInPandas(met, kinds), "qid", k)


def fuse(a: DataFrame, b: DataFrame, k: int = 25, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (qid, id, rank)."""
    both = a.select("qid", "id", "rank").unionByName(b.select("qid", "id", "rank"))
    return top_k(both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score")), "qid", k)


def reranked(ranked: DataFrame, kinds: DataFrame, boosted: Sequence[str], factor: float = 1.25, k: int = 10) -> DataFrame:
    """Order by score times the kind's boost; the score stays as it was."""
    both = ranked.join(kinds, "id").withColumn("boosted", F.round(F.col("score") * F.when(F.col("kind").isin(*boosted), factor).otherwise(1.0), 9))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("boosted"), "id"))
    return both.withColumn("position", rank).where(F.col("position") <= k).select("qid", "id", "score", "position")


def chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """Documents cut at line breaks into chunks of at most size code points (a longer line is one of its own):
    id, pos, n_lines, n_chars. Lines go to the chunk that their running length falls in."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    run = F.sum(F.length("s") + 1).over(Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    slot = F.floor(F.coalesce(run, F.lit(0)) / size)
    return lines.withColumn("slot", slot).groupBy("id", "slot").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("s")).alias("n_chars")).select(
        "id", (F.row_number().over(Window.partitionBy("id").orderBy("slot")) - 1).cast("long").alias("pos"), "n_lines", "n_chars")


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Rows (id, text, url, title) that repeat an earlier one, by content, else url, else title: the first signal wins."""
    out = None
    rest = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), url_key(F.col("url")).alias("url"), F.lower(F.trim("title")).alias("title"))
    for signal in ("content", "url", "title"):
        first = rest.where(F.coalesce(F.col(signal), F.lit("")) != "").groupBy(signal).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        hit = rest.join(first, signal).where("id <> first").select("id", F.lit(signal).alias("signal"), "first")
        out = hit if out is None else out.unionByName(hit.join(out.select("id"), "id", "left_anti"))
    return out


def edges(docs: DataFrame, fan: int = 3) -> DataFrame:
    """Links between documents, derived from ids: src, dst. Of the last ninth some name no document."""
    targets = F.transform(F.sequence(F.lit(1), F.lit(fan)), lambda k: F.floor((F.col("id") * 9 + k * 13) / 8))
    return docs.select(F.col("id").alias("src"), F.explode(targets).alias("dst")).where("src <> dst").distinct()


def broken_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    return links.join(docs.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


def orphans(links: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("id").join(links.select(F.col("dst").alias("id")), "id", "left_anti")


def link_relevance(links: DataFrame, weak: int = 5) -> DataFrame:
    """Document frequency of each target, and per source its rarest target (ties by id); weak where even that is common."""
    df = links.groupBy("dst").agg(F.count(F.lit(1)).alias("df"))
    best = links.join(df, "dst").groupBy("src").agg(F.min(F.struct("df", "dst")).alias("m"))
    return best.select("src", F.col("m.dst").alias("rarest"), F.col("m.df").alias("df"), (F.col("m.df") >= weak).alias("weak"))


def counted_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(id, target, n): how often each text of words (id, w; a row an occurrence) has a name (target, w). FEW names at most are broadcast,
    so that only words that are names are shuffled; with more, words are counted per text before they meet."""
    if names.count() <= FEW:
        return words.join(F.broadcast(names), "w").where("id <> target").groupBy("id", "target", "w").agg(F.count(F.lit(1)).alias("n")).select("id", "target", "n")
    return words.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n")).join(names, "w").where("id <> target").select("id", "target", "n")


def mentions(docs: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that name another (id, name of one word) without linking it: id, target, n. Words meet names in an
    equi-join and are counted per document."""
    hit = counted_names(docs.select("id", F.explode(tokens(F.col("text"))).alias("w")), names.select(F.col("id").alias("target"), F.lower("name").alias("w")))
    return hit.join(links.select(F.col("src").alias("id"), F.col("dst").alias("target")), ["id", "target"], "left_anti").select("id", "target", "n")


def token_overlap(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (a, b texts) that share at least so many words that are no stop words."""
    n = F.size(F.array_intersect(tokens(F.col("a"), STOP), tokens(F.col("b"), STOP)))
    return pairs.withColumn("shared", n.cast("long")).withColumn("fires", n >= least)


def coalesced_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans (id, a, e) as maximal ones."""
    w = Window.partitionBy("id").orderBy("a", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("id", "island").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("island")


def round_robin(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Rows interleaved across classes in the order of a hash, the first share of each class."""
    h = F.md5(F.col("id").cast("string").cast("binary"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(h, "id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return ranked.where(F.col("r") <= F.ceil(F.col("n") * F.lit(share))).select("id", key, F.col("r").cast("long").alias("r"))


def thin_pages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: lines, words of substance (over three letters), their share, and whether it is thin."""
    w = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    good = F.size(F.filter(w, lambda x: F.length(x) > 3))
    base = docs.select("id", F.size(F.split("text", "\n")).alias("lines"), F.size(w).alias("words"), good.alias("good")).where("words > 0")
    return base.select("id", F.col("lines").cast("long").alias("lines"), F.round(F.col("good") / F.col("words"), 6).alias("share")).withColumn("thin", (F.col("lines") >= 3) & (F.col("share") < 0.5)).join(labels, "id", "left")


def html_gate(pages: DataFrame) -> DataFrame:
    """Verdict on each page's body, first reason wins: too small, little prose, low ratio of prose to bytes, accepted."""
    from ..functions.scalar import strip_html

    n, p = F.octet_length("html"), F.length(strip_html(F.col("html")))
    verdict = F.when(n < 16, "tiny").when(p >= 400, "accepted").when(p < 25, "no_prose").when((n >= 2048) & (p / n < 0.005), "sparse").otherwise("accepted")
    return pages.select("page_id", n.cast("long").alias("n_bytes"), p.cast("long").alias("n_prose"), verdict.alias("verdict"))
