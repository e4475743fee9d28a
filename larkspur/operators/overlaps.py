"""Pairs of sets that share enough members, and the pairs of sources and topics that follow from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .containment import naming

#: Sets of up to so many members meet by twos of their members.
SMALL = 32


def set_overlaps(left: DataFrame, right: DataFrame, least: int = 1, ranks: DataFrame | None = None) -> DataFrame:
    """(a, b, n): pairs of a set of left and one of right, each (id, member) by rows, that share n >= least members.

    Members are put in order of rarity over both sides. Of two sets that share ``least`` members, one is among the first
    size - least + 1 of each, so only these prefixes are joined; sets of fewer members than that are in no pair. The prefix
    pairs are made distinct and verified on whole sets, gathered once a set. For least = 2 sets of at most SMALL members meet by
    twos of members instead, so that only pairs of the result meet. Repeated members count once, nulls not at all. With
    ranks (member, df; a row a member) there is also ``rarest``: the least (df, member) that both hold."""
    if least < 1:
        raise ValueError("least must be at least 1")
    if ranks is not None and least == 1:  # whole sets are their prefixes, so the pairs are counted, and ranked, as they meet
        a, b = (d.where("id is not null and member is not null").select(F.col("id").alias(x), "member").distinct() for d, x in ((left, "a"), (right, "b")))
        return a.join(b.join(ranks, "member"), "member").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "member")).alias("rarest"))
    if ranks is not None:
        pairs = set_overlaps(left, right, least)
        both = pairs.join(left.select(F.col("id").alias("a"), "member").distinct(), "a").join(right.select(F.col("id").alias("b"), "member").distinct().join(ranks, "member"), ["b", "member"])
        return both.groupBy("a", "b").agg(F.first("n").alias("n"), F.min(F.struct("df", "member")).alias("rarest"))
    return _by_twos(left, right) if least == 2 else _by_prefixes(left, right, least)


def _by_twos(left: DataFrame, right: DataFrame) -> DataFrame:
    """set_overlaps for least = 2. Two sets share n members if and only if they share n (n - 1) / 2 twos of members, so the twos
    that meet are counted, and no pair meets that is not in the result. Sets of more than SMALL members go by prefixes."""
    gathered = lambda d: cut(d.where("id is not null and member is not null").groupBy("id").agg(F.array_sort(F.collect_set("member")).alias("s")).where(F.size("s") >= 2), "sets")
    a = gathered(left)
    b = a if left is right else gathered(right)
    small, large = F.size("s") <= SMALL, F.size("s") > SMALL
    twos = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = lambda d, name: d.where(small).select(F.col("id").alias(name), F.explode(twos).alias("m")).select(name, "m.x", "m.y")
    told = met(a, "a").join(met(b, "b"), ["x", "y"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    out = told.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("n"))
    rows = lambda d, which: d.where(which).select("id", F.explode("s").alias("member"))
    if not a.where(large).isEmpty():
        out = out.unionByName(_by_prefixes(rows(a, large), rows(b, F.lit(True)), 2))
    if not b.where(large).isEmpty():
        out = out.unionByName(_by_prefixes(rows(a, small), rows(b, large), 2))
    return out


def _by_prefixes(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    a, b = (d.where("id is not null and member is not null").select("id", "member").distinct() for d in (left, right))
    rare = a.unionByName(b).groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    both = a.select("member").distinct().join(b.select("member").distinct(), "member", "left_semi")  # others are in no pair

    def prefix(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        known = d.join(both, "member", "left_semi").join(rare, "member")
        sets = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "member"))).alias("s")).where(F.size("s") >= least)
        heads = sets.select(F.col("id").alias(name), F.explode(F.slice("s", 1, F.size("s") - (least - 1))).alias("m")).select(name, "m.member")
        return sets.select(F.col("id").alias(name), F.transform("s", lambda x: x["member"]).alias(f"set_{name}")), heads

    (sets_a, heads_a), (sets_b, heads_b) = prefix(a, "a"), prefix(b, "b")
    if least == 1:  # whole sets are their prefixes, so the pairs can be counted as they meet
        return heads_a.join(heads_b, "member").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = heads_a.join(heads_b, "member").select("a", "b").distinct()
    met = pairs.join(sets_a, "a").join(sets_b, "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("n"))
    return met.where(F.col("n") >= least)


#: Meetings of a block of sources and a block of topics, on average, up to so many blocks, and beyond them: more blocks mean more copies of
#: the links. A block's sources are taken in runs of so many meetings, or of one source.
MEETINGS, BLOCKS, LARGE, RUN = 2_000_000, 64, 64_000_000, 1_000_000


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each pair of a block of sources and one of topics shares, by k. Rows: source or topic, k, member, df of a topic's."""
    rows = pa.Table.from_batches(batches)
    alone = {"use_threads": False}
    left, right = (rows.filter(which) for which in (pc.invert(rows["asked"]), rows["asked"]))
    keys = right.group_by(["k", "member"], **alone).aggregate([("df", "min")]).sort_by([("df_min", "ascending"), ("member", "ascending")])
    keys = keys.append_column("at", pa.array(np.arange(len(keys))))
    coded = lambda rows, name: rows.select([name, "k", "member"]).join(keys.select(["k", "member", "at"]), ["k", "member"], join_type="inner", **alone).select([name, "at"])
    sources, topics = coded(left, "source").sort_by("source").combine_chunks(), coded(right, "topic")
    if not len(sources):
        return
    weight = np.bincount(topics["at"].to_numpy(), minlength=len(keys))[sources["at"].to_numpy()]
    code = sources["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    piece = (np.cumsum(weight) - weight)[first] // RUN
    starts = first[np.r_[True, piece[1:] != piece[:-1]]]
    kinds = keys["k"].to_numpy()
    for start, end in zip(starts, [*starts[1:], len(sources)]):
        met = sources.slice(start, end - start).join(topics, "at", join_type="inner", **alone)
        at = met["at"].to_numpy()
        k = kinds[at]
        one = pa.table([met["source"], met["topic"], pa.array(k == 0), pa.array(at, mask=k != 1), pa.array((k == 2).astype("int64"))], ["source", "topic", "slug", "at", "two"])
        told = one.group_by(["source", "topic"], **alone).aggregate([("slug", "any"), ("at", "count"), ("two", "sum"), ("at", "min")])
        yield from pa.table([told["source"], told["topic"], told["slug_any"], told["at_count"], told["two_sum"], keys["df_min"].take(told["at_min"]), keys["member"].take(told["at_min"])], ["source", "topic", "slug", "n1", "n2", "df", "member"]).combine_chunks().to_batches(100_000)


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, topic, slug, n1, n2, df, member) of every pair that shares a member of one k. Sources and topics are dealt into blocks,
    and each block of one meets each of the other in one task, so links are shuffled in some copies and pairs not at all."""
    left, right = cut(left, "left"), cut(right, "right")
    counted = lambda d, n: d.groupBy("k", "member").agg(F.count(F.lit(1)).alias(n))
    known = cut(counted(left, "l").join(counted(right, "r"), ["k", "member"]), "known")
    l, r, meetings = known.agg(*(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) for c in ("l", "r")), F.coalesce(F.sum(F.col("l").cast("double") * F.col("r")), F.lit(0.0))).first()
    blocks = max(1.0, min(meetings / MEETINGS, BLOCKS), meetings / LARGE)
    across = min(max(1, round(math.sqrt(blocks * r / l))) if l else 1, math.ceil(blocks))
    down = math.ceil(blocks / across)
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda d, s, t: d.join(known.select("k", "member"), ["k", "member"], "left_semi").withColumn("_s", s).withColumn("_t", t)
    null = lambda kind: F.lit(None).cast(kind)
    asks = dealt(left, one("source", down), every(across)).withColumns({"topic": null(right.schema["topic"].dataType), "df": null("long"), "asked": F.lit(False)})
    met = asks.unionByName(dealt(right, every(down), one("topic", across)).withColumns({"source": null(left.schema["source"].dataType), "asked": F.lit(True)}))
    kinds = ", ".join(f"`{n}` {met.schema[n].dataType.simpleString()}" for n in ("source", "topic"))
    return met.groupBy("_s", "_t").applyInArrow(_told, f"{kinds}, slug boolean, n1 long, n2 long, df long, member {met.schema['member'].dataType.simpleString()}")


def backfill(sources: DataFrame, links: DataFrame, topics: DataFrame, key_links: DataFrame, related: DataFrame, cited: DataFrame, rejected: DataFrame, least: int = 1, weak: int = 25) -> DataFrame:
    """(source, topic, signals, overlap, match, rarest, weak): topics that a source should be cited in.

    sources: (id, title, body); topics: (id, slug); links, key_links and related: (id, member), what a source's body, a topic's
    key section and its metadata link to; cited and rejected: pairs (source, topic) that are out. Signals, in this order:
    slug-match (title or body contain the slug, any case), key-concept-overlap and related-overlap (at least ``least`` common
    links). match: the common link of the key section that stands in the fewest sources (then the first by name), rarest:
    in how many; weak: in ``weak`` or more. A pair without common key links has neither and is not weak."""
    lower: Column = F.lower(F.concat_ws("\n", "title", "body"))
    slugs = topics.where("slug <> ''").select(F.col("id").alias("topic"), F.lower("slug").alias("member")).distinct()
    named = naming(sources.select(F.col("id").alias("source"), lower.alias("text")), slugs.select(F.col("member").alias("pattern")), "source")
    linked = lambda d, name: d.where("id is not null and member is not null").select(F.col("id").alias(name), "member").distinct()
    of = lambda k, d, name, df=None: d.select(name, F.lit(k).alias("k"), "member", *([] if name == "source" else [F.lit(df).cast("long").alias("df") if df is None else F.col(df)]))
    own = cut(linked(links, "source"), "links")
    df = own.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    left = of(0, named.withColumnRenamed("pattern", "member"), "source").unionByName(of(1, own, "source")).unionByName(of(2, own, "source"))
    right = of(0, slugs, "topic").unionByName(of(1, linked(key_links, "topic").join(df, "member"), "topic", "df")).unionByName(of(2, linked(related, "topic"), "topic"))
    key, meta = F.col("n1") >= least, F.col("n2") >= least
    pairs = _shared(left, right).where(F.col("slug") | key | meta).join(cited, ["source", "topic"], "left_anti").join(rejected, ["source", "topic"], "left_anti")
    signals = F.array_join(F.array_compact(F.array(*(F.when(has, F.lit(name)) for has, name in ((F.col("slug"), "slug-match"), (key, "key-concept-overlap"), (meta, "related-overlap"))))), ",")
    return pairs.select("source", "topic", signals.alias("signals"), *(F.when(key, F.col(c)).alias(name) for c, name in (("n1", "overlap"), ("member", "match"), ("df", "rarest")))).withColumn("weak", F.coalesce(F.col("rarest") >= weak, F.lit(False)))
