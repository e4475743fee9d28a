"""Operator 5, MinHash near-dedup: universal hash minima with banding, signature verification, confirmation on full
shingle sets, and connected components by alternating large-star and small-star.

Equal sets collapse to one node first, by an aggregate. In a bucket every node is compared with a pivot only, twice with different
pivots; components of what that confirms are found; then nodes of one bucket in *different* components are paired,
but only where exact bounds leave a link possible (sizes, the shingles shared with anything at all, the triangle
inequality of the Jaccard distance over the pivot, what each lacks of the pivot). The bounds are exact, so a bucket loses no link;
what is lost is lost by chance: a link at a similarity of 0.85 shares none of the 20 bands of 4 minima with a chance of 4e-7
(at 0.80: 2.6e-5), and signatures that agree on fewer than percent - 25 % of their 80 minima are not compared (at 0.85, 20 under
the mean, five standard deviations: about 1e-6). Members of one bucket and size that pass all bounds meet in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected as components
from .common import configured, deal, spread, written

WIDTH, ROWS, BANDS = 5, 4, 20
#: Bytes of a batch that goes to Python (a longer text goes alone), so that workers stay small.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_U = np.uint64
_rng = np.random.default_rng(5)
#: Random odd multipliers and offsets of the multiply-shift family, and a random word for each byte.
_A = _rng.integers(0, 2**63, ROWS * BANDS, dtype=_U) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS, dtype=_U) * _U(2)
_BYTE = _rng.integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_MUL = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(1 << 16, int(_MUL)), _powers(1 << 16, pow(int(_MUL), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of an already lower-cased text, from prefix sums of a polynomial in the bytes."""
    global _POW, _INV
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    if not len(edge):
        return np.empty(0, _U)
    while len(_POW) <= len(b):
        n = 2 * len(_POW)
        _POW, _INV = _powers(n, int(_MUL)), _powers(n, pow(int(_MUL), -1, 2**64))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * _POW[: len(b)], dtype=_U)))
    start, end = edge[::2], edge[1::2]
    return _mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(_U))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; of the whole sequence where there are fewer words."""
    w = word_hashes((text or b"").lower())
    if not len(w):
        return w
    k = min(WIDTH, len(w))
    h = np.zeros(len(w) - k + 1, _U)
    for i in range(k):
        h = h * _MUL + w[i : i + len(h)]
    return np.unique(_mix(h + _U(k)))


def signature(s: np.ndarray) -> np.ndarray:
    x = s >> _U(32)
    out = np.full(len(_A), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        h = (x[i : i + 4096, None] * _A + _B) >> _U(32)
        np.minimum(out, h.min(axis=0).astype(np.uint32), out=out)
    return out


def _signed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        n, h, sig = [], [], []
        for t in b.column("text").cast(pa.binary()):
            s = shingles(t.as_py())
            n.append(len(s))
            h.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "n", "h", "sig"])


def _packed(batches: Iterator) -> Iterator:
    """Texts compressed, so that their shuffle is smaller."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([z.compress(t.as_py() or b"") for t in b.column("text").cast(pa.binary())], pa.binary())], names=["doc_id", "z"])


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        s = [shingles(z.decompress(t.as_py())).view(np.int64) for t in b.column("z")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["node", "n", "s"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v and the sizes of intersection and union, on full sets. pairs is a written table; v may be a pivot of very many."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"))
    many, few, on = deal(pairs, b, ["v"], ["u"])
    both = many.join(a, "u").join(few, on).withColumn("i", F.size(F.array_intersect("su", "sv")).cast("long"))
    return both.select("u", "v", "i", (F.col("nu") + F.col("nv") - F.col("i")).alias("o"))


def _alike(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Signature verification: pairs (a written table) of which at least so many minima agree."""
    a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "uv")
    same = F.aggregate(F.zip_with("su", "sv", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    many, few, on = deal(pairs, b, ["v"], ["u"])
    return many.join(a, "u").join(few, on).where(same >= least).select("u", "v")


def _checked(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    pairs = written(pairs, "near-pairs")
    found = written(_alike(pairs, sigs, least), "near-alike", pairs)
    return _confirmed(found, sets)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), one row per row of docs.

    Links: 100 * intersection >= percent * union. Null and empty texts have no shingles and are linked with nothing.
    Rows with words that share a doc_id are one document when linked; a null doc_id is linked with nothing. Repeated rows give
    repeated rows, an empty table an empty one. Extra columns are left out."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    with configured(spark, BATCH):
        signed = written(docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {kind}, n long, h binary, sig array<int>"), "near-sig")
    named = signed.where("h is not null and doc_id is not null")
    nodes = written(
        named.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("node"), F.min_by(F.struct("n", "sig"), "doc_id").alias("x"))
        .select("h", "k", "node", "x.n", "x.sig"), "near-nodes",
    )
    signed = written(signed.select("doc_id", "n", "h"), "near-ids", signed)
    named = signed.where("h is not null and doc_id is not null")
    sigs = nodes.select("node", "n", "sig")
    # a document that stands there with several texts links their nodes
    mark = F.xxhash64("h")
    several = named.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("doc_id")
    several = written(named.select("doc_id", "h").join(several, "doc_id", "left_semi"), "near-several")
    many, few, on = deal(several, nodes.select("h", "node"), ["h"], ["doc_id"])
    same = many.join(few, on).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * ROWS + 1, ROWS)))
    buckets = sigs.select("node", "n", F.explode(bands).alias("b")).distinct()
    shared = written(buckets.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).where("m > 1"), "near-shared")
    many, few, on = spread(buckets, shared, ["b"], "m", ["node"])
    m1 = written(many.join(few, on).select("b", "node", "n", "m", "pivot"), "near-buckets")
    wanted = m1.select("node").distinct()
    packed = docs.select("doc_id", "text").mapInArrow(_packed, f"doc_id {kind}, z binary")
    texts = packed.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    with configured(spark, BATCH):
        sets = written(texts.mapInArrow(_sets, f"node {kind}, n long, s array<long>").dropDuplicates(["node", "s"]), "near-sets")
    held = sigs.join(sets.select("node"), "node", "left_semi")

    close = percent - 25  # percent of the minima that a candidate has in common at least
    least = ROWS * BANDS * close // 100
    pairs1 = m1.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    far1 = written(_checked(pairs1, held, sets, least), "near-star")
    linked = F.col("i") * 100 >= F.col("o") * percent
    done = far1.where(linked).select(F.col("u").alias("node"), F.col("v").alias("pivot"))
    rest = written(m1.where("node <> pivot and m > 2").join(done, ["node", "pivot"], "left_anti").select("b", "node", "n"), "near-rest")
    second = rest.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("node")).alias("pivot")).where("m > 1")
    many, few, on = deal(rest, second, ["b"], ["node"])
    pairs2 = many.join(few, on).where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    far2 = _checked(pairs2, held, sets, least)
    links = written(far1.where(linked).select("u", "v").unionByName(far2.where(linked).select("u", "v")), "near-links")
    comp = written(components(links), "near-comp")

    # members of one bucket that are still in different components: exact bounds, then the sets themselves
    mine = written(m1.where("m > 2").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "near-mine", m1)
    home = mine.groupBy("b", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.max_by("c", F.struct("k", "c")).alias("home"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    many, few, on = deal(mine, home, ["b"], ["node"])
    mixed = written(many.join(few, on).join(far1.select(F.col("u").alias("node"), F.col("v").alias("pivot"), (1 - F.col("i") / F.col("o")).alias("d")), ["node", "pivot"], "left")
                    .select("b", "node", "pivot", "n", "c", "home", F.when(F.col("node") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("d")).alias("d")), "near-mixed", mine)
    token = sets.join(mixed.select("node").distinct(), "node", "left_semi").select("node", F.explode("s").alias("t"))
    common = token.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("t")
    known = token.join(common, "t", "left_semi").groupBy("node").agg(F.collect_list("t").alias("cs"))
    pivots = sets.select(F.col("node").alias("pivot"), F.col("s").alias("ps"))
    groups = lambda a: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda g: F.size(F.filter(a, lambda t: F.pmod(t, F.lit(64)) == g)))
    lost = (
        mixed.where("node <> pivot").select("node", "pivot").distinct().join(known, "node").join(pivots, "pivot")
        .withColumn("miss", F.array_except("ps", "cs")).withColumn("extra", F.array_except("cs", "ps"))
        .select("node", "pivot", F.size("ps").alias("np"), F.size("cs").alias("w"), F.size("miss").alias("gone"), F.concat(groups(F.col("miss")), groups(F.col("extra"))).alias("g"))
    )
    bound = written(mixed.join(lost, ["node", "pivot"]).where(F.col("w") * 100 >= F.col("n") * percent), "near-bound", mixed)
    per = percent / (100 + percent)
    bin_ = lambda x: F.floor(F.log(x) * 25)
    of = lambda x: [F.col(k).alias(k + x) for k in ("n", "c", "w", "d", "gone", "g")]
    x = bound.where("c <> home").select("b", F.col("node").alias("u"), "np", *of("u"))
    low, high = F.col("nu") * percent / 100, F.least(F.col("nu") * 100 / percent, F.col("wu") / per - F.col("nu"))
    x = x.where(high >= low).withColumn("bin", F.explode(F.sequence(bin_(low), bin_(high))))
    y = bound.select("b", F.col("node").alias("v"), *of("v"), bin_(F.col("n")).alias("bin"))
    # no more can be in both than the pivot's shingles that neither lacks (those both lack counted once: at most what both
    # lack in each of 64 groups) and, of the others found anywhere else, at most what both have in each group
    both = F.col("np") - F.col("goneu") - F.col("gonev") + F.aggregate(F.zip_with("gu", "gv", lambda i, j: F.least(i, j)), F.lit(0), lambda t, k: t + k)
    possible = (
        (F.col("cu") != F.col("cv")) & (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        & (F.least("wu", "wv") >= (F.col("nu") + F.col("nv")) * per - 1e-6)
        & (F.col("du").isNull() | F.col("dv").isNull() | (F.abs(F.col("du") - F.col("dv")) <= 1 - percent / 100 + 1e-9))
        & (both >= (F.col("nu") + F.col("nv")) * per - 1e-6)
    )
    cross = x.join(y, ["b", "bin"]).where(possible).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    more = _checked(cross, held, sets, least).where(linked).select("u", "v")
    final = components(links.unionByName(more).unionByName(same))
    classes = written(nodes.join(final, "node", "left").select("h", "k", F.coalesce("component", "node").alias("component")), "near-classes")
    many, few, on = spread(named.select("doc_id", "n", "h"), classes, ["h"], "k", ["doc_id"])
    alone = signed.where("h is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return many.join(few, on).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(alone)


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; columns as they are. Rows of null doc_id and texts
    without words all stay. Rows that share a doc_id are one document: they stay or go together. No rows: none."""
    found = near_duplicates(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct("*").alias("row"))
    return packed.join(found, F.col("row.doc_id") == F.col("_gone"), "left_anti").select("row.*")


def op5_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as t from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.t = b.t and a.doc_id > b.doc_id group by all),
l as (select u, v from i join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 85 * (a.n + b.n - i)),
e as (select u, v from l union select v, u from l),
r(node, seen) as (select doc_id, doc_id from documents union select r.node, e.v from r join e on r.seen = e.u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select node, min(seen) as component_id from r group by node) c on c.node = d.doc_id
"""
