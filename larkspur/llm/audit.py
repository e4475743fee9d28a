"""Operator 11, filter interaction audit: what each filter removes in every order, from difference arrays over Lehmer ranks.

A document is known by its part and by the mask of filters that it fails. In lexicographic order of the permutations, those
that begin with the same letters are neighbours, so a mask is removed at step s (s - 1 letters that it passes, then one that
it fails) in whole intervals of ranks. Each mask's counts are added at the start of an interval and taken away behind its
end; a running sum over the 120 ranks gives every order's figures. Work on documents ends with one row a part and mask; all
that follows is 600 rows a part, however many documents there are.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WS, written

#: What is counted of each mask: documents, those of quality 1, toxic ones.
COUNTS = ["n", "good", "toxic"]
LETTERS = "ABCDE"


def intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of every beginning whose last letter is the first that the mask fails.

    A beginning's first rank is read from its Lehmer code: each letter counts the smaller ones that are left, times the
    orders of what follows. Bit k of a mask is the k-th letter; the number of rows depends on the letters alone."""
    k, out = len(letters), []
    for step in range(1, k + 1):
        for head in permutations(range(k), step):
            first, left = 0, list(range(k))
            for i, x in enumerate(head):
                first += left.index(x) * factorial(k - 1 - i)
                left.remove(x)
            passed = sum(1 << x for x in head[:-1])
            out += [(m, step, first, first + factorial(k - step)) for m in range(1 << k) if m >> head[-1] & 1 and not m & passed]
    return out


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row a part, order of the letters and step, zeros included, from masks: (part, mask, n, good, toxic), one row a
    part and mask, bit k of the mask set where the k-th letter's filter fails; best a written table, as it is read thrice. Parts
    are not null. No parts, no rows."""
    spark, k, orders = masks.sparkSession, len(letters), ["".join(p) for p in permutations(letters)]
    whole = lambda c: F.sum(c).cast("long").alias(c)
    spans = spark.createDataFrame(intervals(letters), "mask int, step int, low int, high int")  # 840 rows for five letters
    end = lambda at, sign: F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in COUNTS))
    changes = masks.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(end("low", 1), end("high", -1))).alias("e")).select("part", "step", "e.*")
    parts = masks.groupBy("part").agg(F.sum("n").cast("long").alias("total"), *(F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias(f"f{i}") for i in range(k)),
                                      *(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"u{i}") for i in range(k)))
    steps, ranks = (F.explode(F.sequence(F.lit(a), F.lit(b))) for a, b in ((1, k), (0, len(orders) - 1)))
    zeros = parts.select("part", steps.alias("step")).select("part", "step", ranks.alias("rank"), *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = (
        changes.unionByName(zeros).groupBy("part", "step", "rank").agg(*map(whole, COUNTS))
        .select("part", "step", "rank", *(F.sum(c).over(along).alias(c) for c in COUNTS))
        .where(F.col("rank") < len(orders))
        .withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1))
        .withColumn("letter", F.expr("substr(filter_order, step, 1)"))
    )
    of = lambda prefix: F.element_at(F.create_map(*(x for i, c in enumerate(letters) for x in (F.lit(c), F.col(f"{prefix}{i}")))), F.col("letter"))
    done = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return here.join(parts, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(done)).alias("kept"), F.col("n").alias("removed"), (of("f") - F.col("n")).alias("redundant"),
        of("u").alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def failing(docs: DataFrame) -> DataFrame:
    """docs without text, with ``bits``: A to D of its mask: under 100 words; fewer than 80 % distinct words; over 10 % of
    capitals; odd symbols. docs has no columns but such as the caller made, so names don't clash; texts are not null."""
    words = docs.withColumn("words", F.split(F.btrim("text", F.lit(WS)), GAP))  # one empty string where there are none
    counted = words.withColumn("counts", F.array(F.size("words"), F.size(F.array_distinct("words")), F.when(F.get("words", F.lit(0)) == "", 0).otherwise(1)))
    n, distinct = (F.get("counts", F.lit(i)) * F.get("counts", F.lit(2)) for i in (0, 1))
    fails = [n < 100, distinct * 100 < n * 80, F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 10, F.col("text").rlike("[#$%&*|]")]
    bits = [F.when(b, 1 << i).otherwise(0) for i, b in enumerate(fails)]
    return counted.withColumn("bits", bits[0] + bits[1] + bits[2] + bits[3]).drop("text", "words", "counts")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs by lang; bit E: a smaller doc_id has the same text, in any part.

    Only ids, hashes and masks are shuffled, never texts. Rows meet by (doc_id, text) first, then by text and part, where
    copies are counted before they are sent on, so a text that a third of all rows hold is a few rows a part by the time
    that its smallest doc_id is looked up. Null texts are empty texts, null parts are ''. Repeated rows count each and are
    no copies of one another (their doc_id is not smaller). A null doc_id is below all others and has no labels; a document
    with several labels is good (toxic) if any of them says so. Extra columns are not looked at."""
    text = F.coalesce("text", F.lit(""))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    facts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"))
    kind = ["h", "part", "bits", "good", "toxic"]
    rows = failing(facts).join(said, "doc_id", "left").na.fill(False, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min(F.struct("first.doc_id")).over(Window.partitionBy("h"))
    firsts = F.when(F.struct("first.doc_id").eqNullSafe(least), F.col("first.n")).otherwise(0)
    split = cells.withColumn("firsts", firsts).select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("firsts").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", (F.col("bits") + F.col("x.e")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def op11_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(written(document_masks(docs, labels), "masks"))


OP11_SQL = r"""
with recursive w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
f as (
  select doc_id, part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
         doc_id > min(doc_id) over (partition by t) as e
  from w),
g as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (
  select part, a, b, c, d, e, count(*) as n, count(*) filter (where good = 1) as good, count(*) filter (where toxic = 1) as toxic
  from f left join g using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select x as o from letters union all
  select o || x from orders, letters where not contains(o, x)),
steps as (
  select o, unnest([1, 2, 3, 4, 5]) as step from orders where length(o) = 5),
fails as (
  select m.*, o, step, substr(o, step, 1) as x,
         [x for x in ['A', 'B', 'C', 'D', 'E'] if case x when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end] as failing
  from m, steps),
told as (
  select *, list_contains(failing, x) as own,
         len([y for y in failing if instr(o, y) < step]) > 0 as before
  from fails),
r as (
  select part, o, step, x, sum(n) filter (where not own and not before) as kept, sum(n) filter (where own and not before) as removed,
         sum(n) filter (where own and before) as redundant, sum(n) filter (where own and len(failing) = 1) as unique_fails,
         sum(good) filter (where own and not before) as good_lost, sum(toxic) filter (where own and not before) as toxic_lost
  from told group by all)
select part, o as filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, x))::bigint as shapley
from r
"""
