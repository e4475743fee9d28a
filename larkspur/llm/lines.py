"""Operator 3, line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold and reassemble by position.

Only hashes and positions are shuffled for counting; the texts move once, to meet the positions that they lose.
The pairs (hash, doc_id) are made distinct before documents are counted, so the count for a line that a third of
all documents hold is summed map-side; where such a line meets its count, its rows are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, spread, text_key, written


def marked_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of docs: ``row`` (all its columns), ``n_lines``, ``n_dropped``, ``kept`` (the text that is left).

    Null and empty texts are one empty line and stay empty. Rows that share a doc_id are one document when documents
    are counted, and each loses the same lines. A null doc_id is one document, below all others. The largest doc_id
    keeps all its copies of a line. An empty table gives an empty table. Extra columns ride along inside ``row``.
    """
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = written(
        bare.select("doc_id", text_key(F.col("text")).alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", ascii_lower(F.btrim("line", F.lit(WS))))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.unhex(F.md5("key")).alias("h")), "lines",
    )
    common = written(
        lines.select("h", "doc_id").distinct()
        .groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= min_docs), "lines-common",
    )
    many, few, on = spread(lines, common, ["h"], "n", ["doc_id", "th"])
    lost = (
        many.join(few, on).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("lost"))
        .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "lost")
    )
    whole = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    met = whole.join(lost, F.col("row.doc_id").eqNullSafe(F.col("d")) & (text_key(F.col("text")) == F.col("t")), "left")
    split = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("lost"))
    return (
        met.withColumn("n_lines", F.size(split))
        .withColumn("kept", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(split, i)))))
        .select("row", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), "kept")
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines gone from the texts; same columns, n_chars counted anew where there is one."""
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return marked_lines(docs, min_chars, min_docs).select(row.alias("row")).select("row.*")


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    m = marked_lines(docs)
    return m.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
k as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
c as (
  select key, count(distinct doc_id) as n, max(doc_id) as last from k where length(key) >= 40 group by key
  having count(distinct doc_id) >= 5),
m as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.last as lost from k left join c using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from m group by doc_id
"""
