"""Queries of filters, review answers, merges by method, files and damaged texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ablation, invest, selections, upserts
from ..sources import texts
from ..sources.adapters import INCOME, OTC, TRADES, TX, income, otc, table, trades, transactions
from ..sources.tables import scratch
from .registry import query


def name_map(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_brand").alias("source"), F.when(F.col("p_partkey") % 2 == 0, "Product").otherwise("broker").alias("field"), F.col("p_name").alias("raw_value"), F.upper("p_name").alias("canonical_value"), F.col("p_type").alias("asset_type"))


query("name_map_slice", "select p_partkey as id, p_name as raw_value from part where lower(p_brand) = 'brand#2' and p_partkey % 2 = 0 and contains(lower(p_name), 'ing') and contains(lower(p_name), 's') and lower(p_type) = 'economy' order by p_partkey limit 50")(
    lambda s, d: selections.name_map_slice(name_map(s, d), ["id"], "BRAND#2", "product", "iNg", "S", "economy").select("id", "raw_value"))

query("positions_of_bucket", """select ticker, quantity from (select ticker, sum(case when side = 'C' then quantity else -quantity end) as quantity, cast(ticker[2:] as int) as k from trades group by ticker) where k % 3 = 1 and k % 4 <> 3 and k % 2 = 0""", TRADES)(
    lambda s, d: (lambda k: selections.positions_of(
        trades(s, d).groupBy("ticker").agg(F.sum(F.when(F.col("side") == "C", F.col("quantity")).otherwise(-F.col("quantity"))).alias("quantity"))
        .select("ticker", "quantity", F.when(k % 3 == 0, "rv_br").when(k % 3 == 1, "rv_eua").otherwise("other").alias("bucket"), F.when(k % 4 == 3, "usd").when(k % 4 == 1, "").when(k % 4 == 2, "BRL").alias("currency"), F.when(k % 2 == 0, "ETF").otherwise("acao").alias("type")),
        "rv_eua", "brl", "etf").select("ticker", "quantity"))(F.substring("ticker", 2, 9).cast("int")))

query("history_search", """select ledger, operation, count(*) as n, cast(min(date) as varchar) as first from (select date, 'orders' as ledger, ticker as asset, side as operation from trades union all select date, 'income', ticker, type from income union all select date, 'otc', product, operation from otc)
where date between date '1996-03-01' and date '1997-02-28' and contains(lower(asset || ' ' || operation), '1 d') group by all""", TRADES, INCOME, OTC)(
    lambda s, d: selections.history_of(invest.unified_history(trades(s, d), income(s, d), otc(s, d)).withColumnRenamed("id", "asset").withColumnRenamed("kind", "operation"), search=" 1 D", first="1996-03-01", last="1997-02-28", fields=("asset", "operation"))
    .groupBy("ledger", "operation").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first")))

PREFIXES = {"de": "kb/de/", "en": "kb/en/", "fr": "kb/fr/"}
query("documents_of_types", "select doc_id, 'kb/' || lang || '/' || coalesce(source, '') as path from documents where lang in ('de', 'fr')")(
    lambda s, d: selections.of_types(table(s, d, "documents").select("doc_id", F.concat(F.lit("kb/"), "lang", F.lit("/"), F.coalesce("source", F.lit(""))).alias("path")), PREFIXES, ["de", "fr"]))

query("snapshot_triplets", """select cast(date as varchar) as date, coalesce(n, 0) as balance_rows, coalesce(f, false) as has_file, coalesce(m, false) as listed, array_to_string(list_filter([case when coalesce(f, false) and not coalesce(m, false) then 'stale_manifest' end, case when coalesce(m, false) and not coalesce(f, false) then 'missing_file' end,
case when coalesce(n, 0) > 0 and not (coalesce(f, false) and coalesce(m, false)) then 'interrupted_close' end], lambda x: x is not null), ',') as problems
from (select date, count(*) as n from otc where source = 'manual' and key % 7 = 0 group by date) full join (select distinct date, true as f from otc where key % 5 <> 0) using (date) full join (select distinct date, true as m from otc where key % 3 <> 0) using (date)""", OTC)(
    lambda s, d: selections.triplets(*(otc(s, d).where(w).select("date") for w in ("source = 'manual' and key % 7 = 0", "key % 5 <> 0", "key % 3 <> 0"))).select(F.col("date").cast("string").alias("date"), "balance_rows", "has_file", "listed", "problems"))

query("crypto_names", """select exchange, operation, type, count(*) as n from (select case when lower(trim(c_mktsegment)) = 'building' then 'bipa' else 'mercado_bitcoin' end as exchange, case when c_nationkey % 3 = 0 then 'compra' when c_nationkey % 3 = 1 then 'venda' else 'swap' end as operation,
case when c_nationkey % 2 = 0 then 'acao' else 'household items' end as type from customer) group by all""")(
    lambda s, d: table(s, d, "customer").select(
        scalar.crypto_exchange(F.when(F.col("c_mktsegment") == "BUILDING", " BIPA").otherwise(F.col("c_mktsegment"))).alias("exchange"), scalar.crypto_operation(F.when(F.col("c_nationkey") % 3 == 1, "BRL").otherwise("BTC"), F.when(F.col("c_nationkey") % 3 == 0, "BRL").otherwise("ETH")).alias("operation"),
        scalar.asset_type(F.when(F.col("c_nationkey") % 2 == 0, " AÇÃO").otherwise("Household Items")).alias("type")).groupBy("exchange", "operation", "type").agg(F.count(F.lit(1)).alias("n")))


def answers(s, d):
    """For some rows a category, a supplier, a new day, and up to three answers on tags."""
    t = transactions(s, d).select("seq", "date")
    said = lambda w, n, kind, decision, value, token=None, target=None: t.where(w).select("seq", F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.lit(decision).cast("string").alias("decision"), value.cast("string").alias("value"), F.lit(token).cast("string").alias("token"), F.lit(target).cast("string").alias("target"))
    none = F.lit(None)
    rows = [said("seq % 6 = 0", 1, "category", None, F.lit("first")), said("seq % 12 = 0", 5, "category", None, F.lit("last")), said("seq % 7 = 0", 2, "supplier", None, F.concat(F.lit("X"), "seq")), said("seq % 8 = 0", 3, "boundary", "move", F.date_add("date", 40)),
            said("seq % 9 = 0", 4, "boundary", "keep", none), said("seq % 4 = 0", 6, "tag", "accept", none, "new"), said("seq % 6 = 0", 7, "tag", "merge", none, "home", "travel"), said("seq % 10 = 0", 8, "tag", "reject", none, "work")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


query("answered_rows", """select seq, case when seq % 12 = 0 then 'last' when seq % 6 = 0 then 'first' else category end as category, case when seq % 7 = 0 then 'X' || seq else supplier end as supplier, case when seq % 7 = 0 then 'exact' else 'low' end as confidence,
cast(case when seq % 8 = 0 then tx.date + 40 else tx.date end as varchar) as accrual, array_to_string(list_filter(list_concat(case when seq % 6 = 0 then ['travel'] else tags end, case when seq % 6 = 0 and seq % 5 = 0 then ['work'] else [] end), lambda x: not (x = 'work' and seq % 10 = 0)), '|') || case when seq % 4 = 0 then '|new' else '' end as tags from tx""", TX)(
    lambda s, d: selections.resolved(transactions(s, d).select("seq", "category", "supplier", F.lit("low").alias("confidence"), F.col("date").alias("accrual"), "tags"), answers(s, d))
    .select("seq", "category", "supplier", "confidence", F.col("accrual").cast("string").alias("accrual"), F.array_join("tags", "|").alias("tags")))


def facts(s, d):
    """What is known of some parts, and what line items say of all: a value and how it was found."""
    li = table(s, d, "lineitem")
    known = table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("value"), F.lit("m1").alias("method"))
    sent = li.select(F.col("l_partkey").alias("k"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey") % 5).otherwise(F.col("l_partkey") % 7).alias("value"), F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("method"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("n"))
    return known, sent, ["k"], ["m0", "m1", "m2"]


FACTS = """rows_ as (select p_partkey as k, p_partkey % 7 as value, 'm1' as method, 1 as rank, true as old, 0 as o, 0 as l, 0 as u from part where p_partkey % 3 = 0 union all
select l_partkey, case when l_orderkey % 4 = 0 then l_partkey % 5 else l_partkey % 7 end, 'm' || (l_suppkey % 4), l_suppkey % 4, false, l_orderkey, l_linenumber, l_suppkey from lineitem),
told as (select *, first_value(value) over w as base, row_number() over w as pl from rows_ window w as (partition by k order by old desc, o, l, u, value, method)),
best as (select *, min(case when value = base then rank end) over (partition by k order by pl rows between unbounded preceding and 1 preceding) as b from told)"""
query("merged_facts", "select k, any_value(base) as value, 'm' || min(rank) as method from told where value = base group by k", FACTS)(lambda s, d: upserts.method_merged(*facts(s, d))[0])
query("merge_actions", "select action, count(*) as n from (select case when pl = 1 then 'inserted' when value <> base then 'conflict' when rank < b then 'upgraded' else 'skipped' end as action from best where not old) group by action", FACTS)(
    lambda s, d: upserts.method_merged(*facts(s, d))[1].groupBy("action").agg(F.count(F.lit(1)).alias("n")))


def file_folder(s, d):
    """A text file a customer: its name, and lines of its orders, the first with the segment."""
    at = scratch(s, "files")
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("line"))
    head = rows.select("name").distinct().select("name", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("Data;Segment "), "name").alias("line"))
    rows.unionByName(head).repartition("name").sortWithinPartitions("name", "pos").select("name", "line").write.partitionBy("name").text(at)
    return texts.heads(s, at).withColumn("name", F.regexp_extract("file", "name=([^/]*)/", 1))


BANKS = [(1, "exact", "exact", "BUILDING-3"), (2, "seven", "contains", "-7"), (3, "house", "startswith", "HOUSE"), (4, "urgent", "header", "1-URGENT"), (5, "auto", "startswith", "AUTO"), (6, "late", "contains", "MACH"), (7, "no", "startswith", "HOLD")]
query("file_sources", f"""with l as (select c_mktsegment || '-' || c_nationkey as name, o_orderkey, 'order ' || o_orderkey || ' ' || o_orderpriority as line, row_number() over (partition by c_mktsegment, c_nationkey order by o_orderkey) as r from orders join customer on o_custkey = c_custkey),
f as (select name, 'Data;Segment ' || name || chr(10) || string_agg(line, chr(10) order by r) filter (where r <= 4) as head from l group by name)
select name, (select source from (values {', '.join(f"({r}, '{b}', '{h}', '{p}')" for r, b, h, p in BANKS)}) v(rank, source, how, pattern) where case how when 'exact' then name = pattern when 'contains' then contains(name, pattern) when 'startswith' then starts_with(name, pattern) else contains(head, pattern) end order by rank limit 1) as source from f""")(
    lambda s, d: (lambda files: selections.file_sources(files, s.createDataFrame(BANKS, "rank int, source string, how string, pattern string")).join(files, "file").select("name", "source"))(file_folder(s, d)))

query("latest_documents", "select lang, name from (select lang, lpad(cast(doc_id as varchar), 9, '0') || '.md' as name, row_number() over (partition by lang order by doc_id desc) as r from documents) where r <= 3")(
    lambda s, d: selections.latest(table(s, d, "documents").select("lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("name")), "lang", 3))


def marked(s, d):
    """Documents with words that caution and give reasons, links, and rows of tables."""
    text = F.col("text")
    for a, b in ((" and ", " however "), (" to ", " because "), (" the ", " [[the.md]] ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("| a | 12 |\n| b |\n"), text).alias("text"))


PARTS = "(select id, unnest(range(len(g))) as k, unnest(g) as gap, unnest(h) as hit from (select id, regexp_extract_all(text, '(?s)(.*?)(?:({0})|\\z)', 1) as g, regexp_extract_all(text, '(?s)(.*?)(?:({0})|\\z)', 2) as h from d))"
PLACED = "select id, '{1}' as cls, hit, e - length(hit) as start, e as end_ from (select *, cast(sum(length(gap) + length(hit)) over (partition by id order by k) as bigint) as e from " + PARTS + ") where hit <> ''"
DAMAGED = ["d as (select doc_id as id, '| a | 12 |' || chr(10) || '| b |' || chr(10) || replace(replace(replace(text, ' and ', ' however '), ' to ', ' because '), ' the ', ' [[the.md]] ') as text from documents where text is not null)",
           "found as (" + " union all ".join(
               "select id, cls, start, end_ from (" + PLACED.format(ablation.UNITS[u] or p, c) + ")" + (f" where regexp_matches(hit, '{p}')" if ablation.UNITS[u] else "") for c, (u, p) in ablation.CLASSES.items()) + ")",
           """chosen as (select id, cls, start, end_, unnest(list_filter([0.05, 0.25, 0.5], lambda g: place <= ceil(round(cast(g as double) * n, 9)))) as grade from (select *, row_number() over (partition by id order by r, cls) as place, count(*) over (partition by id) as n from (
select *, row_number() over (partition by id, cls order by md5('|' || id || '|' || cls || '|' || start), start) as r from found)))"""]
query("ablation_counts", "select id, cast(grade as double) as grade, cls, count(distinct start) as eligible, count(distinct start) filter (where hit) as deleted from (select f.*, g.grade, c.start is not null as hit from found f cross join (select unnest([0.05, 0.25, 0.5]) as grade) g left join chosen c on c.id = f.id and c.cls = f.cls and c.start = f.start and c.grade = g.grade) group by all", *DAMAGED)(
    lambda s, d: ablation.graded_counts(ablation.spans(marked(s, d))))
query("ablated_texts", """select id, cast(grade as double) as grade, length(text) as n, sha256(text) as hash from (select id, grade, string_agg(text[a + 1:b], '' order by a) as text from (
select c.id, c.grade, d.text, lag(case when (start = 0 or text[start] = chr(10)) and text[end_ + 1] = chr(10) then end_ + 1 else end_ end, 1, 0) over (partition by c.id, c.grade order by start) as a, start as b from (
  select id, grade, min(start) as start, max(end_) as end_ from (select *, sum(case when start <= b then 0 else 1 end) over (partition by id, grade order by start, end_ rows unbounded preceding) as i from (select *, max(end_) over (partition by id, grade order by start, end_ rows between unbounded preceding and 1 preceding) as b from chosen)) group by id, grade, i
  union all select id, grade, 1000000000, 1000000000 from (select distinct id, grade from chosen)) c join d using (id)) group by id, grade)""", *DAMAGED)(
    lambda s, d: (lambda docs: ablation.without(docs, ablation.graded(ablation.spans(docs))).select("id", "grade", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("hash")))(marked(s, d)))
