"""Smaller queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, reports
from ..sources.adapters import INCOME, OTC, QUOTES, TRADES, TX, income, otc, quotes, table, transactions
from .invest_queries import PAIRED
from .pipeline_queries import raw_rows
from .registry import SQL, query
from .rule_queries import ASSETS, assets

query("income_by_type_share", "select type, total, round(total / sum(total) over (), 6) as share from (select type, cast(sum(value) as double) as total from income group by type)", INCOME)(lambda s, d: reports.shares(income(s, d), "type", "value"))
query("maturity_ladder", "select year(maturity) as year, count(*) as n, count(*) filter (where active) as n_active from assets group by 1", ASSETS)(lambda s, d: reports.maturity_ladder(assets(s, d)))
query("latest_filed_fact", """select metric, period, arg_max(value, (filed, value)) as value, cast(max(filed) as varchar) as filed from (select event_type as metric, user_id % 20 as period, cast(ts as date) as filed, value from events) group by metric, period""")(
    lambda s, d: reports.latest_filed(table(s, d, "events").select(F.col("event_type").alias("metric"), (F.col("user_id") % 20).alias("period"), F.to_date("ts").alias("filed"), "value")))
query("market_indicators", """select ticker, close, round(close / before - 1, 6) as change from (select ticker, close, lag(close) over (partition by ticker order by date) as before, row_number() over (partition by ticker order by date desc) as r from quotes) where r = 1 and before is not null""", TRADES, QUOTES)(
    lambda s, d: reports.indicators(quotes(s, d)))
query("filter_options", """select 'bank' as field, bank as value from tx union select 'category', category from tx union select 'currency', currency from tx union select 'source_type', source_type from tx union select 'tag', unnest(tags) from tx""", TX)(
    lambda s, d: reports.options(transactions(s, d)))
query("kind_subdivision", "select source, lang, count(*) as n, case when count(*) >= 10 then 'subdivide' else 'straggler' end as verdict from documents group by source, lang")(lambda s, d: reports.subdivision(table(s, d, "documents")))
query("cross_currency_best", """select fund, seq, score from (select a.seq as fund, b.seq, case when b.description like '%URGENT%' then 100 else 0 end + case when abs(cast(b.amount as double) / cast(a.amount as double)) between 3 and 8 then 10 else 0 end as score,
row_number() over (partition by a.seq order by case when b.description like '%URGENT%' then 100 else 0 end + case when abs(cast(b.amount as double) / cast(a.amount as double)) between 3 and 8 then 10 else 0 end desc, b.seq) as r
from tx a join tx b on a.date = b.date and a.bank <> b.bank and a.currency <> b.currency and b.amount < 0 where a.amount > 0) where r = 1""", TX)(lambda s, d: reports.cross_currency(transactions(s, d)))

#: Unpaired rows only, with words for funding rows, for vendors and for noise; twins as in the pairs.
query("cross_currency_review", """select fund, seq, score from (select fund, seq, score, row_number() over (partition by fund order by score desc, seq) as r from (
select a.seq as fund, b.seq, case when contains(upper(b.description), 'URGENT') or contains(upper(b.description), 'LOW') then 100 else 0 end + case when abs(cast(b.amount as double) / cast(a.amount as double)) between 3 and 8 then 10 else 0 end as score
from twins a join twins b on a.date = b.date and a.bank <> b.bank and a.currency <> b.currency and b.amount < 0 and not contains(upper(b.description), 'PARC')
where a.amount > 0 and contains(upper(a.description), 'REFUND') and a.seq not in (select seq from paired) and b.seq not in (select seq from paired))) where r = 1""", TX,
      "twins as (select seq, date, amount, bank, currency, description from tx union all select seq + 1000000000, date, cast(-amount as decimal(18,2)), 'OTHER', currency, description || ' back' from tx where seq % 7 = 0)", PAIRED,
      "paired as (select distinct unnest([x.a, x.b]) as seq from (select unnest(pairs) as x from (select *, row_number() over (partition by date, currency, size order by k desc) as r from step) where r = 1))")(
    lambda s, d: (lambda raw, pairs: reports.cross_currency(raw, ("urgent", "Low"), ("refund",), ("parc",), pairs.select(F.col("in_seq").alias("seq")).union(pairs.select(F.col("out_seq").alias("seq")))))(raw_rows(s, d), joins.offsetting_pairs(raw_rows(s, d))))

NAMES = [("small ring", "Ring (S)"), ("Red Widget", "Widget, red"), ("BLUE BOLT", "Bolt"), ("hot gear", "Gear")]
query("name_map_lookup", f"""select p_partkey as id, coalesce(a.c, b.c) as canonical, case when a.c is not null then 'exact' when b.c is not null then 'folded' else 'unknown' end as how from part
left join n a on a.r = p_name left join (select lower(r) as r, min(c) as c from n group by 1) b on b.r = lower(p_name)""", f"n(r, c) as (values {', '.join(f'({a!r}, {b!r})' for a, b in NAMES)})")(
    lambda s, d: reports.name_lookup(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), s.createDataFrame(NAMES, "raw string, canonical string")))

query("asset_class_counts", """select class, count(*) as n from (select case when p_type in ('ECONOMY', 'STANDARD') then 'rv_br' when p_type in ('LARGE', 'PROMO') then 'rv_eua' when p_type = 'SMALL' then 'fundos' else 'other' end as class from part) group by class""")(
    lambda s, d: table(s, d, "part").groupBy(reports.asset_class(F.col("p_type"), {"rv_br": ("ECONOMY", "STANDARD"), "rv_eua": ("LARGE", "PROMO"), "fundos": ("SMALL",)}).alias("class")).agg(F.count(F.lit(1)).alias("n")))
query("rate_forms", """select form, count(*) as n from (select case when i = 'PRE' and r is not null then 'prefixed' when i <> 'PRE' and r is not null and coalesce(p, 100) = 100 then 'spread' when i <> 'PRE' and r is null and p is not null then 'percent_of_indexer' else 'invalid' end as form
from (select case p_partkey % 3 when 0 then 'PRE' when 1 then 'IPCA' else 'CDI' end as i, case when p_size % 2 = 0 then p_size / 10.0 end as r, case when p_size % 5 = 0 then 110.0 when p_size % 7 = 0 then 100.0 end as p from part)) group by form""")(
    lambda s, d: table(s, d, "part").groupBy(reports.rate_form(
        F.when(F.col("p_partkey") % 3 == 0, "PRE").when(F.col("p_partkey") % 3 == 1, "IPCA").otherwise("CDI"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 10),
        F.when(F.col("p_size") % 5 == 0, 110.0).when(F.col("p_size") % 7 == 0, 100.0)).alias("form")).agg(F.count(F.lit(1)).alias("n")))
query("size_buckets", "select source, count(*) filter (where coalesce(n, 5000) >= 5000) as large, count(*) filter (where n < 5000) as small from (select source, floor(n_chars / 4) as n from documents) group by source")(
    lambda s, d: table(s, d, "documents").withColumn("b", reports.size_bucket(F.col("n_chars"))).groupBy("source").agg(F.count(F.when(F.col("b") == "large", 1)).alias("large"), F.count(F.when(F.col("b") == "small", 1)).alias("small")))
query("duration_kinds", """select kind, count(*) as n from (select case when n between 80 and 100 then 'quarterly' when n between 350 and 380 then 'annual' end as kind from (select cast(l_shipdate as date) - cast(o_orderdate as date) as n from lineitem join orders on l_orderkey = o_orderkey)) where kind is not null group by kind""")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(reports.duration_kind(F.datediff("l_shipdate", "o_orderdate")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("institutions", "select i as institution, count(*) as n from (select case when c_name like '%0001%' then 'alpha' when c_name like '%01%' then 'beta' when c_name like '%5%' then 'gamma' else 'outros' end as i from customer) group by i")(
    lambda s, d: table(s, d, "customer").groupBy(reports.institution(F.col("c_name"), [("0001", "alpha"), ("01", "beta"), ("5", "gamma")]).alias("institution")).agg(F.count(F.lit(1)).alias("n")))
query("footnote_order", """select id, mark, count(*) as n, row_number() over (partition by id order by min(pos)) as number from (select doc_id as id, unnest(m) as mark, unnest(range(len(m))) as pos from (select doc_id, regexp_extract_all(text, '[#$%&*]{3}') as m from documents)) group by id, mark""")(
    lambda s, d: reports.footnote_order(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "[#$%&*]{3}"))
query("rename_collisions", "select name, count(*) as n from (select trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-') as name from documents) where name <> '' group by name having count(*) > 1")(
    lambda s, d: reports.rename_collisions(table(s, d, "documents").select(F.split("text", "\n").getItem(0).alias("title"))))
query("lead_sentences", """select id, case when length(one) <= 80 then one else regexp_replace(left(one, 80), ' [^ ]*$', '') || '...' end as lead from (select id, case when instr(line, '.') >= 15 then left(line, instr(line, '.')) else line end as one
from (select doc_id as id, trim(string_split(text, chr(10))[1]) as line from documents))""")(lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), reports.lead_sentence(F.col("text")).alias("lead")))
query("routed_dates", """select o_orderkey as id, case when o_orderkey % 3 = 1 then cast(cast(o_orderdate as date) as varchar) end as date from orders""")(
    lambda s, d: table(s, d, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd")).select(F.col("o_orderkey").alias("id"), reports.routed_date(
        F.when(F.col("o_orderkey") % 3 == 0, "none").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("done "), "t", F.lit(" (was "), "t", F.lit(")"))).otherwise(F.concat("t", F.lit(" or 1990-01-01")))).cast("string").alias("date")))
query("snapshot_contamination", """select strftime(date, '%Y-%m') as month, count(*) as n, cast(sum(case when close = prior then 1 else 0 end) as bigint) as repeated from (select *, lag(close) over (partition by ticker order by date) as prior from quotes) group by 1""", TRADES, QUOTES)(
    lambda s, d: reports.contamination(quotes(s, d)))
query("null_last_page", "select id, value from (select c_custkey as id, case when c_custkey % 4 <> 0 then c_acctbal end as value from customer) order by value desc nulls last, id limit 25")(
    lambda s, d: reports.sorted_nulls_last(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("value"))))
query("top_products_by_source", "select source, product, r, cast(v as double) as v from (select *, row_number() over (partition by source order by v desc, product) as r from (select source, product, sum(abs(amount)) as v from otc group by all)) where r <= 2", OTC)(lambda s, d: reports.concentration(otc(s, d)))
query("snippets", "select page_id, left(trim(regexp_replace(html, '[ \\t\\r\\n]+', ' ', 'g')), 240) as snippet from pages")(lambda s, d: table(s, d, "pages").select("page_id", scalar.snippet(F.col("html")).alias("snippet")))
FOLDED = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '\\.md$', ''), '[^a-z0-9]+', '-', 'g'), '-')"
query("fold_keys", f"""select key, count(*) as n from (select {FOLDED.format("c_name || '.MD'")} as key from customer union all select {FOLDED.format("s_name || ' Ação—Café'")} from supplier
union all select {FOLDED.format("regexp_extract(html, '<title>([^<]*)', 1)")} from pages) group by key""")(
    lambda s, d: table(s, d, "customer").select(scalar.fold_key(F.concat("c_name", F.lit(".MD"))).alias("key")).unionAll(table(s, d, "supplier").select(scalar.fold_key(F.concat("s_name", F.lit(" Ação—Café")))))
    .unionAll(table(s, d, "pages").select(scalar.fold_key(F.regexp_extract("html", "<title>([^<]*)", 1)))).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
