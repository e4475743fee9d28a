"""Join and investment queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment, invest, joins
from ..sources.adapters import FX, INCOME, OTC, QUOTES, TRADES, TX, fx_rates, income, otc, quotes, table, trades, transactions
from .registry import SQL, query

query("fx_asof_join", """select seq, coalesce(cast((select rate from fx r where r.currency = tx.currency and r.date <= tx.date order by r.date desc limit 1) as double),
cast((select rate from fx r where r.currency = tx.currency order by r.date limit 1) as double)) as rate from tx where currency <> 'BRL'""", TX, FX)(
    lambda s, d: joins.asof_join(transactions(s, d).where("currency <> 'BRL'").select("seq", "currency", "date"), fx_rates(s, d), "currency", "date", "rate").select("seq", F.col("rate").cast("double").alias("rate")))

ALIASES = [("ring", 1), ("small ring", 2), ("widget", 3), ("red", 4), ("blue bolt", 5), ("bolt", 6), ("hot", 7), ("gear", 8), ("idge", 9), ("l", 10), ("old Ge", 11), ("all r", 12), ("hot small ring gear bolt", 13)]
query("part_longest_alias", f"""select p_partkey, alias, case when upper(alias) = upper(p_name) then 'exact' when alias is not null then 'partial' end as match from (
select p_partkey, p_name, (select a from (values {', '.join(f"('{a}', {r})" for a, r in ALIASES)}) v(a, r) where contains(upper(p_name), upper(a)) order by length(a) desc, r limit 1) as alias from part)""")(
    lambda s, d: containment.longest_alias(table(s, d, "part").select("p_partkey", "p_name"), s.createDataFrame(ALIASES, "alias string, rank int"), "p_name").select("p_partkey", "alias", "match"))

# every customer's name in every order's description, patterns as many as customers
query("names_in_descriptions", "select seq, c_custkey as customer from tx join customer on contains(description, c_name)", TX)(
    lambda s, d: containment.contained(transactions(s, d).select(F.col("description").alias("text")), table(s, d, "customer").select(F.col("c_name").alias("pattern")))
    .join(transactions(s, d).select("seq", F.col("description").alias("text")), "text").join(table(s, d, "customer").select("c_custkey", F.col("c_name").alias("pattern")), "pattern").select("seq", F.col("c_custkey").alias("customer")))

REGISTRY = [("colours", "red"), ("colours", "BLUE"), ("rings", "small-ring"), ("rings", "1 urgent"), ("gears", "customer 00000001"), ("refunds", "refund PARC"), ("bolts", "olt"), ("none", "--")]
query("registry_overlaps", f"""select seq as id, entry from tx, (select distinct entry, ' ' || trim(regexp_replace(lower(signal), '[^a-z0-9]+', ' ', 'g')) || ' ' as p from (values {', '.join(f"('{a}', '{b}')" for a, b in REGISTRY)}) v(entry, signal))
where trim(p) <> '' and contains(' ' || trim(regexp_replace(lower(concat_ws(' ', description, bank, category)), '[^a-z0-9]+', ' ', 'g')) || ' ', p) group by all""", TX)(
    lambda s, d: containment.overlapping_entries(transactions(s, d).select(F.col("seq").alias("id"), F.array("description", "bank", "category").alias("terms")), s.createDataFrame(REGISTRY, "entry string, signal string")))

TWINS = """twins as (select seq, date, amount, bank, currency from tx union all
select seq + 1000000000, date, cast(-amount as decimal(18,2)), 'OTHER', currency from tx where seq % 7 = 0)"""


def with_transfers(s, d):
    t = transactions(s, d).select("seq", "date", "amount", "bank", "currency")
    return t.unionByName(t.where("seq % 7 = 0").select((F.col("seq") + 1000000000).alias("seq"), "date", (-F.col("amount")).cast("decimal(18,2)").alias("amount"), F.lit("OTHER").alias("bank"), "currency"))


#: Pairs of the rows of twins, in order.
PAIRED = """grp as (select date, currency, abs(amount) as size, list({'seq': seq, 'up': amount > 0, 'bank': bank} order by seq) as l from twins where amount <> 0 group by date, currency, abs(amount) having count(*) > 1),
step(date, currency, size, l, k, used, pairs) as (select date, currency, size, l, cast(1 as bigint), cast([] as bigint[]), cast([] as struct(a bigint, b bigint)[]) from grp union all
select date, currency, size, l, k + 1, case when y is null then used else list_append(list_append(used, x.seq), y.seq) end,
case when y is null then pairs else list_append(pairs, case when x.up then {'a': x.seq, 'b': y.seq} else {'a': y.seq, 'b': x.seq} end) end from (
select *, case when list_contains(used, l[k].seq) then null else list_filter(l, lambda z: z.up <> l[k].up and z.bank <> l[k].bank and not list_contains(used, z.seq))[1] end as y, l[k] as x from step where k <= len(l)))"""
query("transfer_pairs", """select cast(date as varchar) as date, currency, cast(size as double) as size, p.a as in_seq, p.b as out_seq from (
select date, currency, size, unnest(pairs) as p from (select *, row_number() over (partition by date, currency, size order by k desc) as r from step) where r = 1)""", TX, TWINS, PAIRED)(
    lambda s, d: joins.offsetting_pairs(with_transfers(s, d)))

query("cross_source_dedup", """select source, count(*) as n, cast(sum(amount) as double) as total from otc o where source <> 'b3' or not exists (
select 1 from otc p where p.source = 'broker' and p.date = o.date and p.operation = o.operation and p.product = o.product and abs(p.amount) = abs(o.amount)) group by source""", OTC)(
    lambda s, d: joins.cross_source_dedup(otc(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total")))

query("duplicate_groups", """select cast(date as varchar) as date, operation, product, cast(size as double) as size, s as sources, n, list_contains(l, 'broker') as covered from (
select date, operation, product, abs(amount) as size, list_sort(list(distinct source)) as l, array_to_string(list_sort(list(distinct source)), ',') as s, count(*) as n from otc group by date, operation, product, abs(amount)) where len(l) > 1""", OTC)(
    lambda s, d: joins.duplicate_groups(otc(s, d)))

query("tolerance_match", """select a.seq, count(b.amount) as matches, count(*) filter (where a.x = b.amount) as exact from
(select seq, currency, bank, cast(amount as double) as x from tx where seq % 50 = 0) a left join (select currency, bank, cast(amount as double) as amount from tx) b
on a.currency = b.currency and a.bank = b.bank and (a.x = b.amount or abs(a.x - b.amount) <= 0.001 * greatest(abs(a.x), abs(b.amount))) group by a.seq""", TX)(
    lambda s, d: joins.tolerance_match(*(transactions(s, d).where(w).select("seq", "currency", "bank", F.col("amount").cast("double").alias("amount")) for w in ("seq % 50 = 0", "true")), ["currency", "bank"], "amount", 0.1).select("seq", "matches", "exact"))


query("bag_difference", """select operation, product, n, coalesce(m, 0) as known, greatest(n - coalesce(m, 0), 0) as surplus from (select operation, product, count(*) as n from otc where source = 'b3' group by all)
left join (select operation, product, count(*) as m from otc where source = 'broker' group by all) using (operation, product)""", OTC)(
    lambda s, d: joins.bag_difference(otc(s, d).where("source = 'b3'"), otc(s, d).where("source = 'broker'"), ["operation", "product"]))

CUT = "1999-06-30"
query("snapshot_delta", """select * from (select ticker, n.v as now, b.v as before, case when b.v <> 0 then round((n.v - b.v) / b.v, 6) end as change,
case when b.v is null then 'new' when coalesce(n.v, 0) = 0 then 'zeroed' when b.v <> 0 and abs(round((n.v - b.v) / b.v, 6)) > 0.2 then 'moved' end as kind
from n full join b using (ticker)) where kind is not null""", TRADES,
      "n as (select ticker, sum(case when side = 'C' then quantity else -quantity end) as v from trades where date <= date '1999-06-30' group by ticker), b as (select ticker, sum(case when side = 'C' then quantity else -quantity end) as v from trades where date <= date '1999-03-31' group by ticker)")(
    lambda s, d: joins.snapshot_delta(*(trades(s, d).where(f"date <= date'{c}'").groupBy("ticker").agg(F.sum(F.when(F.col("side") == "C", F.col("quantity")).otherwise(-F.col("quantity"))).alias("v")) for c in (CUT, "1999-03-31")), "ticker", "v"))

query("near_misses", """select a.seq as rid, count(*) as near from tx a join tx b on (a.date = b.date) <> (a.amount = b.amount) and (a.date = b.date or a.amount = b.amount) where a.seq % 50 = 0 group by a.seq""", TX)(
    lambda s, d: joins.near_misses(transactions(s, d).where("seq % 50 = 0").select(F.col("seq").alias("rid"), "date", "amount"), transactions(s, d).select("seq", "date", "amount")))


query("path_diff", """select path, kind from (select path, case when a.h is null then 'added' when b.h is null then 'removed' when a.h <> b.h then 'changed' end as kind from
(select doc_id as path, sha256(text) as h from documents where doc_id % 5 <> 0) a full join (select doc_id as path, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 3 <> 0) b using (path)) where kind is not null""")(
    lambda s, d: joins.path_diff(table(s, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash")),
                                 table(s, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))))

AVERAGE = """f as (select ticker, cast(0 as bigint) as seq, cast(0 as double) as q, cast(0 as double) as c from (select distinct ticker from trades) union all
select f.ticker, t.seq, case when t.side = 'C' then f.q + t.quantity else f.q - t.quantity end,
case when t.side = 'C' then f.c + abs(cast(t.total as double)) when f.q > 0 then f.c * (1.0::double - least(t.quantity / f.q, 1.0::double)) else f.c end from f join trades t on t.ticker = f.ticker and t.seq = f.seq + 1)"""
query("average_cost_positions", "select ticker, round(q, 4) as quantity, round(c, 2) as cost from (select ticker, q, c, row_number() over (partition by ticker order by seq desc) as r from f) where r = 1", TRADES, AVERAGE)(
    lambda s, d: invest.average_cost(trades(s, d)))

# whole cents, cut off just above them, as lots often cost whole or half cents and the last bits of sums differ
query("fifo_cost", """select s.ticker, round(sum(least(e, b) - greatest(e0, b0)), 4) as sold, floor(cast(sum(cast((least(e, b) - greatest(e0, b0)) * price as decimal(28,6))) as double) * 100 + 0.013) / 100 as cost
from (select ticker, e, coalesce(lag(e) over (partition by ticker order by seq), 0) as e0 from r where side <> 'C') s
join (select ticker, b - quantity as b0, b, cast(total as double) / quantity as price from r where side = 'C') l on s.ticker = l.ticker and least(e, b) > greatest(e0, b0) group by s.ticker""", TRADES, """
q as (select *, sum(case when side = 'C' then quantity else 0 end) over w as b, sum(case when side = 'C' then 0 else quantity end) over w as s from trades window w as (partition by ticker order by seq)),
r as (select *, s - greatest(0, -min(b - s) over (partition by ticker order by seq)) as e from q)""")(lambda s, d: invest.fifo_cost(trades(s, d)).withColumn("cost", F.floor(F.col("cost") * 100 + 0.013) / 100))

FLOWS = "flows as (select ticker, date, sum(case when side = 'C' then -total else total end) as flow from trades group by all)"
query("running_flow", "select ticker, cast(date as varchar) as date, cast(flow as double) as flow, cast(sum(flow) over (partition by ticker order by date) as double) as running from flows", TRADES, FLOWS)(lambda s, d: invest.running_flow(trades(s, d)))


def terminal(s, d):
    held = invest.average_cost(trades(s, d))
    return held.join(invest.latest_close(quotes(s, d), "2002-01-01"), "ticker").select("ticker", F.lit("2002-01-01").cast("date").alias("tdate"), F.round(F.greatest("quantity", F.lit(0.0)) * F.col("close"), 2).alias("value"))


#: Bisection as a recursion of 60 steps over both brackets; the first that holds a change of sign counts.
BISECT = """held as (select ticker, round(q, 4) as quantity from (select *, row_number() over (partition by ticker order by seq desc) as r from f) where r = 1),
ends as (select h.ticker, date '2002-01-01' as date, round(greatest(quantity, 0) * close, 2) as flow from held h join (select ticker, arg_max(close, date) as close from quotes group by ticker) using (ticker)),
fl0 as (select ticker, date, cast(flow as double) as flow from flows where flow <> 0 and ticker in (select ticker from ends) union all select * from ends where flow <> 0),
fl as (select ticker, (date - min(date) over (partition by ticker)) / 365.25::double as t, flow from fl0),
ok as (select ticker, count(*) as n, bool_or(flow > 0) and bool_or(flow < 0) and count(*) >= 2 as ok from fl group by ticker),
b0 as (select ticker, a, z, sign(sum(flow / pow(1 + a, t))) as sa, sign(sum(flow / pow(1 + z, t))) as sz from fl, (values (-0.99::double, 10.0::double), (-0.5::double, 5.0::double)) v(a, z) group by ticker, a, z),
bi(ticker, a0, a, z, sa, i) as (select ticker, a, a, z, sa, 0 from b0 where sa <> sz union all
select ticker, a0, case when s = sa then m else a end, case when s = sa then z else m end, sa, i + 1 from (
select bi.ticker, a0, a, z, sa, i, (a + z) / 2 as m, sign(sum(flow / pow(1 + (a + z) / 2, t))) as s from bi join fl on fl.ticker = bi.ticker where i < 60 group by bi.ticker, a0, a, z, sa, i)),
xi as (select ok.ticker, n as n_flows, case when ok then round((select (a + z) / 2 from bi where bi.ticker = ok.ticker and i = 60 order by a0 limit 1), 5) end as xirr from ok)"""
query("xirr_by_ticker", "select * from xi", TRADES, QUOTES, FLOWS, AVERAGE, BISECT)(lambda s, d: invest.xirr(invest.flows(trades(s, d)), terminal(s, d)))
query("irr_band_gate", "select ticker, case when xirr is null then 'missing' when abs(xirr) > 2 then 'out_of_band' else 'ok' end as verdict from xi", TRADES, QUOTES, FLOWS, AVERAGE, BISECT)(lambda s, d: invest.irr_band_gate(invest.xirr(invest.flows(trades(s, d)), terminal(s, d))))

query("offset_returns", f"""select q.ticker, l.close as last, {', '.join(f"round(l.close / arg_max(q.close, q.date) filter (where l.date - q.date >= {n}) - 1, 4) as r{n}" for n in (1, 30, 90, 180, 365))},
round(l.close / arg_min(q.close, q.date) filter (where year(q.date) = year(l.date)) - 1, 4) as ytd from quotes q join (select ticker, arg_max(close, date) as close, max(date) as date from quotes group by ticker) l on q.ticker = l.ticker group by q.ticker, l.close""", TRADES, QUOTES)(
    lambda s, d: invest.offset_returns(quotes(s, d)))

query("negative_episodes", """select account, episode, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, cast(min(balance) as double) as lowest, count(*) as n, strftime(max(nxt), '%Y-%m-%d %H:%M:%S') as ended from (
select *, cast(sum(begun) over (partition by account order by ts, event_id) as bigint) as episode from (
select *, case when balance < 0 and not coalesce(lag(balance < 0) over (partition by account order by ts, event_id), false) then 1 else 0 end as begun, lead(ts) over (partition by account order by ts, event_id) as nxt from (
select event_id, user_id as account, ts, sum(case when event_type in ('purchase', 'error') then -cast(value as decimal(18,2)) else cast(value as decimal(18,2)) end) over (partition by user_id order by ts, event_id) as balance from events)))
where balance < 0 group by account, episode""")(
    lambda s, d: invest.negative_episodes(table(s, d, "events").select("event_id", F.col("user_id").alias("account"), "ts", (F.col("value").cast("decimal(18,2)") * F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1)).alias("amount"))))

query("allocation_by_class", """select p_type as class, value, round(value / sum(value) over (), 6) as share from (select p_type, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value from lineitem join part on l_partkey = p_partkey group by p_type)""")(
    lambda s, d: invest.allocation(table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("class"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost")), "class"))

query("income_monthly", """select month, cast(coalesce(sum(value) filter (where type = 'dividendo'), 0) as double) as dividendo, cast(coalesce(sum(value) filter (where type = 'jcp'), 0) as double) as jcp,
cast(coalesce(sum(value) filter (where type = 'rendimento'), 0) as double) as rendimento from (select strftime(date, '%Y-%m') as month, type, value from income) group by month order by month desc limit 24""", INCOME)(lambda s, d: invest.income_by_month(income(s, d)))

query("income_kpis", """select (select cast(sum(v) as double) from m) as lifetime, (select month from m order by v desc, month desc limit 1) as best, (select cast(sum(v) as double) from (select v from m order by month desc limit 12)) as ttm,
(select count(distinct ticker) from income) as payers""", INCOME, "m as (select strftime(date, '%Y-%m') as month, sum(value) as v from income group by 1)")(lambda s, d: invest.income_kpis(income(s, d)))

query("unified_history", """select ledger, kind, count(*) as n, cast(sum(value) as double) as value, cast(max(date) as varchar) as latest from (
select date, 'orders' as ledger, side as kind, cast(case when side = 'C' then -total else total end as decimal(18,4)) as value from trades union all
select date, 'income', type, value from income union all select date, 'otc', operation, cast(amount as decimal(18,4)) from otc) group by ledger, kind""", TRADES, INCOME, OTC)(
    lambda s, d: invest.unified_history(trades(s, d), income(s, d), otc(s, d)).groupBy("ledger", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"), F.max("date").cast("string").alias("latest")))

query("phantom_income", """select *, juros > 0 and aplicacao = 0 as phantom from (select product, cast(coalesce(sum(abs(amount)) filter (where operation = 'aplicacao'), 0) as double) as aplicacao,
cast(coalesce(sum(abs(amount)) filter (where operation = 'resgate'), 0) as double) as resgate, cast(coalesce(sum(abs(amount)) filter (where operation = 'juros'), 0) as double) as juros from otc group by product)""", OTC)(
    lambda s, d: invest.phantom_income(otc(s, d)))

query("latest_snapshot", """select product, cast(date as varchar) as date, operation, source, cast(amount as double) as amount from (select *, row_number() over (partition by product order by date desc, key, operation, source, amount) as r from otc) where r = 1""", OTC)(
    lambda s, d: invest.latest_snapshot(otc(s, d)))

def booked(s, d):
    """Orders as booked: price and fees stand beside the total, which is 2 % too high in one order of 97."""
    price, fees = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4), F.round(F.col("l_extendedprice") * F.col("l_tax") / 100, 2)
    buy = F.col("l_returnflag") != "R"
    total = (F.col("l_extendedprice") + F.when(buy, fees).otherwise(-fees)) * F.when(F.col("l_orderkey") % 97 == 0, 1.02).otherwise(1.0)
    return table(s, d, "lineitem").select(F.concat(F.lit("B"), (F.col("l_suppkey") % 5).cast("string")).alias("broker"), F.when(buy, "C").otherwise("V").alias("side"), F.col("l_quantity").alias("quantity"), price.alias("price"), fees.alias("fees"), F.when(F.col("l_orderkey") % 89 == 0, 0.0).otherwise(total).alias("total"))


query("order_total_gate", """select broker, count(*) as n, count(*) filter (where total <> 0 and abs(total - x) / abs(total) > 0.005) as bad, count(*) filter (where total <> 0 and abs(total - x) / abs(total) > 0.005) = 0 as passed from (
select 'B' || (l_suppkey % 5) as broker, case when l_orderkey % 89 = 0 then 0.0::double else (l_extendedprice + case when l_returnflag <> 'R' then 1 else -1 end * fees) * case when l_orderkey % 97 = 0 then 1.02::double else 1.0::double end end as total,
l_quantity * round(l_extendedprice / l_quantity, 4) + case when l_returnflag <> 'R' then 1 else -1 end * fees as x from (select *, round(l_extendedprice * l_tax / 100, 2) as fees from lineitem)) group by broker""")(lambda s, d: invest.order_total_gate(booked(s, d)))

query("consumed_matches", """select how, count(*) as n, count(m) as matched from (select seq, m, case when m is null then 'insert' when exact then 'exact' else 'fuzzy' end as how from (
select unnest(hits, recursive := true) from (select hits, row_number() over (partition by currency, bank order by k desc) as r from st) where r = 1)) group by how""", TX, """
grp as (select currency, bank, list({'seq': seq, 'x': x} order by seq) filter (where seq % 20 = 1) as l, list({'seq': seq, 'x': y} order by seq) filter (where seq % 40 in (0, 20)) as g from (
select seq, currency, bank, round(cast(amount as double), -4) as x, round(cast(amount as double), -4) * 1.005::double as y from tx) group by currency, bank),
st(currency, bank, l, g, k, used, hits) as (select currency, bank, l, g, cast(1 as bigint), cast([] as bigint[]), cast([] as struct(seq bigint, m bigint, exact boolean)[]) from grp where l is not null union all
select currency, bank, l, g, k + 1, case when y is null then used else list_append(used, y.seq) end, list_append(hits, {'seq': l[k].seq, 'm': y.seq, 'exact': coalesce(y.x = l[k].x, false)}) from (
select *, list_filter(coalesce(g, []), lambda z: not list_contains(used, z.seq) and (z.x = l[k].x or abs(z.x - l[k].x) <= 0.01::double * greatest(abs(z.x), abs(l[k].x))))[1] as y from st where k <= len(l)))""")(
    lambda s, d: joins.consumed_matches(
        transactions(s, d).where("seq % 20 = 1").select("seq", "currency", "bank", F.round(F.col("amount").cast("double"), -4).alias("x")),
        transactions(s, d).where("seq % 20 = 0").select("seq", "currency", "bank", (F.round(F.col("amount").cast("double"), -4) * 1.005).alias("x")), ["currency", "bank"], "x", 1.0)
    .groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count("match").alias("matched")))

query("trailing_92d", "select ticker, cast(date as varchar) as date, cast(sum(v) over (partition by ticker order by date range between interval 92 day preceding and current row) as double) as trailing from (select ticker, date, sum(total) as v from trades group by all)", TRADES)(
    lambda s, d: invest.trailing_sum(trades(s, d), "ticker"))
