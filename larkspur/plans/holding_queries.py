"""Queries of foreign-currency accounts, bridged flows, crypto and valuation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import scaled_round
from ..operators import invest, ledger, valuation
from ..sources.adapters import INCOME, OTC, QUOTES, TRADES, income, otc, quotes, table, trades
from .invest_queries import AVERAGE
from .registry import query

KINDS = ["in", "in", "out", "income", "buy", "sell"]


def fx_events(s, d):
    """An account per user: transfers, income and trades of three tickers, at prices of 5 to 11."""
    k = F.col("event_id")
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("account"), F.to_date("ts").alias("date"), k.alias("seq"), F.element_at(F.array(*map(F.lit, KINDS)), (k % 6 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("K"), (F.floor(k / 6) % 3).cast("string")).alias("ticker"), F.col("value").alias("amount"), (5 + k % 10 / 10).alias("rate"), (F.col("value") / (5 + k % 7)).alias("quantity"))


#: The fold as a recursion over an account's events: tranches and lots are lists; what is taken from the oldest is what a
#: running total of them covers.
FX_FOLD = """ev as (select cast(user_id as varchar) as account, event_id as seq, ['in', 'in', 'out', 'income', 'buy', 'sell'][cast(event_id % 6 as int) + 1] as kind, 'K' || (event_id // 6 % 3) as ticker, value as amount, 5 + event_id % 10 / 10.0::double as rate, value / (5 + event_id % 7) as qty,
row_number() over (partition by user_id order by cast(ts as date), [1, 1, 5, 2, 4, 3][cast(event_id % 6 as int) + 1], event_id) as k from events),
fold(account, k, bal, avg, last, tr, lots, inc) as (
select distinct account, cast(0 as bigint), 0.0::double, 0.0::double, 0.0::double, cast([] as struct(q double, r double)[]), cast([] as struct(t varchar, q double, r double, p double)[]), cast([] as struct(t varchar, seq bigint, a double, r double)[]) from ev union all
select account, k, case kind when 'in' then bal + amount when 'income' then bal + amount when 'sell' then bal + amount else bal - amount end,
case kind when 'in' then case when bal + amount <= 0 then avg when bal <= 0 then rate else (bal * avg + amount * rate) / (bal + amount) end
  when 'income' then case when bal + amount <= 0 then avg when bal <= 0 then used else (bal * avg + amount * used) / (bal + amount) end
  when 'out' then case when len(tr2) > 0 then list_sum(list_transform(tr2, lambda x: x.q * x.r)) / list_sum(list_transform(tr2, lambda x: x.q)) when bal - amount <= 0 then 0 else avg end else avg end,
case when kind = 'out' and len(tr2) = 0 and bal - amount <= 0 and avg > 0 then avg else last end,
case kind when 'in' then list_append(case when bal <= 0 and bal + amount > 0 then [] else tr end, {'q': amount, 'r': rate}) when 'out' then tr2 else tr end,
case kind when 'buy' then list_append(lots, {'t': ticker, 'q': qty, 'r': avg, 'p': amount / qty}) when 'sell' then
  list_filter(list_transform(range(1, len(lots) + 1), lambda i: case when lots[i].t <> ticker then lots[i] else {'t': ticker, 'q': greatest(0, least(lots[i].q, list_sum(list_transform(list_filter(lots[1:i], lambda y: y.t = ticker), lambda y: y.q)) - qty)), 'r': lots[i].r, 'p': lots[i].p} end), lambda y: y.q > 1e-12) else lots end,
case kind when 'income' then list_append(inc, {'t': ticker, 'seq': seq, 'a': amount, 'r': used}) else inc end
from (select f.account, ev.k, bal, avg, last, tr, lots, inc, ev.kind, ev.amount, ev.rate, ev.qty, ev.ticker, ev.seq,
  list_filter(list_transform(range(1, len(tr) + 1), lambda i: {'q': greatest(0, least(tr[i].q, list_sum(list_transform(tr[1:i], lambda y: y.q)) - ev.amount)), 'r': tr[i].r}), lambda y: y.q > 1e-12) as tr2,
  coalesce(list_sum(list_transform(list_filter(lots, lambda y: y.t = ev.ticker), lambda y: y.q * y.r)) / list_sum(list_transform(list_filter(lots, lambda y: y.t = ev.ticker), lambda y: y.q)), case when avg <> 0 then avg else last end) as used
  from fold f join ev on ev.account = f.account and ev.k = f.k + 1)),
final as (select * from (select *, row_number() over (partition by account order by k desc) as r from fold) where r = 1)"""
query("fx_accounts", "select account, round(bal, 4) as balance, round(avg, 6) as average, round(last, 6) as last from final", FX_FOLD)(
    lambda s, d: ledger.fx_accounts(fx_events(s, d)).select("account", scaled_round(F.col("balance"), 4).alias("balance"), scaled_round(F.col("average"), 6).alias("average"), scaled_round(F.col("last"), 6).alias("last")))
query("fx_ticker_rates", """select account, l.t as ticker, round(sum(l.q), 6) as quantity, round(sum(l.q * l.r) / sum(l.q), 6) as rate, round(sum(l.q * l.r * l.p), 4) as cost from (select account, avg, last, unnest(lots) as l from final) group by account, l.t""", FX_FOLD)(
    lambda s, d: ledger.fx_engine(fx_events(s, d)).where("what = 'ticker' and amount > 0").select("account", "ticker", scaled_round(F.col("amount"), 6).alias("quantity"), scaled_round(F.col("rate"), 6).alias("rate"), scaled_round(F.col("brl"), 4).alias("cost")))
query("fx_income_home", "select account, i.t as ticker, count(*) as n, round(sum(i.a * i.r), 4) as brl from (select account, unnest(inc) as i from final) group by account, i.t", FX_FOLD)(
    lambda s, d: ledger.fx_engine(fx_events(s, d)).where("what = 'income'").groupBy("account", "ticker").agg(F.count(F.lit(1)).alias("n"), scaled_round(F.sum("brl"), 4).alias("brl")))
query("fx_spot_rates", "select account, round(case when avg <> 0 then avg when last <> 0 then last else 5.0 end, 6) as rate from final", FX_FOLD)(
    lambda s, d: ledger.spot_rate(ledger.fx_accounts(fx_events(s, d))).select("account", scaled_round(F.col("rate"), 6).alias("rate")))


def renames(s, d):
    """T10k goes over into N10k, and N10k into M10k; T10k+5 gives a share to S10k+5 at the middle of 1996."""
    n = trades(s, d).select("ticker").distinct().withColumn("k", F.substring("ticker", 2, 9).cast("int"))
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    row = lambda where, seq, day, kind, a, b, share: n.where(where).select(F.lit(seq).alias("seq"), F.lit(day).cast("date").alias("date"), F.lit(kind).alias("kind"), name(a).alias("ticker"), name(b).alias("target"), F.lit(share).cast("double").alias("share"))
    return row("k % 10 = 0", 1, "1997-01-01", "conversao", "T", "N", None).unionByName(row("k % 10 = 0", 2, "1998-01-01", "fusao", "N", "M", None)).unionByName(row("k % 10 = 5", 3, "1996-06-30", "cisao", "T", "S", 0.2501))


FLOWS = "flows as (select ticker, cast(ticker[2:] as int) as n, date, cast(sum(case when side = 'C' then -total else total end) as double) as flow from trades group by all)"
query("bridged_flows", """select ticker, count(*) as n, round(sum(flow), 3) as flow from (select case when n % 10 = 0 then 'M' || n else ticker end as ticker, case when n % 10 = 5 and date <= date '1996-06-30' then flow * 0.7499::double else flow end as flow from flows
union all select 'S' || n, flow * 0.2501::double from flows where n % 10 = 5 and date <= date '1996-06-30') group by ticker""", TRADES, FLOWS)(
    lambda s, d: ledger.bridged_flows(invest.flows(trades(s, d)), renames(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 3).alias("flow")))


def swaps(s, d):
    """Trades between a coin and money, or between two coins, on three exchanges."""
    k = F.col("l_orderkey")
    coin = lambda n: F.concat(F.lit("C"), (F.col("l_partkey") % n).cast("string"))
    li = table(s, d, "lineitem")
    return li.select(
        F.to_date("l_shipdate").alias("date"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.concat(F.lit("X"), (F.col("l_suppkey") % 3).cast("string")).alias("exchange"),
        F.when(k % 3 == 0, "BRL").otherwise(coin(40)).alias("buy_asset"), F.col("l_quantity").alias("buy_quantity"), F.when(k % 3 == 1, "BRL").otherwise(F.concat(coin(40), F.lit("b"))).alias("sell_asset"), F.col("l_quantity").alias("sell_quantity"), F.col("l_extendedprice").alias("price_brl"))


query("crypto_positions", """select ticker, round(q, 4) as quantity, round(c, 2) as cost from (select ticker, q, c, row_number() over (partition by ticker order by seq desc) as r from f) where r = 1""", """
leg as (select cast(l_shipdate as date) as date, l_orderkey, l_linenumber, l_partkey, l_suppkey, 'C' || (l_partkey % 40) || '@X' || (l_suppkey % 3) as ticker, 'C' as side, l_quantity as quantity, l_extendedprice as total from lineitem where l_orderkey % 3 <> 0
union all select cast(l_shipdate as date), l_orderkey, l_linenumber, l_partkey, l_suppkey, 'C' || (l_partkey % 40) || 'b@X' || (l_suppkey % 3), 'V', l_quantity, l_extendedprice from lineitem where l_orderkey % 3 <> 1)""",
      "trades as (select *, row_number() over (partition by ticker order by date, l_orderkey, l_linenumber, l_partkey, l_suppkey) as seq from leg)", AVERAGE)(lambda s, d: ledger.crypto_positions(swaps(s, d)))


def priced(s, d):
    """Record of each ticker's position: every fifth is foreign, every seventh has no price, every third of the foreign has lots."""
    n = F.substring("ticker", 2, 9).cast("int")
    held = invest.average_cost(trades(s, d)).join(income(s, d).groupBy("ticker").agg(F.sum("value").cast("double").alias("dividends")), "ticker", "left").select(
        F.col("ticker").alias("id"), F.when(n % 5 == 0, "USD").otherwise("BRL").alias("currency"), "quantity", "cost", F.coalesce("dividends", F.lit(0.0)).alias("dividends"))
    prices = invest.latest_close(quotes(s, d), "2002-01-01").where(n % 7 != 0).select(F.col("ticker").alias("id"), F.col("close").alias("price"))
    rates = held.where("currency = 'USD' and cast(substr(id, 2) as int) % 3 = 0").select("id", F.lit(4.5119).alias("rate"), (F.col("cost") * 4.5119).alias("cost_brl"))
    return valuation.entries(held, prices, rates, 5.2137)


ENTRIES = """h as (select z.ticker as id, cast(z.ticker[2:] as int) as n, round(q, 4) as quantity, round(c, 2) as cost, coalesce(v, 0) as dividends from (select *, row_number() over (partition by ticker order by seq desc) as r from f) z
left join (select ticker, cast(sum(value) as double) as v from income group by ticker) i on i.ticker = z.ticker where r = 1 and round(q, 4) > 1e-6),
e0 as (select h.*, n % 5 = 0 as usd, p.price, round(quantity * coalesce(p.price, 0), 2) as value from h left join (select ticker, arg_max(close, date) as price from quotes where cast(ticker[2:] as int) % 7 <> 0 group by ticker) p on p.ticker = h.id),
e1 as (select *, case when not usd then cost when n % 3 = 0 and cost > 0 then round(cost * 4.5119::double, 2) else round(cost * 5.2137::double, 2) end as cost_home, case when usd then round(value * 5.2137::double, 2) else value end as value_home from e0),
en as (select id, case when usd then 'USD' else 'BRL' end as currency, quantity, cost as cost_basis, value, round(value - cost, 2) as pnl, case when cost > 0 then round((value - cost) / cost, 4) else 0 end as pnl_share, case when cost > 0 then round(dividends / cost, 4) else 0 end as yield_on_cost,
cost_home, value_home, round(value_home - cost_home, 2) as pnl_home, case when usd and coalesce(price, 0) <> 0 then round(value - cost, 2) end as return_usd, case when usd and coalesce(price, 0) <> 0 then round(cost * 5.2137::double - cost_home, 2) + 0.0 end as return_fx_brl from e1)"""
ALL = (TRADES, INCOME, QUOTES, AVERAGE, ENTRIES)
query("position_entries", "select * from en", *ALL)(priced)
query("portfolio_totals", """select n, cast(v as double) as value, cast(c as double) as cost, cast(v - c as double) as pnl, case when c > 0 then round(cast(v - c as double) / cast(c as double), 4) else 0 end as pnl_share
from (select count(*) as n, sum(cast(value_home as decimal(24,2))) as v, sum(cast(cost_home as decimal(24,2))) as c from en)""", *ALL)(lambda s, d: valuation.totals(priced(s, d)))


def kinds(s, d):
    return trades(s, d).select(F.col("ticker").alias("id")).distinct().withColumn("kind", F.concat(F.lit("g"), (F.substring("id", 2, 9).cast("int") % 4).cast("string")))


query("summary_cards", """select 'g' || (cast(id[2:] as int) % 4) as kind, count(*) as n, cast(sum(cast(value_home as decimal(24,2))) as double) as value, count(*) filter (where pnl_home > 0) as gaining,
round(max(value_home) / cast(sum(cast(value_home as decimal(24,2))) as double), 4) as dominance, cast(sum(cast(coalesce(return_usd, 0) as decimal(24,2))) as double) as return_usd from en group by 1""", *ALL)(lambda s, d: valuation.cards(priced(s, d), kinds(s, d)))


def classes(s, d):
    return kinds(s, d).where("kind <> 'g3'").select("id", F.col("kind").alias("class"))


def rates_of(s, d):
    return kinds(s, d).where("cast(substr(id, 2) as int) % 5 = 0").select("id", F.lit(5.2).alias("rate"))


CLASS = """cf as (select case when id[1] = 'T' and n % 4 <> 3 then 'g' || (n % 4) else 'other' end as class, date, cast(sum(cast(round(flow * case when id[1] = 'T' and n % 5 = 0 then 5.2::double else 1.0::double end, 4) as decimal(24,4))) as double) as flow, cast(sum(k) as bigint) as n from (
select id, cast(id[2:] as int) as n, date, cast(sum(cast(flow as decimal(24,4))) as double) as flow, count(*) as k from (select ticker as id, date, cast(case when side = 'C' then -total else total end as double) as flow from trades union all
select ticker, date, cast(value as double) from income union all select product, date, cast(amount as double) from otc) group by all) group by 1, 2)"""
query("class_flows", "select class, cast(date as varchar) as date, flow, n from cf", TRADES, INCOME, OTC, CLASS)(
    lambda s, d: valuation.class_flows(trades(s, d), income(s, d), otc(s, d), classes(s, d), rates_of(s, d)).select("class", F.col("date").cast("string").alias("date"), "flow", "n"))
query("class_summary", """select class, cast(coalesce(n_flows, 0) as bigint) as n_flows, coalesce(net, 0) as net, coalesce(terminal, 0) as terminal, class = 'other' and coalesce(n_flows, 0) >= 50 as warn from (select class, sum(n) as n_flows, cast(sum(cast(flow as decimal(24,4))) as double) as net from cf group by class)
full join (select case when cast(id[2:] as int) % 4 <> 3 then 'g' || (cast(id[2:] as int) % 4) else 'other' end as class, cast(sum(cast(value_home as decimal(24,2))) as double) as terminal from en group by 1) using (class)""", *ALL, OTC, CLASS)(
    lambda s, d: valuation.class_summary(valuation.class_flows(trades(s, d), income(s, d), otc(s, d), classes(s, d), rates_of(s, d)), priced(s, d), classes(s, d)))
query("active_products", "select product, cast(sum(amount) as double) as flow, v as value from otc join (select product, case when cast(product[2:] as int) % 3 = 0 then 10.0::double end as v from (select distinct product from otc)) using (product) group by product, v having abs(cast(sum(amount) as double)) > 100000 or coalesce(v, 0) <> 0", OTC)(
    lambda s, d: valuation.active_otc(otc(s, d).groupBy("product").agg(F.sum("amount").cast("double").alias("flow")).withColumn("value", F.when(F.substring("product", 2, 9).cast("int") % 3 == 0, 10.0)), 100000))
query("quote_status", f"""select ticker, last, r30, case when n % 11 = 0 then 'DELISTED' when last is null then 'MISSING' else 'OK' end as status from (select t.ticker, cast(t.ticker[2:] as int) as n, case when cast(t.ticker[2:] as int) % 7 <> 0 then l.close end as last,
case when cast(t.ticker[2:] as int) % 7 <> 0 then round(l.close / (select arg_max(close, date) from quotes q where q.ticker = t.ticker and l.date - q.date >= 30) - 1, 4) end as r30
from (select distinct ticker from trades) t left join (select ticker, arg_max(close, date) as close, max(date) as date from quotes group by ticker) l using (ticker))""", TRADES, QUOTES)(
    lambda s, d: valuation.quote_table(trades(s, d).select("ticker").distinct(), invest.offset_returns(quotes(s, d).where("cast(substr(ticker, 2) as int) % 7 <> 0")), trades(s, d).select("ticker").distinct().where("cast(substr(ticker, 2) as int) % 11 = 0")).select("ticker", "last", "r30", "status"))
query("markets_and_methods", """select m as market, case when p_type in ('SMALL') then 'balance' when p_type in ('PROMO') then 'crypto' else 'price' end as method, k as kind, count(*) as n from (select *, case p_partkey % 4 when 0 then 'B3' when 1 then 'US' when 2 then 'crypto' else 'unknown' end as m,
case when p_name like '%ring%' then 'rf' when p_name like '%bolt%' then 'fund' else 'acao' end as k from part) group by all""")(
    lambda s, d: table(s, d, "part").withColumn("t", F.element_at(F.array(F.lit("PETR4"), F.lit("BRK.B"), F.lit("BTC-USD"), F.lit("?9")), (F.col("p_partkey") % 4 + 1).cast("int"))).groupBy(
        valuation.market(F.col("t")).alias("market"), valuation.valuation_method(F.col("p_type"), ("SMALL",), ("PROMO",)).alias("method"), valuation.asset_kind(F.col("p_name"), [("RING", "rf"), ("bolt", "fund")]).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
