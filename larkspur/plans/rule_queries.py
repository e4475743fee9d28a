"""Rule-engine, gate and streaming queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import categorise, quality, routing, rules
from ..sources.adapters import INCOME, OTC, TX, income, otc, table, transactions
from ..sources.tables import shared_dir
from ..streaming import events as streaming
from .registry import SQL, query

SUPPLIERS = "select 'S' || k as supplier, case when k % 3 = 0 then 'housing' when k % 3 = 1 then 'transport' end as default_category from range(50) r(k)"


def suppliers(s):
    k = F.col("id")
    return s.range(50).select(F.concat(F.lit("S"), k.cast("string")).alias("supplier"), F.when(k % 3 == 0, "housing").when(k % 3 == 1, "transport").alias("default_category"))


VALUES = [("1-urgent", 250000.0, "salary"), ("5-low", 100000.0, "rent")]
query("classifier_chain", f"""select seq, layer, case layer when 1 then 'intercontas' when 2 then 'reimbursed' when 3 then v when 4 then default_category else 'a_identificar' end as category,
case when layer <= 3 then 'high' when layer = 4 then 'medium' else 'low' end as confidence from (
select *, case when own and not refund then 1 when refund then 2 when v is not null then 3 when default_category is not null then 4 else 5 end as layer from (
select seq, default_category, lower(description) like '%customer#00000001%' as own, amount > 0 and lower(description) like '%refund%' as refund,
case when lower(description) like '%1-urgent%' and abs(abs(cast(amount as double)) - 250000.0::double) <= 0.05::double * 250000.0::double then 'salary'
     when lower(description) like '%5-low%' and abs(abs(cast(amount as double)) - 100000.0::double) <= 0.05::double * 100000.0::double then 'rent' end as v
from tx left join ({SUPPLIERS}) using (supplier)))""", TX)(
    lambda s, d: rules.classified(transactions(s, d), ("Customer#00000001",), {"refund": "reimbursed"}, VALUES, suppliers(s)))


def with_parts(s, d):
    n, m = scalar.installment(F.col("description"))
    return transactions(s, d).withColumn("n", n).withColumn("m", m)


query("recurrence", """select r as recurrence, count(*) as n from (select case when category = 'intercontas' then null when description like '%PARC %' and (seq % 12 + 1) <= (seq % 5 + 8) then 'installment'
when category = 'household' then 'monthly' when category = 'building' then 'yearly' else 'one_off' end as r from tx) group by r""", TX)(
    lambda s, d: with_parts(s, d).select(rules.recurrence(F.col("n"), F.col("m"), F.col("category"), {"household": "monthly", "building": "yearly"}).alias("recurrence")).groupBy("recurrence").agg(F.count(F.lit(1)).alias("n")))

query("basis_dates", "select seq, cast(case when source_type = 'fatura' then last_day(tx.date) + 10 else tx.date end as varchar) as cash, cast(tx.date as varchar) as accrual from tx", TX)(lambda s, d: rules.date_bases(transactions(s, d)))

OPS = ["Compra", "Venda/", "Dividendo", "Juros Sobre Capital Próprio", "Juros", "Desdobramento", "Empréstimo/Aluguel de Ativos", "Transferência - Liquidação", "Atualização", "AMORTIZACAO PROGRAMADA", "PAGAMENTO DE JUROS", "Restituição de Capital", "APLICAÇÃO", "RESGATE ANTECIPADO/",
       "Cessão de Direitos", "COMPRA / VENDA", "Leilão de Fração", " Rendimento Líquido ", "AMORTIZAÇÃO", "VENCIMENTO", "Bonificação em Dinheiro", "Sobras de Subscrição", "Fusão", "Something else", ""]


def movements(s, d):
    li, k = table(s, d, "lineitem"), F.col("l_orderkey") + F.col("l_linenumber")
    units = k % 4 == 0
    return li.select(
        k.alias("key"), F.element_at(F.array(*map(F.lit, OPS)), (k % len(OPS) + 1).cast("int")).alias("operation"), F.when(F.col("l_partkey") % 3 == 0, " CDB").when(F.col("l_partkey") % 3 == 1, "acao").alias("asset_type"),
        F.when(F.col("l_suppkey") % 3 == 0, "Credito").when(F.col("l_suppkey") % 3 == 1, "Debito").alias("direction"), F.col("l_quantity").alias("quantity"), F.when(~units, F.col("l_extendedprice")).alias("price"), F.when(~units, F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"),
        F.when(F.col("l_partkey") % 50 == 0, False).alias("known"))


query("router", f"""select ledger, kind, coalesce(reason, '') as reason, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as value from (
select case when ign or op = '' then 'ignored' when flag then 'flagged' when unknown then 'unknown' when r is null then 'flagged' else r.l end as ledger, case when ign or unknown and not flag or r is null and not flag then '' when flag then 'manual' else r.k end as kind,
case when ign then null when flag then 'manual: ' || op when unknown then 'unknown product or institution' when r is null then 'unclassified: ' || op end as reason, case when ign or flag or unknown or r is null or r.l = 'corporate' then null when r.s = '-' then -abs(v) when r.s = '+' then abs(v) else v end as value from (
select *, op = 'Atualização' or op in ('AMORTIZACAO PROGRAMADA', 'PAGAMENTO DE JUROS') and dir = 'Debito' as ign, op = 'Empréstimo/Aluguel de Ativos' as flag,
case when op in ('Compra', 'Venda', 'Cessão de Direitos', 'Transferência - Liquidação', 'COMPRA / VENDA') then case when op = 'Compra' or op not in ('Venda', 'Cessão de Direitos') and dir = 'Credito' then {{'l': case when rf then 'otc' else 'orders' end, 'k': case when rf then 'aplicacao' else 'C' end, 's': '-'}}
  else {{'l': case when rf then 'otc' else 'orders' end, 'k': case when rf then 'resgate' else 'V' end, 's': '+'}} end
when op = 'Sobras de Subscrição' then {{'l': 'orders', 'k': 'C', 's': '-'}}
when op in ('Dividendo', 'Juros Sobre Capital Próprio', 'Leilão de Fração', 'Rendimento Líquido', 'Bonificação em Dinheiro') then {{'l': 'income', 'k': case op when 'Dividendo' then 'dividendo' when 'Juros Sobre Capital Próprio' then 'jcp' when 'Leilão de Fração' then 'fracao' when 'Rendimento Líquido' then 'rendimento' else 'bonificacao_dinheiro' end, 's': ''}}
when op in ('Juros', 'PAGAMENTO DE JUROS') then case when rf then {{'l': 'otc', 'k': 'juros', 's': '+'}} else {{'l': 'income', 'k': 'juros', 's': ''}} end
when op in ('AMORTIZAÇÃO', 'AMORTIZACAO PROGRAMADA') then {{'l': case when rf then 'otc' else 'income' end, 'k': 'amortizacao', 's': ''}}
when op = 'Restituição de Capital' then {{'l': case when v = 0 then 'corporate' else 'income' end, 'k': 'restituicao_capital', 's': ''}}
when op in ('APLICAÇÃO', 'RESGATE ANTECIPADO', 'VENCIMENTO') then {{'l': 'otc', 'k': case op when 'APLICAÇÃO' then 'aplicacao' when 'VENCIMENTO' then 'vencimento' else 'resgate' end, 's': case op when 'APLICAÇÃO' then '-' else '+' end}}
when op in ('Desdobramento', 'Fusão') then {{'l': 'corporate', 'k': lower(replace(op, 'ã', 'a')), 's': ''}} end as r
from (select rtrim(trim([{', '.join(f"'{o}'" for o in OPS)}][cast((l_orderkey + l_linenumber) % {len(OPS)} as int) + 1]), '/') as op, l_partkey % 3 = 0 as rf, case l_suppkey % 3 when 0 then 'Credito' when 1 then 'Debito' end as dir, l_partkey % 50 = 0 as unknown,
  case when (l_orderkey + l_linenumber) % 4 = 0 then 0 else cast(l_extendedprice as decimal(18,2)) end as v from lineitem) where op <> '')) group by all""")(
    lambda s, d: routing.routed(movements(s, d)).groupBy("ledger", "kind", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")))

query("tag_rules", """select seq, array_to_string(list_sort(list_distinct(list_concat(list_concat(tags, case when supplier = 'S7' and amount > 0 then ['refund'] else [] end), case when supplier in ('S1', 'S2', 'S3') and category = 'building' then ['project'] else [] end))), '|') as tags from tx""", TX)(
    lambda s, d: categorise.tagged(transactions(s, d), {"S7": "refund"}, [(("S1", "S2", "S3"), "building", "project")]))

query("dup_aliases", "select lower(p_name) as alias, count(distinct p_brand) as n, array_to_string(list_sort(list(distinct p_brand)), ',') as slugs from part group by lower(p_name) having count(distinct p_brand) > 1")(
    lambda s, d: quality.duplicate_aliases(table(s, d, "part").select(F.col("p_brand").alias("slug"), F.col("p_name").alias("alias"))))

query("large_untagged", "select seq, cast(amount as double) as amount from tx where amount <= -300000 and len(tags) = 0 and seq % 4 <> 3", TX)(
    lambda s, d: quality.large_untagged(transactions(s, d), transactions(s, d).where("seq % 4 = 3"), 300000))

ASSETS = "assets as (select 'P' || (p_partkey % 300) as product, max(date '1998-01-01' + cast(p_size * 30 as int)) as maturity, bool_or(p_size % 2 = 0) as active from part group by 1)"


def assets(s, d):
    p = table(s, d, "part")
    return p.groupBy(F.concat(F.lit("P"), (F.col("p_partkey") % 300).cast("string")).alias("product")).agg(F.max(F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size") * 30)).alias("maturity"), F.bool_or(F.col("p_size") % 2 == 0).alias("active"))


query("stale_assets", """select * from (select product, case when active and maturity < date '2000-06-30' then 'stale_active' when not active and product in (select product from otc where date > date '2000-06-30' - 365) then 'stale_inactive' end as kind from assets) where kind is not null""", OTC, ASSETS)(
    lambda s, d: quality.stale_assets(assets(s, d), otc(s, d), "2000-06-30"))

query("misfiled_income", "select ticker, count(*) as n, cast(sum(value) as double) as value from income where ticker in (select 'T' || (p_partkey % 200) from part where p_type = 'SMALL') group by ticker", INCOME)(
    lambda s, d: quality.misfiled(income(s, d), table(s, d, "part").where("p_type = 'SMALL'").select(F.concat(F.lit("T"), (F.col("p_partkey") % 200).cast("string")).alias("ticker"))))


query("upsert_validation", """select why, count(*) as n from (select case when coalesce(id, '') = '' then 'empty' when count(*) over (partition by id) > 1 then 'repeated' when kind not in ('SMALL', 'LARGE', 'ECONOMY') then 'unknown_kind' end as why
from (select case when p_partkey % 50 = 0 then '' else p_brand || '/' || p_size || '/' || (p_partkey % 3) end as id, p_type as kind from part)) where why is not null group by why""")(
    lambda s, d: quality.invalid_inputs(table(s, d, "part").select(F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"))).alias("id"), F.col("p_type").alias("kind")), ["SMALL", "LARGE", "ECONOMY"]))

query("quality_label", "select product, case when n = 1 and manual then 'unverified' when date '1995-05-01' - first < 90 then 'short_window' else 'complete' end as label from (select product, count(*) as n, min(date) as first, bool_and(source = 'manual') as manual from otc group by product)", OTC)(
    lambda s, d: quality.quality_label(otc(s, d), "1995-05-01"))

query("bucket_divergence", "select *, gap <= 0.01 as passed from (select bucket, mean, 0.05::double as stored, round(abs(mean - 0.05::double), 6) as gap from (select l_returnflag || l_linestatus as bucket, round(cast(sum(cast(l_discount as decimal(6,2))) as double) / count(*), 6) as mean from lineitem group by 1))")(
    lambda s, d: quality.bucket_divergence(table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("bucket"), F.col("l_discount").cast("decimal(6,2)").alias("rate")), table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("bucket"), F.lit(0.05).alias("stored")).distinct(), 0.01)
    .withColumn("mean", F.col("mean").cast("double")).withColumn("gap", F.round(F.abs(F.col("mean") - 0.05), 6)))


def _events(s, d, name):
    """The event table as a stream of Parquet files, in order of time."""
    path = f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"
    table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/in.parquet")
    return streaming.stream(s, f"{path}/in.parquet", 100), f"{path}/out"


def stream_windows(s, d):
    rows, path = _events(s, d, "windows")
    got = streaming.drained(streaming.windowed(rows), path, "append")
    return got.select(F.substring(F.col("start").cast("string"), 1, 19).alias("start"), "event_type", "n", F.col("value").cast("double").alias("value"))


def stream_balances(s, d):
    rows, path = _events(s, d, "balances")
    got = streaming.drained(streaming.balances(rows), path, "update")
    return got.groupBy("account").agg(F.max_by("balance", "batch").alias("balance"), F.max("n").alias("n")).select("account", "balance", "n")


#: A window comes out once the watermark, 10 minutes behind the latest event, has passed its end.
query("stream_hourly_windows", """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as value from events
where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minute group by 1, 2""")(stream_windows)
query("stream_account_balances", "select user_id as account, cast(sum(case when event_type in ('purchase', 'error') then -cast(value as decimal(18,2)) else cast(value as decimal(18,2)) end) as double) as balance, count(*) as n from events group by user_id")(stream_balances)


from ..operators import graph, ledger  # noqa: E402
from ..sources.adapters import TRADES, trades  # noqa: E402
from .corpus_queries import dependencies  # noqa: E402


def actions(s, d):
    """Trades with a split, a bonus and a conversion for some tickers."""
    t = trades(s, d).withColumn("seq", F.expr("row_number() over (partition by ticker order by date, ord)")).select("ticker", "seq", F.col("side").alias("kind"), "quantity", F.col("total").cast("double").alias("total"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("string").alias("target"))
    names = t.select("ticker").distinct()
    k = F.substring("ticker", 2, 9).cast("int")
    act = lambda where, kind, ratio, target: names.where(where).select("ticker", F.lit(1000000).cast("int").alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("total"), F.lit(ratio).alias("ratio"), target.cast("string").alias("target"))
    none, unknown = F.lit(None), s.createDataFrame([("ZZ", 1, "bonificacao", None, None, 1.0, None)], t.schema)
    done = [act(k % 10 == 1, "desdobramento", 2.0, none), act(k % 10 == 2, "bonificacao", 0.1, none), act(k % 10 == 3, "conversao", 0.3, F.concat(F.lit("N"), k.cast("string"))), act(k % 10 == 4, "expiracao", None, none),
            act(k % 10 == 5, "ajuste", None, none), act(k % 10 == 6, "cisao", 0.25, F.concat(F.lit("D"), k.cast("string"))), act(k % 10 == 7, "grupamento", None, none), unknown]
    for more in done:
        t = t.unionByName(more.withColumn("ratio", F.col("ratio").cast("double")))
    return t


def listed(s, d):
    """Tickers with a bonus are shares, what tickers are converted into are funds: whole units."""
    k = F.substring("ticker", 2, 9).cast("int")
    return trades(s, d).select("ticker").distinct().select(F.when(k % 10 == 3, F.concat(F.lit("N"), k.cast("string"))).otherwise(F.col("ticker")).alias("ticker"), F.when(k % 10 == 2, "Acao ").when(k % 10 == 3, "fii").otherwise("etf").alias("type"))


query("corporate_action_positions", """select ticker, round(quantity, 3) as quantity, round(cost, 2) as cost from (
select case when k % 10 = 3 then 'N' || k else ticker end as ticker, case k % 10 when 1 then q * 2 when 2 then trunc(q * 1.1::double) when 3 then trunc(q * 0.3::double) when 4 then 0 when 5 then 0 else q end as quantity, case k % 10 when 5 then 0 when 6 then c - c * 0.25::double / 1.25::double else c end as cost from z
union all select ticker, 0.0::double, 0.0::double from z where k % 10 = 3 union all select 'D' || k, q * 0.25::double, c * 0.25::double / 1.25::double from z where k % 10 = 6)""", TRADES, """
f as (select ticker, cast(0 as bigint) as seq, cast(0 as double) as q, cast(0 as double) as c from (select distinct ticker from trades) union all
select f.ticker, t.seq, case when t.side = 'C' then f.q + t.quantity else f.q - t.quantity end,
case when t.side = 'C' then f.c + abs(cast(t.total as double)) when f.q > 0 then f.c * (1.0::double - least(t.quantity / f.q, 1.0::double)) else f.c end from f join trades t on t.ticker = f.ticker and t.seq = f.seq + 1),
z as (select *, cast(ticker[2:] as int) as k from (select *, row_number() over (partition by ticker order by seq desc) as r from f) where r = 1)""")(
    lambda s, d: ledger.positions(actions(s, d), listed(s, d)).select("ticker", F.round("quantity", 3).alias("quantity"), F.round("cost", 2).alias("cost")))

query("dependency_cycles", "select doc_id as id from documents where doc_id % 500 >= 498")(lambda s, d: graph.cycles(dependencies(s, d)))
