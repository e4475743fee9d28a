"""Spend queries and their SQL."""

from __future__ import annotations

from ..operators import spend
from ..sources.adapters import EXCLUDED_SQL as EX
from ..sources.adapters import TX, transactions
from .registry import query

OUT = f"category not in {EX}"
NET = "case when amount < 0 then amount when amount > 0 and lower(description) like '%refund%' then amount else 0 end"
NETSPEND = f"net as (select strftime(date, '%Y-%m') as month, case when trim(supplier) = '' then '(unmapped)' else supplier end as supplier, cast(sum(-amount) as double) as spend from tx where {OUT} group by all)"

query("spend_by_month_supplier", "select * from net", TX, NETSPEND)(lambda s, d: spend.net_spend(transactions(s, d)))

query("spend_spikes", """select a.month, a.supplier, a.spend, b.spend as prior, case when b.spend > 0 then round((a.spend - b.spend) / b.spend, 6) end as pct, b.spend <= 0 as appeared
from net a join net b on a.supplier = b.supplier and strftime(cast(b.month || '-01' as date) + interval 1 month, '%Y-%m') = a.month
where (b.spend >= 100 and round((a.spend - b.spend) / b.spend, 6) > 0.2) or (b.spend <= 0 and a.spend >= 100)""", TX, NETSPEND)(lambda s, d: spend.spend_spikes(spend.net_spend(transactions(s, d))))

query("supplier_rollup_92d", """select supplier, volume, case when volume >= 200 and supplier <> '' then supplier else 'Outros' end as rolled from (
select supplier, cast(coalesce(sum(abs(amount)) filter (where date between date '1999-06-30' - 92 and date '1999-06-30'), 0) as double) as volume from tx group by supplier)""", TX)(
    lambda s, d: spend.supplier_rollup(transactions(s, d), "1999-06-30"))

query("net_expense_by_category", f"""select category, net, round(net / sum(net) over (), 6) as share, round(recurring / net, 6) as recurring_share from (
select category, cast(sum(-({NET})) as double) as net, cast(sum(case when description like '%PARC %' then -({NET}) else 0 end) as double) as recurring from tx where {OUT} group by category) where net > 0""", TX)(
    lambda s, d: spend.net_by_category(transactions(s, d)))

query("tag_totals", f"select tag, cast(sum(-net) as double) as total, count(*) as n from (select unnest(tags) as tag, {NET} as net from tx where {OUT}) group by tag", TX)(lambda s, d: spend.tag_totals(transactions(s, d)))

query("month_kpis", f"""select strftime(date, '%Y-%m') as month, cast(sum(x) as double) as expense,
cast(sum(case when category = 'receitas' and not (amount > 0 and lower(description) like '%refund%') then amount else 0 end) as double) as income, count(*) as n,
cast(sum(case when description like '%PARC %' then x else 0 end) as double) as recurring, cast(sum(case when description like '%PARC %' then 0 else x end) as double) as one_off
from (select *, -(case when {OUT} then {NET} else 0 end) as x from tx) group by 1""", TX)(lambda s, d: spend.month_kpis(transactions(s, d)))

query("category_evolution_pivot", f"""select month, cast(top1 as double) as top1, cast(top2 as double) as top2, cast(top3 as double) as top3, cast(other as double) as other, total,
round((total - lag(total) over (order by month)) / lag(total) over (order by month), 6) as change from (
select month, coalesce(sum(v) filter (where r = 1), 0) as top1, coalesce(sum(v) filter (where r = 2), 0) as top2, coalesce(sum(v) filter (where r = 3), 0) as top3, coalesce(sum(v) filter (where r > 3), 0) as other, cast(sum(v) as double) as total
from (select strftime(date, '%Y-%m') as month, category, sum(-amount) as v from tx where {OUT} group by all)
join (select category, row_number() over (order by sum(-amount) desc, category) as r from tx where {OUT} group by category) using (category) group by month)""", TX)(lambda s, d: spend.evolution(transactions(s, d)))

query("tx_filter_page", """select seq, cast(tx.date as varchar) as date, category, cast(amount as double) as amount from tx where category in ('building', 'machinery') and list_has_any(tags, ['travel', 'work'])
and lower(description) like '%customer#%' and amount < 0 order by tx.date desc, seq limit 30 offset 30""", TX)(lambda s, d: spend.filter_page(transactions(s, d), ["building", "machinery"], ["travel", "work"], "Customer#", 2))

query("ledger_sample", """select seq, cast(tx.date as varchar) as date, category, cast(amount as double) as amount from tx where strftime(date, '%Y-%m') like '1997-0%' and lower(category) = 'furniture' and abs(amount) between 1000 and 200000
order by tx.date, seq limit 50 offset 5""", TX)(lambda s, d: spend.ledger_sample(transactions(s, d), "1997-0", "Furniture", 1000, 200000, 5, 80))

query("any_column_search", "select seq, description from tx where lower(concat_ws(chr(1), category, bank, supplier, description, source_type, currency)) like '%not spec%' order by seq limit 100", TX)(
    lambda s, d: spend.any_column(transactions(s, d), "NOT SPEC"))

query("statement_window", """select bank, count(*) filter (where i) as kept, count(*) filter (where not i) as removed from (
select bank, case when source_type = 'fatura' then date between date '1997-03-01' - 5 and date '1997-03-31' + 5 else date between date '1997-03-01' and date '1997-03-31' end as i from tx) group by bank""", TX)(
    lambda s, d: spend.statement_window(transactions(s, d), "1997-03-01"))

query("coverage_gate", f"""select month, coalesce(round(coalesce(t, 0) / s, 6), 1.0) as coverage, case when n > 0 then round(nt / n, 6) else 1.0 end as row_coverage, coalesce(coalesce(t, 0) / s, 1.0) >= 0.7 as passed from (
select strftime(date, '%Y-%m') as month, cast(sum(-amount) filter (where amount < 0 and {OUT}) as double) as s, cast(sum(-amount) filter (where amount < 0 and {OUT} and len(tags) > 0) as double) as t,
count(*) filter (where amount < 0 and {OUT}) as n, count(*) filter (where amount < 0 and {OUT} and len(tags) > 0) as nt from tx group by 1)""", TX)(lambda s, d: spend.coverage(transactions(s, d)))

query("tx_count_gate", """select *, outside <= 0.1 as passed from (
select bank, expected, count(*) as n, round(avg(case when date between cast(expected || '-01' as date) - 5 and last_day(cast(expected || '-01' as date)) + 5 then 0.0::double else 1.0::double end), 6) as outside
from tx join (select bank, m as expected from (select bank, m, row_number() over (partition by bank order by k desc, m) as r from (select bank, strftime(date, '%Y-%m') as m, count(*) as k from tx group by all)) where r = 1) using (bank) group by all)""", TX)(
    lambda s, d: spend.transaction_count_gate(transactions(s, d)))

query("boundary_days", """select bank, count(*) filter (where e) as on_boundary, count(*) filter (where e and source_type <> 'fatura') as prompts
from (select *, day(date) <= 5 or day(date) >= day(last_day(date)) - 4 as e from tx) group by bank""", TX)(lambda s, d: spend.boundary_days(transactions(s, d)))

query("top_suppliers", "select supplier, round(sum(spend), 2) as spend from net group by supplier order by spend desc, supplier limit 10", TX, NETSPEND)(lambda s, d: spend.top_suppliers(transactions(s, d)))

query("month_delta", f"""select a.month, a.spend, round(a.spend - coalesce(b.spend, 0), 2) as delta from m a left join m b on strftime(cast(b.month || '-01' as date) + interval 1 month, '%Y-%m') = a.month""", TX,
      f"m as (select strftime(date, '%Y-%m') as month, cast(sum(-amount) as double) as spend from tx where {OUT} group by 1)")(lambda s, d: spend.month_delta(transactions(s, d)))
